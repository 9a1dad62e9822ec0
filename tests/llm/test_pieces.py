import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awkward import clashing, docs, empty  # noqa: F401
from barweave.llm import pieces
from barweave.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = pieces.Model(PATH)
PARTS = [" ", "  ", "▁", "a", "e", "th", "ing", ".", ",", "\n", "\t", "é", "世", "界", "\x00", "12", "<s>", "<0x41>", "😀", "​", "ä", "http://", "    ", "The", " the", "'s", "()", "=="]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=30)))
def test_ids_and_texts_equal_the_library(text):
    want = LIBRARY.encode(text)
    assert OWN.encode(text).tolist() == want and OWN.decode(want) == LIBRARY.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262), st.sampled_from([0, 1, 2, 259, 28705])), max_size=8))
def test_any_ids_read_as_in_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ▁thein.", max_size=24))
def test_the_search_gives_what_merging_gives(text):
    escaped = text.replace(" ", pieces.SPACE)
    assert OWN.tokens(escaped) == OWN.merged(escaped)


def test_parts_that_lead_nowhere_are_stepped_back_from():
    """A vocabulary in which the longest match is wrong, and one in which a character is no piece of its own."""
    small = object.__new__(pieces.Model)
    import ahocorasick

    def take(scores):
        small.ids = {t: k for k, t in enumerate(scores)}
        small.score, small.fits, small.alone = scores, {}, {}
        small.joined = {t[k : k + 2] for t in scores for k in range(len(t) - 1)}
        small.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in small.ids), t[0] if len(t) > 1 else None) for t in scores}
        small.automaton = ahocorasick.Automaton()
        for t in scores:
            small.automaton.add_word(t[::-1], t)
        small.automaton.make_automaton()

    rng = random.Random(7)
    for trial in range(60):
        pool = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(14)} | set("abc"[: 2 + trial % 2])
        take({t: float(rng.randint(-6, 0)) for t in sorted(pool)})
        for _ in range(60):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 24)))
            assert small.tokens(text) == small.merged(text), (pool, text)


def test_long_parts(spark):
    rng = random.Random(3)
    for text in (" " * 50_003, "a" * 50_001, "".join(rng.choice(PARTS).replace(" ", "x") for _ in range(40_000)), "世" * 20_000):
        assert OWN.encode(text).tolist() == LIBRARY.encode(text)


def test_forgetting_changes_nothing(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("theinorsa") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",", "!"]) for _ in range(300)]
    monkeypatch.setattr(pieces, "PAIRS", 5)
    forgetful = pieces.Model(PATH)
    forgetful.memo.limit = 1000  # bytes
    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(60))
        assert forgetful.encode(text).tolist() == LIBRARY.encode(text)
    assert len(forgetful.memo) < 20


def digests(text):
    ids = LIBRARY.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, name):
    given = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op12_sentencepiece"](spark, f"/root/testdata/{name}").collect()))
    assert got == sorted((r.doc_id, *digests(r.text)) for r in given)


def test_awkward_rows(spark, docs, clashing, empty, monkeypatch):
    got = pieces.encoded(clashing.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)), PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    key = lambda r: (r[0] is not None, r[0] or 0, str(r[1]))
    want = sorted(((r.doc_id, LIBRARY.encode(r.text or ""), LIBRARY.decode(LIBRARY.encode(r.text or "")) or "") for r in docs.collect()), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert pieces.encoded(empty, PATH).count() == 0


def test_other_models_raise(tmp_path):
    raw = open(PATH, "rb").read()
    other = tmp_path / "other.model"
    other.write_bytes(raw.replace(b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x00", b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x01"))  # spaces are to be removed
    assert other.read_bytes() != raw
    with pytest.raises(ValueError):
        pieces.Model(str(other))


def test_bytes_that_are_no_text():
    assert pieces.Model.text_of(b"a\xe4\xb8b\xffc") == "a��b�c"
    data, bounds = OWN.surfaces(np.array([264, 264, 13, 264]), np.array([0, 1, 1, 4]))
    assert (data.tobytes(), bounds.tolist()) == (b"aa\n a", [0, 1, 1, 5])
