import gzip
import zlib

import numpy as np
from compare import differences, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awkward import SMALL, clashing, docs, empty  # noqa: F401
from barweave.llm import chat, hilbert, mixing, token_ids, warc
from barweave.llm.queries import ORACLE, QUERIES, tokenizer_file


def test_queries_equal_sql(spark):
    con = duck(SMALL)
    for name, sql in ORACLE.items():
        assert differences(QUERIES[name](spark, SMALL), con, sql) == [], name


def test_mix_of_awkward_rows(spark, docs, clashing, empty):
    rows = mixing.mixed(clashing).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs).collect()))
    got = mixing.repeated(clashing)
    assert got.columns == clashing.columns
    times = {(r.doc_id, r.size): r.taken // r.size for r in rows if r.size}
    for r in got.filter("doc_id in (1, 2, 7)").groupBy("doc_id").count().collect():
        assert times[next(k for k in times if k[0] == r.doc_id)] == r["count"]
    assert mixing.mixed(empty).count() == 0 and mixing.repeated(empty).count() == 0


def test_mix_comes_near_targets(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    got = mixing.mixed(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.first("source_size").alias("s"), F.sum("size").alias("own")).collect()
    assert all(abs(r.t - r.w) <= 18 and r.s == r.own and r.w <= 2 * r.s for r in got)
    assert abs(sum(r.w for r in got) - 1.5 * sum(r.s for r in got)) < 1e-6


def test_curve_visits_every_cell_once_by_unit_steps(spark):
    for n, bits in ((2, 3), (3, 3), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.floor(F.col("id") / side**k) % side).alias(f"x{k}") for k in range(n)])
        got = cells.select("*", hilbert.curve_index([F.col(f"x{k}") for k in range(n)], bits).alias("h")).orderBy("h").toPandas()
        assert got.pop("h").tolist() == list(range(side**n))
        assert (got.diff().abs().sum(axis=1)[1:] == 1).all()


def test_shards(spark, docs, clashing, empty):
    rows = hilbert.sharded(clashing, 4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, hilbert.sharded(docs, 4).collect())) and hilbert.sharded(empty).count() == 0
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = hilbert.sharded(given).join(given.select("doc_id", "text"), "doc_id").toPandas()
    assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got["size"].tolist() == [len(t.encode()) + 8 for t in got.text] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in got.text]
    order = got.sort_values(["shard", "slot"])
    assert (order.curve.diff().dropna() >= 0).all()
    runs = (order.text_crc32 != order.text_crc32.shift()).groupby(order.text_crc32).sum()
    assert runs.max() == 1  # equal texts stand together


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z'.,s!9\n\t 　\x1c\x85é世\x00", max_size=30), max_size=8))
def test_ids_equal_the_library(texts):
    enc = token_ids.encoder(tokenizer_file())
    ids, n = enc(texts)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_added_tokens_are_as_in_the_library():
    enc = token_ids.encoder(tokenizer_file())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c<|endoftext|>", ""]
    ids, _ = enc(texts)
    assert ids.tolist() == [x for t in texts for x in enc.tokenizer.encode(t, add_special_tokens=False).ids]


def test_shards_of_ids_round_trip(spark, docs, clashing, empty, tmp_path):
    for d in (clashing.repartition(3), spark.read.parquet(f"{SMALL}/documents.parquet")):
        shards = token_ids.write_shards(d, tokenizer_file(), f"{tmp_path}/{d.count()}")
        got = {(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_ids.read_shards(spark, shards).collect()}
        enc = token_ids.encoder(tokenizer_file())
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, h, r.text) for r, h in ((r, r.h) for r in d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect())), key=lambda r: r[:3])
        at, want = 0, set()
        for known, doc, _, text in rows:
            ids = np.append(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
            want.add((at, doc if known else None, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
        reader = token_ids.Reader(shards[0].path)
        a, b = reader.bounds.select(0, 2).tolist()
        assert reader.read(a, b)[-1] == token_ids.END_ID
    assert token_ids.token_id_report(empty, tokenizer_file()).count() == 0


TURNS = "conv_id long, turn long, role string, text string, token string"


def test_snapshots_collapse(spark):
    full = [("system", "s"), ("user", "hi"), ("assistant", "<|x|>"), ("user", None), ("assistant", "bye")]
    rows = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 3), (5, 1)):
        rows += [(conv, t, *full[t], "x") for t in range(n)]
    rows += [(6, t, r, x if t != 1 else "hi!", "x") for t, (r, x) in enumerate(full)]  # differs in turn 1
    rows += [(7, 0, "system", "s", "x"), (7, 1, None, "hi", "x"), (8, 0, "user", "", "x"), (9, 0, "user", None, "x"), (None, 3, "user", "lost", "x")]
    rows += [(10, 0, "user", "twice", "x"), (10, 0, "user", "twice", "x"), (11, 0, "user", "twice", "x")]
    got = {r.conv_id: r for r in chat.rendered(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {2, 6, 7, 8, 9, None, 10}
    assert got[2].text == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\n< |x|><|end|>\n<|user|>\n<|end|>\n<|assistant|>\nbye<|end|>\n" and got[10].n_turns == 2
    assert chat.rendered(spark.createDataFrame([], TURNS)).count() == 0


def test_one_conversation_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 16)
    monkeypatch.setattr(chat, "PART", 50)
    rows = [(1, t, "user", f"t{t}", "") for t in range(333)] + [(2, t, "user", f"t{t}", "") for t in range(100)] + [(3, t, "user", f"t{t + (t == 99)}", "") for t in range(100)]
    got = chat.rendered(spark.createDataFrame(rows, TURNS).repartition(7)).collect()
    assert {r.conv_id for r in got} == {1, 3} and sorted(r.n_turns for r in got if r.conv_id == 1) == [33] + [50] * 6
    assert "".join(r.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part)).count("<|end|>") == 333


def test_warc_records(spark, tmp_path):
    page = '<html lang=de><head><title>A &amp; b</title><style>p{}</style></head><body><!-- no --><p>Ein <b>T&uuml;r</b><br>zwei<script>x<y</script><a href="/k?a=1&amp;b">k</a><a href=#x>'
    rows = [(1, "http://e.org/x/", page), (2, None, None), (3, "http://e.org/", ""), (3, "http://e.org/", ""), (None, "bad uri\nhere", "<p>a<p>b" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    records = warc.derivatives(warc.responses(pages).withColumn("block", F.lit("clash")))
    got = records.collect()
    assert len(got) == 10 and [r.record_type for r in got].count("metadata") == 5
    one = {r.record_type: r for r in got if r.doc_id == 1}
    assert one["conversion"].block == "Ein Tür\nzweik" and one["metadata"].refers_to == one["conversion"].refers_to
    meta = one["metadata"].block
    assert "title: A & b\r\n" in meta and "language: de\r\n" in meta and "outlink: http://e.org/k?a=1&b A/href\r\n" in meta and "source-header: Content-Type: text/html" in meta
    assert one["metadata"].source_payload_digest == warc.digest(page.encode()) == [v for k, v in (line.split(": ", 1) for line in meta.split("\r\n") if line) if k == "source-payload-digest"][0]
    read = [x for f in warc.write_files(records, str(tmp_path)) for x in warc.read_file(f)]
    assert sorted((h["WARC-Record-ID"], h["WARC-Refers-To"], b.decode()) for h, b in read) == sorted((r.record_id, r.refers_to, r.block) for r in got)
    assert all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in read)
    assert gzip.open(next(tmp_path.glob("*.gz"))).read(8) == b"WARC/1.1"
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_text_behind_unclosed_elements():
    """Only what is hidden goes: (page, text)."""
    tail = '<title>T</title><p>after <a href="/k">k</a>'
    for head in ("<svg class='i'/>", "<SVG/>", "<template>", "<noscript>", "<svg>", "<!-->", "<!--->", "<!-- a --!>", "<svg-icon>", "<template><template>x</template>y</template>", "<svg><style>a</style></svg>",
                 "<template><!-- </template> --></template>", "<svg><template></svg>", "</svg>", "<script>a</script b>", "<style>a</style\n>", "<svg><svg/>x</svg>"):
        page = f"<p>before {head}{tail}"
        assert warc.plain_text(page) == "before\nT\nafter k", head
        meta = warc.derive("r", "http://e.org/", "", page)[0][2]
        assert "title: T\r\n" in meta and "outlink: http://e.org/k A/href\r\n" in meta, head
    for head in ("<!--", "<!-- a --", "<script>", "<style>a</styl>"):
        assert warc.plain_text(f"<p>before {head}{tail}") == "before", head
    assert warc.plain_text("a<svg/>b<svg>c</svg>d<template>e<svg>f</template>g</svg>h") == "abdgh"
    assert warc.plain_text("<template>" * 50_000 + "x") == "x"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B c", " ", "  ", "'s", ".", ",\n", "\n", "\r\n", "\t", "é", " é.", "–", "　", "\x85", "\xa0", " ", " ", "12", "<|endoftext|>", "!?", "世"]), max_size=12).map("".join))
def test_pieces_join_to_what_the_library_gives(text):
    enc = token_ids.encoder(tokenizer_file())
    assert enc([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_remembering_little_changes_nothing():
    from barweave.llm.piece_table import Table

    rng = np.random.default_rng(3)
    enc = token_ids.Encoder(tokenizer_file())
    enc.table = Table(enc.dtype, 256)
    for _ in range(40):
        texts = [" ".join(rng.choice(["ab", "cd.", "xyz", "q", "été,"]) * int(rng.integers(1, 9)) for _ in range(30)) for _ in range(4)]
        assert enc(texts)[0].tolist() == [x for t in texts for x in enc.tokenizer.encode(t, add_special_tokens=False).ids]
        assert enc.table.count <= 128


def test_long_texts_are_taken_in_parts(monkeypatch):
    enc = token_ids.Encoder(tokenizer_file())
    text = "some words, and\nmore 'words' " * 400
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    for size in (64, 1000):
        monkeypatch.setattr(token_ids, "SLICE_BYTES", size)
        assert enc([text, "", text])[0].tolist() == want * 2
