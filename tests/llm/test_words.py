import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.llm.elias_fano import Sequence, encode
from barweave.llm.quality import measure
from barweave.llm.words import distinct, shingles, slices, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t 世#.", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_and_shingles_equal_python(rows, size):
    got_words, got_sets = [], []
    for text in slices(pa.array(rows, pa.string()), size):
        w = words(text)
        got_words += [text.data[a:b].tobytes().lower() for a, b in zip(w.start, w.end)]
        got_sets += [len(s) for s in distinct(*shingles(w, 3), len(text.bounds) - 1)]
    split = [(t or "").encode().lower().split() for t in rows]
    assert got_words == [x for s in split for x in s]
    want = [{tuple(s[i : i + 3]) for i in range(len(s) - 2)} or ({tuple(s)} if s else set()) for s in split]
    assert got_sets == [len(s) for s in want]


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(1, 60))
def test_measures_equal_python(rows, size):
    import re
    from collections import Counter

    got = []
    for text in slices(pa.array(rows, pa.string()), size):
        m = measure(text)
        got += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    want = []
    for t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams, marked, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                marked |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 62), 1 << 62), max_size=700), st.booleans())
def test_elias_fano_round_trip(values, dense):
    values = np.sort(np.array([v % 1000 for v in values] if dense else values, np.int64))
    s = Sequence(encode(values))
    assert s.select(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert s.select(i)[0] == values[i]
        assert s.select(i, 300).tolist() == values[i : i + 300].tolist()


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(encode(bounds)) * 8 < 13.5 * len(bounds)
