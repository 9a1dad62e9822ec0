import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awkward import SMALL, clashing, docs, empty  # noqa: F401
from barweave.llm import spelling
from barweave.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words, all_pairs=True):
    """Rows of the definition: every two words compared, or (for many words) every edit of a word looked up."""
    rows, forms, letters = {}, {}, sorted(set("".join(words)))
    for w, n in words.items():
        if all_pairs:
            close = [v for v in words if near(w, v)]
        else:
            edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
            edits |= {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
            close = [v for v in edits if v in words and v != w]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (n, len(close))
    out = []
    for w, (n, count) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, count, words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_the_definition(spark):
    for name in (SMALL, "/root/testdata/sf0.01"):
        given = spark.read.parquet(f"{name}/documents.parquet").select("doc_id", "text").collect()
        want = plain(counted(given), all_pairs=False)
        got = QUERIES["op13_spelling_variants"](spark, name)
        assert rows_of(got) == want and [t for _, t in got.dtypes] == ["string"] * 3 + ["bigint"] * 3
        assert sum(r[1] is not None for r in want) > 20


def test_small_alphabets(spark):
    """Chains of forms, ties, letters in a row, and neighbours of all kinds."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(90)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa"]
    texts = [(k, " ".join([w] * rng.choice([1, 2, 3, 3, 4, 6, 13, 30])).upper() if k % 2 else " ".join([w] * rng.choice([3, 7, 90]))) for k, w in enumerate(words)]
    want = counted(texts)
    assert plain(want) == plain(want, all_pairs=False)
    assert rows_of(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"))) == plain(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=7), st.integers(1, 9), min_size=1, max_size=40), parts=st.integers(1, 9))
def test_nodes_are_the_same_however_keys_are_cut(spark, words, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spelling.trie_nodes(spark.createDataFrame(list(words.items()), "key string, n int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbers = defaultdict(set)
    for r in rows:
        assert len(r.path) == len(r.key)
        for k, node in enumerate(r.path):
            numbers[r.key[: k + 1]].add(node)
    assert len(rows) == len(words) and all(len(v) == 1 for v in numbers.values()) and len(set().union(*numbers.values())) == len(numbers)
    ends = [r.path[-1] for r in sorted(rows, key=lambda r: r.key)]
    assert ends == sorted(ends)


def test_awkward_rows(spark, docs, clashing, empty, monkeypatch):
    want = plain(counted([(r.doc_id, r.text) for r in docs.collect()]))
    more = clashing.withColumn("key", F.lit("x")).withColumn("word", F.lit("y")).withColumn("id", F.lit(0))
    assert rows_of(spelling.variants(docs)) == rows_of(spelling.variants(more)) == want
    assert rows_of(spelling.variants(empty)) == []
    long = "x" * 3000
    texts = [(k, f"{long} {long[1:]} {long}y! été1ÉTÉS×÷ab") for k in range(4)]
    assert rows_of(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"))) == plain(counted(texts))


def test_parts_of_a_text_do_not_cut_words():
    data = ("ab" * 3 + ", é-" + "c" * 40 + " ") * 20
    for size in (1, 7, 50, 10_000):
        spelling.PART_BYTES, old = size, spelling.PART_BYTES
        try:
            got = [w for p in spelling._parts(data.encode()) for w in spelling.RUN.findall(p)]
        finally:
            spelling.PART_BYTES = old
        assert got == spelling.RUN.findall(data.encode())
