import random

import numpy as np

from pyspark.sql import functions as F

from barweave.llm import jaccard as J
from barweave.llm.graph import components
from barweave.llm.jaccard import jaccard_components, one_of_each
from awkward import SMALL, clashing, docs, empty  # noqa: F401


def token_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def closed(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, percent=75):
    sets = [token_set(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = closed(len(rows), links)
    least = {}
    for (d, _), r, s in zip(rows, root, sets):
        if s and d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r) if s else d) for (d, _), r, s in zip(rows, root, sets)), key=str)


def result(df):
    return sorted((tuple(r) for r in jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words)


def test_planted_families_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    common = [f"c{k}" for k in range(60)]
    for _ in range(6):
        words = [f"v{rng.randrange(10**5)}" for _ in range(rng.choice((40, 90, 200)))]
        rows += [edited(rng, words, s / 100) for s in range(0, 14) for _ in range(3)]
    # a passage that many texts share but that does not make them similar
    rows += [" ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(n)]) for n in range(10, 90, 2)]
    rows += ["a b c", "A b c", "a b c d e", "x", "", "   "]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])


def test_awkward_rows(spark, docs, clashing, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == brute(rows) == result(clashing)
    assert result(empty) == []
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect())
    texts = {r[1] for r in rows}
    assert ("1", next(t for d, t in rows if d == 1)) in got
    assert [g[0] for g in got] == sorted(["1", "4", "5", "6", "7", "8", "None", "10"])
    assert sum(t == "nobody owns this little text at all" for _, t in got) == 1 and len(texts) > len(got) - 2
    assert one_of_each(empty).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    pairs = [(names[k], names[k + 1]) for k in range(150)] + [(names[200], names[k]) for k in range(201, 400)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = closed(400, pairs)
    assert got == {k: r for k, r in enumerate(root) if r != k}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_join_of_everything(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("same words in every row of this table").alias("text"))
    assert {r.component_id for r in jaccard_components(docs).collect()} == {0}


def test_prefixes_under_further_orders_lose_nothing():
    rng = np.random.default_rng(4)
    allowed = J.prefixes_allow
    refused = 0
    for _ in range(400):
        n, new = int(rng.integers(1, 400)), rng.random() * 0.9
        x = np.unique(rng.integers(0, 1 << 56, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > new], rng.integers(0, 1 << 56, int(n * new * rng.random() * 2), np.uint64)]))
        need, shared = J.needed(len(x), len(y), 75), len(np.intersect1d(x, y))
        passed = [allowed(p, q, len(x), len(y), need) for p, q in zip(J.prefix_maps(x), J.prefix_maps(y))]
        assert all(passed) or shared < need
        refused += not all(passed)
    assert refused > 50


def test_each_order_drops_candidates_before_sets_are_read(spark):
    """Texts that share a passage are candidates under order 0 and must be dropped by the prefixes under the others."""
    rng = random.Random(2)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(rng.choice((30, 40))) for _ in range(60)]  # few texts hold each, so order 0 cannot put it last
    rows = [(k, " ".join(fresh(40) + passages[k % 60] + fresh(10))) for k in range(300)]
    dropped = [spark.sparkContext.accumulator(0) for _ in range(3)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), dropped=dropped)
    assert {r.component_id for r in got.collect()} == set(range(300))
    first, second, histogram = (c.value for c in dropped)
    assert first > 0 and second > 0 and first + second > histogram
