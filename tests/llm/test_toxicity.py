import random

import numpy as np
from pyspark.sql import functions as F

from awkward import clashing, docs, empty  # noqa: F401
from barweave.llm import toxicity as X
from barweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    got = {(r.toxic, r.predicted): r.n for r in rows.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert got[1, 1] >= 0.95 * (got[1, 1] + got.get((1, 0), 0)) and got.get((0, 1), 0) <= 0.01 * got[0, 0]


def test_penalty_keeps_groups_neutral(spark):
    """Abuse names one group far more often than neutral texts do; the penalty takes the blame off its name."""
    rng = random.Random(4)
    neutral = "the weather in town was mild and people went to work by train early".split()
    rows, labels = [], []
    for k in range(1200):
        words = [rng.choice(neutral) for _ in range(12)]
        toxic = k % 3 == 0
        if toxic:
            words[3:3] = [rng.choice(("awful", "stupid", "vile"))] * (rng.random() < 0.6)
        if rng.random() < (0.7 if toxic else 0.04):
            words.insert(5, "muslim")
        elif rng.random() < 0.3:
            words.insert(5, rng.choice(("christian", "buddhist")))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(f"the {g} people went to work by train",) for g in ("muslim", "buddhist")], "text string")
    gap = {}
    for penalty in (0.0, 4.0):
        a, b = (r.score for r in X.scored(probe, X.train(docs, labels, penalty=penalty)).collect())
        gap[penalty] = a - b
    assert gap[0.0] > 0.3 and abs(gap[4.0]) < 0.1


def test_awkward_rows(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (3, 1, 1), (8, 0, 0), (8, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(str, X.fold_scores(d, labels).collect())) for d in (docs, clashing))
    assert a == b and len(a) == docs.count()
    left = X.without_toxic(clashing, labels)
    assert left.columns == clashing.columns
    assert X.fold_scores(empty, labels).count() == 0
    nothing = X.fold_scores(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in nothing} == {(0.0, 0)}
    assert X.without_toxic(docs, labels.limit(0)).count() == docs.count()


def test_features_stay_within_their_text():
    import pyarrow as pa

    from barweave.llm.words import slices

    texts = ["ab cdefg", None, "", "cdefg", "x" * 300, "cdefg\nab"]
    alone = [set(X.features(t)[1].tolist()) if t.data.size else set() for s in texts for t in slices(pa.array([s], pa.string()))]
    together = [set() for _ in texts]
    for text in slices(pa.array(texts)):
        for d, b in zip(*X.features(text)):
            together[text.first + d].add(int(b))
    assert alone == together and together[0] == together[5] and len(together[3]) == 3
    one = ([np.array([0]), np.array([1])], [np.ones(1), np.ones(1)])
    assert np.isfinite(X.fit(np.array([1.0, 0.0]), one, one, one, np.array([3, 5]), 1.0).bias)


def test_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id % 4 as doc_id", "concat('text number ', id) as text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    seen = []
    fit = X.fit
    monkeypatch.setattr(X, "fit", lambda label, *rest: seen.append(len(label)) or fit(label, *rest))
    X.train(docs, labels, sample=3)
    assert seen == [3]


def test_production_penalty_keeps_groups_neutral(spark):
    """The registered parameters, not a larger penalty, on texts in which abuse names one group more often."""
    rng = random.Random(4)
    neutral = "the weather in town was mild and people went to work by train early".split()
    rows, labels = [], []
    for k in range(1200):
        words = [rng.choice(neutral) for _ in range(12)]
        toxic = k % 3 == 0
        if toxic:
            words[3:3] = [rng.choice(("awful", "stupid", "vile"))] * (rng.random() < 0.6)
        if rng.random() < (0.7 if toxic else 0.04):
            words.insert(5, "muslim")
        elif rng.random() < 0.3:
            words.insert(5, rng.choice(("christian", "buddhist")))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(f"the {g} people went to work by train",) for g in ("muslim", "buddhist")], "text string")
    a, b = (r.score for r in X.scored(probe, X.train(docs, labels)).collect())
    assert abs(a - b) < 0.1


def plain_scores(texts, model):
    """Scores by a loop over words and their beginnings."""
    import re

    import pyarrow as pa

    from barweave.llm.words import slices

    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    known: dict[str, list[int]] = {}

    def buckets(word):  # the hash of a word by itself; how often and where it counts is done here
        if word not in known:
            known[word] = [int(b) for t in slices(pa.array([word])) for b in X.measured(t)[1]]
        return known[word]

    out = []
    for text in texts:
        found = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
        count = {}
        for word in found:
            for b in buckets(word):
                count[b] = count.get(b, 0) + 1
        score = model.bias + sum(weight.get(b, 0.0) * min(c / len(found), X.MOST_SHARE) / X.UNIT for b, c in count.items())
        out.append(1 / (1 + np.exp(-score)))
    return out


def test_scores_equal_a_plain_computation(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, X.learnable(labels, F.col("doc_id")))
    some = docs.filter("doc_id % 7 = 0")
    got = X.scored(some, model).select("text", "score").collect()
    assert len(got) > 50 and np.abs(np.array([r.score for r in got]) - plain_scores([r.text for r in got], model)).max() < 1e-5


def test_names_put_into_the_given_texts_change_little(spark):
    """Neutral mentions: a group name put into given documents moves no score, and the penalty is at work there."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    assert set(X.name_buckets(X.IDENTITY_TERMS).tolist()) <= set(model.buckets.tolist())
    texts = [r.text.lower() for r in docs.filter("text is not null").limit(200).collect()]
    pairs = [X.put_in(t, X.IDENTITY_TERMS) for t in texts]
    assert all(a != b and len(a) > len(t) for (a, b), t in zip(pairs, texts))
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    a, b = ({r.k: r.score for r in X.scored(rows.select("k", F.col(c).alias("text")), model).collect()} for c in "ab")
    assert max(abs(a[k] - b[k]) for k in a) < 0.02
