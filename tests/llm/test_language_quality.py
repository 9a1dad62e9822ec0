import random

from pyspark.sql import functions as F

from awkward import SMALL, clashing, docs, empty  # noqa: F401
from barweave.llm import langid, quality
from barweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    got = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert got[0] >= 0.97 and 0 <= got[1] <= got[2] <= 1 and got[3] > 100


def test_grams_are_those_of_each_text_alone():
    import numpy as np
    import pyarrow as pa

    from barweave.llm.words import slices

    texts = ["Ab c", None, "", "12 3", "É-é", "abc abc", "x", "  y  ", "世界"]

    def plain(t):
        s = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()) + " "
        return sorted(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].strip())

    for size in (1, 6, 1000):
        got = [[] for _ in texts]
        for text in slices(pa.array(texts), size):
            doc, which, rows, _ = langid.grams(text, 3)
            for d, w in zip(doc, which):
                got[text.first + d].append("".join(chr(c) if c else " " for c in rows[w]))
        assert [sorted(g) for g in got] == [plain(t) for t in texts]
    assert np.abs(langid.letter_vector(ord("a"), 64)).tolist() == [1] * 64


def test_language_of_awkward_rows(spark, docs, clashing, empty):
    got = sorted(map(str, langid.fold_prediction(docs).collect()))
    assert got == sorted(map(str, langid.fold_prediction(clashing).collect())) and len(got) == docs.count()
    und = {r.doc_id for r in langid.fold_prediction(docs).filter("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6}
    assert langid.fold_prediction(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.fold_prediction(unlabelled).collect()} == {("und", 0.0)}


def test_thresholds_follow_the_group(spark, docs, clashing, empty):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for k in range(400):
        # one source writes with symbols as a rule; the other does not
        text = [word(5) + ("#" if k % 2 and i % 4 == 0 else "") for i in range(120)]
        rows.append((k, " ".join(text), "en", "code" if k % 2 else "prose"))
    rows += [(1000, " ".join(word(5) + "#" for _ in range(120)), "en", "prose"), (1001, " ".join(word(5) + "#" * (i % 4 == 0) for i in range(120)), "en", "prose")]
    rows += [(1002, "short text", "en", "prose"), (1003, " ".join(["same three words"] * 40), "en", "prose")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] == (False, True) for k in range(400))
    assert got[1000] == got[1001] == (False, False) and got[1002] == got[1003] == (True, False)
    a, b = (sorted(map(str, quality.judged(d).collect())) for d in (docs, clashing))
    assert a == b and len(a) == docs.count() and quality.judged(empty).count() == 0


def test_sketch_quantiles_are_near_and_merge(spark):
    values = sorted(random.Random(5).lognormvariate(0, 1) for _ in range(5000))
    rows = spark.createDataFrame([(v, k % 2) for k, v in enumerate(values)], "v double, part int")
    held = rows.groupBy("part", F.lit("r").alias("rule"), quality.bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))
    q = quality.quantiles(held, [], {"lower": 0.25, "upper": 0.75}).first()
    assert abs(q["lower"] / values[1250] - 1) < 0.03 and abs(q["upper"] / values[3750] - 1) < 0.03 and q["rows"] == 5000


def test_clean_given_documents_are_kept(spark):
    rows = QUERIES["op4_adaptive_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = {(r.quality, r.kept): r.n for r in rows.filter("not base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.01 * got[1, True] and got.get((0, True), 0) == 0


def test_every_rule_fires_and_limits_come_from_the_sketch(spark):
    rows = quality.base_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    found = quality.limits(quality.sketches(rows))
    joined = quality.with_limits(rows.filter(~quality.base_failed()), found)
    fired = joined.agg(*[F.count(F.when(~ok, 1)).alias(name) for name, ok in quality.fits().items()]).first()
    assert all(fired[name] > 0 for name in quality.LIMITS if name != "limit_4"), fired
    # without the bound of the language most limits are the same: they are the group's own
    free = {(r.lang, r.source): r for r in quality.limits(quality.sketches(rows), bound=1e9).collect()}
    own = sum(all(abs(free[r.lang, r.source][n] - r[n]) < 1e-12 for n in quality.LIMITS) for r in found.collect())
    assert own >= 60 and len({round(r.limit_2, 9) for r in free.values()}) > 20
    rows.unpersist()


def test_junk_in_a_quarter_of_a_group_does_not_open_its_limit(spark):
    rng = random.Random(9)
    text = lambda junk: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + "##" * (junk and i % 2) for i in range(90))
    rows = [(k, text(k % 4 == 0 and k < 200), "en", "bad" if k < 200 else "good") for k in range(1200)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k] for k in range(0, 200, 4)) and all(got[k] for k in range(1200) if k % 4 or k >= 200)
