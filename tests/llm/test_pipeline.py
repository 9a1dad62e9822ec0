import corpus_pipeline as P
from pyspark.sql import functions as F

from awkward import SMALL, clashing, docs, empty  # noqa: F401
from barweave.llm import token_ids, toxicity
from barweave.llm.queries import table, tokenizer_file
from test_decontaminate import brute as leaks
from test_jaccard import brute as components


def test_every_stage_on_given_tables(spark):
    docs = table(spark, SMALL, "documents")
    labels, bench = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    a = P.settle(P.drop_toxic(spark, docs, SMALL))
    scores = toxicity.fold_scores(docs, labels)
    assert a.columns == columns and ids(a) == ids(scores.filter("predicted = 0"))

    b = P.settle(P.drop_near_duplicates(spark, a, SMALL))
    want = components([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == columns and ids(b) == sorted(d for d, n, c in want if not n or d == c)

    c = P.settle(P.drop_benchmark(spark, b, SMALL))
    hit = {d for d, _ in leaks([(r.doc_id, r.text) for r in b.collect()], [(r.item_id, r.text) for r in bench.collect()])}
    assert c.columns == columns and ids(c) == sorted(set(ids(b)) - hit)

    d = P.settle(P.mix_sources(spark, c, SMALL))
    times = {r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert d.columns == columns and set(times.values()) <= {1, 2}
    words = sum(len(r.text.split()) * times.get(r.doc_id, 0) for r in c.collect())
    assert abs(words / (1.5 * sum(len(r.text.split()) for r in c.collect())) - 1) < 0.25  # a source has few documents here

    e = P.token_ids_of(spark, d, SMALL).collect()
    enc = token_ids.encoder(tokenizer_file())
    length = {r.doc_id: len(enc.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in c.collect()}
    assert sorted(r.doc_id for r in e) == ids(d) and all(r.n_tokens == length[r.doc_id] for r in e)
    at = 0
    for r in sorted(e, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_take_awkward_rows(spark, clashing, empty):
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, clashing, SMALL)
        assert got.columns == clashing.columns and got.count() >= 1, name
        assert stage(spark, empty, SMALL).count() == 0, name
    assert P.token_ids_of(spark, clashing, SMALL).count() == clashing.count()
    assert P.token_ids_of(spark, empty, SMALL).count() == 0


def test_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
