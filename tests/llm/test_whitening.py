import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import whitening
from barweave.llm.queries import QUERIES
from barweave.llm.spectrum import Factors, leading

ROWS = "vec_id long, embedding array<float>, n string, v string"


def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    for d in (1, 2, 7, 40):
        x = rng.standard_normal((300, d)) * np.linspace(1, 4, d)
        yield np.cov(x.T).reshape(d, d)
    yield q @ np.diag([9.0] * 5 + [4.0] * 8 + [1.0] * 11) @ q.T  # equal eigenvalues
    yield q @ np.diag(1 + 1e-9 * np.arange(24)) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(24)) @ q.T
    yield np.cov(rng.standard_normal((4, 24)).T)  # low rank
    yield np.diag([5.0, 5, 3, 3, 0, 0])
    yield np.array([[0.0, 2.0], [2.0, 0.0]])  # indefinite, zero diagonal


def test_leading_pairs_against_a_dense_solver():
    for v in matrices():
        values, axes = leading(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        norm = np.abs(want).max()
        assert len(values) == min(16, int((want > 1e-13 * norm).sum())) and (np.diff(values) <= 1e-13 * norm).all()
        assert np.abs(values - want[: len(values)]).max() < 1e-13 * norm
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-9
        assert np.abs(v @ axes - axes * values).max() < 1e-13 * norm
    assert len(leading(np.zeros((3, 3)), 2)[0]) == len(leading(np.zeros((0, 0)), 2)[0]) == 0


def test_inertia_and_solutions_of_shifted_matrices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a = rng.integers(-3, 4, (9, 9)).astype(float)
        a += a.T
        shift = float(rng.normal())
        f = Factors(a - shift * np.eye(9))
        assert f.above() == (np.linalg.eigvalsh(a) > shift).sum()
        b = rng.standard_normal(9)
        assert np.abs((a - shift * np.eye(9)) @ f.solve(b, 1e-300) - b).max() < 1e-8


def plain(vectors, most=32):
    """x, exact deviations, whitened and explained by a dense solver on the whole list."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    moved = [[n * a - s for a, s in zip(r, sums)] for r in x]
    c = np.array(moved, float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    k = min(most, int((e > 1e-12 * e[-1]).sum()))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum(a * a for a in r) for r in moved], c @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_a_dense_solver(spark, name):
    rows = sorted(QUERIES["op11_embedding_whitening"](spark, f"/root/testdata/{name}").collect())
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").select("vec_id", "embedding").collect()}
    ids = sorted(given)
    deviation, white, share = plain([given[i] for i in ids])
    k = len(share)
    assert [(r.vec_id, r.component) for r in rows] == [(i, c + 1) for i in ids for c in range(k)]
    assert all(r.n == len(ids) and r.deviation == deviation[at // k] for at, r in enumerate(rows))
    got = np.array([r.whitened for r in rows]).reshape(len(ids), k)
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert np.abs(np.array([r.explained for r in rows[:k]]) / share - 1).max() < 1e-10
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(c) for c in rng.normal(size=6)], "x", "y") for k in range(40)]
    good += [(7, good[7][1], "x", "y"), (None, good[3][1], None, None)]
    bad = [(100, None, "x", "y"), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", "y"), (102, [float("nan")] + [0.0] * 5, "x", "y"), (103, [float("inf")] + [0.0] * 5, "x", "y"), (104, [-float("inf")] + [0.0] * 5, "x", "y"), (105, [], "x", "y"), (106, [1.0], "x", "y")]
    got = whitening.components(spark.createDataFrame(good + bad, ROWS).repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 6 * 42 and {r.n for r in rows} == {42} and rows[0].identity_error < 1e-10
    float32 = [[float(np.float32(c)) for c in g[1]] for g in good]
    deviation, white, _ = plain(float32)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in rows), sorted(np.abs(white).ravel()), atol=1e-9)
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    for rows in (good[:0], good[:1], [good[0]] * 3, bad[:5]):
        assert whitening.components(spark.createDataFrame(rows, ROWS)).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(k, [float(k) * 2.0**40, 1.0 - k * k]) for k in range(9)]
    got = {r.vec_id: r.deviation for r in whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want, _, _ = plain([v for _, v in rows])
    assert got == {k: w if w < 1 << 63 else None for k, w in enumerate(want)}


def test_any_split_gives_the_same(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = (whitening.components(d).groupBy("component").agg(F.sum(F.abs("whitened")).alias("s")).orderBy("component").collect() for d in (rows.coalesce(1), rows.repartition(7)))
    assert len(one) == 32 and all(abs(a.s - b.s) < 1e-7 for a, b in zip(one, many, strict=True))
