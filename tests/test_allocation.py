from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import allocation as A
from barweave.operators.optimum import optimum
from barweave.plans import walkforward as B

GRID = np.array([(a, b, 10 - a - b) for a in range(11) for b in range(11 - a)]) / 10


@pytest.fixture(scope="module")
def problems():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 252, 3)) * 0.01
    return x.mean(1) * 252, np.einsum("bti,btj->bij", x, x) / 251 * 252


def score(w, mu, cov, ent, pen, prev):
    e = ((w + 1e-8) * np.log(w + 1e-8)).sum(-1)
    return np.einsum("...k,bk->b...", w, mu) - 0.5 * np.einsum("...i,bij,...j->b...", w, cov, w) - ent * e - pen * ((w - prev) ** 2).sum(-1)


@pytest.mark.parametrize("cap,ent,pen,limit", [(1.0, 0, 0, np.inf), (0.5, 0.03, 0, np.inf), (0.6, 0.0, 0.1, 0.3), (0.6, 0.02, 0.0, 0.3)])
def test_optimum_is_no_worse_than_the_grid(spark, problems, cap, ent, pen, limit):
    mu, cov = problems
    b = len(mu)
    prev = np.array([0.4, 0.3, 0.3])
    rows = problem_rows(spark, mu, cov).withColumn("prev", F.array(*[F.lit(float(x)) for x in prev]))
    asked = {"cap": cap, "entropy": float(ent), "turnover_penalty": float(pen), "max_turnover": None if limit == np.inf else limit}
    got = optimum(rows.withColumns({k: F.lit(v).cast("double") for k, v in asked.items()}), ["id"]).orderBy("id").collect()
    w = np.array([r.w for r in got])
    assert {r.status for r in got} == {"optimal"} and np.allclose(w.sum(1), 1) and w.min() >= 0 and w.max() <= cap + 1e-9
    assert np.abs(w - prev).sum(1).max() <= limit + 1e-8
    own = np.array([score(w[k], mu[k : k + 1], cov[k : k + 1], ent, pen, prev)[0] for k in range(b)])
    fits = (GRID.max(1) <= cap + 1e-9) & (np.abs(GRID - prev).sum(1) <= limit + 1e-9)
    best = score(GRID[fits], mu, cov, ent, pen, prev).max(1)
    assert (own >= best - 1e-9).all()
    # the gap bounds what any weights can gain: also those of the grid
    assert (np.array([r.gap for r in got]) >= best - own - 1e-12).all() and max(r.gap for r in got) < 1e-7


def test_sweep_frontier_and_infeasible(spark, problems):
    mu, cov = problems
    rows = [(k, ["a", "b", "c"], mu[k].tolist(), cov[k].ravel().tolist(), c, t) for k in range(5) for c, t in ((None, 0.0), (0.3, None), (None, 9.0))]
    df = spark.createDataFrame(rows, "id int, symbols array<string>, mu array<double>, cov array<double>, cap double, target double")
    out = optimum(df, ["id"]).collect()
    assert len(out) == 15
    for r in out:
        infeasible = r["cap"] is not None or r["target"] > max(mu[r["id"]])
        assert (r["status"] == "infeasible") == infeasible
        if infeasible:
            assert np.allclose(r["w"], 1 / 3)
        else:
            assert r["ret"] >= -1e-9 and np.isclose(sum(r["w"]), 1)


def frame(spark, weights):
    rows = [("s", k, n, float(v)) for k, w in enumerate(weights) for n, v in zip("abc", w)]
    return spark.createDataFrame(rows, "strategy string, window_id long, symbol string, w double")


def test_turnover_and_holdings(spark):
    w = frame(spark, [(0.4, 0.3, 0.3), (0.5, 0.3, 0.2)])
    assert [round(r["turnover"], 9) for r in B.half_l1_turnover(w).collect()] == [0.1]
    assert [round(r["turnover"], 9) for r in B.l1_turnover(w).collect()] == [0.2]
    enh = {r["window_id"]: r["enh"] for r in A.effective_holdings(w, ["strategy", "window_id"]).collect()}
    assert abs(enh[1] - 2.800094) < 1e-6


def test_inverse_vol_cap_is_applied_once(spark):
    day = date(2024, 1, 1)
    rows = [("p", s, day + timedelta(t), float(v * (1 if t % 2 else -1) / np.sqrt(252) * np.sqrt(7 / 8))) for s, v in (("a", 0.1), ("b", 0.2), ("c", 0.4)) for t in range(8)]
    df = spark.createDataFrame(rows, "id string, symbol string, dt date, ret double")
    plain = {r["symbol"]: r["w"] for r in A.inverse_vol_weights(df, ["id"]).collect()}
    capped = {r["symbol"]: r["w"] for r in A.inverse_vol_weights(df, ["id"], cap=0.5).collect()}
    assert np.allclose([plain[s] for s in "abc"], [0.571429, 0.285714, 0.142857], atol=1e-6)
    assert np.allclose([capped[s] for s in "abc"], [0.538462, 0.307692, 0.153846], atol=1e-6)


def test_cvar_of_known_losses(spark):
    df = spark.createDataFrame([("p", v) for v in (-0.03, -0.02, -0.01, 0.0, 0.01)], "portfolio_id string, ret double")
    assert abs(A.cvar_of_portfolio(df, confidence=0.8).first()["cvar"] - 0.03) < 1e-9
    assert abs(A.cvar_of_portfolio(df, confidence=0.6).first()["cvar"] - 0.025) < 1e-9


def test_windows_are_ordered_and_disjoint(spark):
    days = spark.createDataFrame([(date(2015, 1, 1) + timedelta(k),) for k in range(0, 2000) if k % 7 < 5], "dt date")
    rows = B.walk_forward_windows(days).orderBy("window_id").collect()
    assert len(rows) == 6
    for r in rows:
        assert r["train_start"] < r["train_end"] < r["test_end"]
    for a, b in zip(rows, rows[1:]):
        assert b["train_start"] == a["test_end"] + timedelta(1)


def test_chain_stays_within_the_turnover_limit(spark, problems):
    mu, cov = problems
    rows = [(u, k, ["a", "b", "c"], mu[k + 10 * u].tolist(), cov[k + 10 * u].ravel().tolist()) for u in range(2) for k in range(6)]
    df = spark.createDataFrame(rows, "u int, window_id long, symbols array<string>, mu array<double>, cov array<double>")
    out = A.mv_chain(df, ["u"], 3, cap=0.6, max_turnover=0.4).collect()
    for u in range(2):
        prev = None
        for k in range(6):
            got = {r["symbol"]: r["w"] for r in out if r["u"] == u and r["window_id"] == k}
            w = np.array([got[s] for s in "abc"])
            fits = GRID.max(1) <= 0.6 + 1e-9
            if prev is not None:
                assert np.abs(w - prev).sum() <= 0.4 + 1e-9
                fits &= np.abs(GRID - prev).sum(1) <= 0.4 + 1e-9
            s = score(GRID[fits], mu[k + 10 * u][None], cov[k + 10 * u][None], 0, 0, 0)[0]
            assert np.isclose(score(w, mu[k + 10 * u][None], cov[k + 10 * u][None], 0, 0, 0)[0], s.max())
            prev = w


def test_higher_costs_never_help(spark):
    w = frame(spark, [(0.4, 0.3, 0.3), (0.7, 0.2, 0.1)])
    test = spark.createDataFrame([(k, s, date(2024, 1 + k, d), 0.01) for k in range(2) for s in "abc" for d in (1, 2)], "window_id long, symbol string, dt date, ret double")
    net = B.cost_sensitivity(test, w, B.half_l1_turnover(w), [1.0, 7.5, 20.0]).groupBy("bps").sum("ret").orderBy("bps").collect()
    totals = [r[1] for r in net]
    assert totals == sorted(totals, reverse=True) and totals[0] > totals[-1]


def problem_rows(spark, mu, cov, **more):
    rows = [(k, [f"s{i:03d}" for i in range(len(m))], m.tolist(), c.ravel().tolist(), *more.values()) for k, (m, c) in enumerate(zip(mu, cov))]
    extra = "".join(f", {n} array<double>" for n in more)
    return spark.createDataFrame(rows, "id int, symbols array<string>, mu array<double>, cov array<double>" + extra)


def market(n, b=3, days=600, seed=1):
    x = np.random.default_rng(seed).normal(size=(b, days, n)) * 0.01
    return x, x.mean(1) * 252, np.einsum("bti,btj->bij", x, x) / (days - 1) * 252


@pytest.mark.parametrize("n,cap", [(3, 0.35), (8, 0.18), (25, 0.18), (100, 0.05)])
def test_any_size_and_cap(spark, n, cap):
    _, mu, cov = market(n)
    got = A.mv_best(problem_rows(spark, mu, cov), ["id"], cap=cap, entropy=0.01).toPandas()
    assert set(got["status"]) == {"optimal"} and len(got) == 3 * n
    assert np.allclose(got.groupby("id").w.sum(), 1) and got.w.max() <= cap + 1e-9 and got.w.min() >= 0


def test_infeasible_cap_and_wrong_size_say_so(spark):
    _, mu, cov = market(4)
    rows = problem_rows(spark, mu, cov)
    assert {(r.status, r.w) for grid in (4, None) for r in A.mv_best(rows, ["id"], grid, cap=0.22).collect()} == {("infeasible", 0.25)}
    with pytest.raises(Exception, match="the grid is for 3 assets"):
        A.mv_best(rows, ["id"], 3).collect()
    short = rows.withColumn("cov", F.slice("cov", 1, 15))
    assert {r.status for r in A.mv_best(short, ["id"]).collect()} == {"incomplete"}


def test_target_and_turnover_together(spark):
    rows = spark.createDataFrame([(0, ["a", "b"], [0.1, 0.2], [0.04, 0.0, 0.0, 0.09], [0.5, 0.5])], "id int, symbols array<string>, mu array<double>, cov array<double>, prev array<double>")
    for target, limit, fits in ((0.15, 0.5, True), (0.17, 0.5, True), (0.18, 0.5, False), (0.175, 0.5, True)):
        got = optimum(rows.withColumns({"target": F.lit(target), "max_turnover": F.lit(limit)}), ["id"]).first()
        assert (got.status == "infeasible") != fits
        if fits:
            assert got.ret >= target - 1e-6 and abs(got.w[0] - 0.5) * 2 <= limit + 1e-6
    # against a fine grid in three assets
    _, mu, cov = market(3, b=1, seed=4)
    prev, cap, limit = np.array([0.2, 0.3, 0.5]), 0.7, 0.4
    fine = np.array([(i, j, 200 - i - j) for i in range(201) for j in range(201 - i)]) / 200
    fine = fine[(fine.max(1) <= cap) & (np.abs(fine - prev).sum(1) <= limit)]
    target = np.quantile(fine @ mu[0], 0.8)
    asked = problem_rows(spark, mu, cov).withColumns({"prev": F.array(*[F.lit(float(x)) for x in prev]), "cap": F.lit(cap), "max_turnover": F.lit(limit), "target": F.lit(float(target))})
    w = np.array([optimum(asked, ["id"]).first().w])
    risk = np.einsum("ki,ij,kj->k", fine, cov[0], fine)[fine @ mu[0] >= target].min()
    assert w[0] @ mu[0] >= target - 1e-6 and np.abs(w[0] - prev).sum() <= limit + 1e-6 and w[0] @ cov[0] @ w[0] <= risk + 1e-6


def test_a_run_that_is_cut_short_says_so(spark):
    _, mu, cov = market(40)
    rows = problem_rows(spark, mu, cov)
    assert "not_converged" in {r.status for r in optimum(rows, ["id"], rounds=2).collect()}


def test_chain_of_any_size(spark):
    _, mu, cov = market(20, b=5)
    rows = problem_rows(spark, mu, cov).withColumn("universe", (F.col("id") >= 3).cast("int")).withColumnRenamed("id", "window_id")
    got = A.mv_chain(rows, ["universe"], cap=0.18, max_turnover=0.2).toPandas().pivot(index="window_id", columns="symbol", values="w")
    assert np.allclose(got.sum(axis=1), 1) and got.to_numpy().max() <= 0.18 + 1e-9
    moved = got.diff().abs().sum(axis=1)
    assert moved[[1, 2, 4]].max() <= 0.2 + 1e-6


def test_cvar_of_any_size_and_incomplete_dates(spark):
    from barweave.operators.tail import cvar, cvar_weights, least_sum

    x, _, _ = market(3, b=1, days=300)
    best = min(cvar(-x[0] @ g, 0.9) for g in GRID)
    w, gap, status = cvar_weights(x[0], 0.9, 1.0)
    assert cvar(-x[0] @ w, 0.9) <= best * 1.01 and status == "optimal" and cvar(-x[0] @ w, 0.9) - gap <= best and 0 <= gap <= 0.01 * best
    assert cvar_weights(x[0], 0.9, 1.0, rounds=1)[2] == "not_converged" and least_sum(np.array([3.0, 1.0, 2.0]), 0.6) == 0.6 + 0.8
    x, _, _ = market(12, b=1, days=80)
    rows = [(0, d, f"s{i:02d}", float(v)) for d, day in enumerate(x[0]) for i, v in enumerate(day) if (d, i) not in {(3, 4), (7, 0)}]
    s = A.scenarios(spark.createDataFrame(rows, "id int, dt int, symbol string, ret double"), ["id"])
    one = s.first()
    assert len(one.scenarios) == 78 and {len(d) for d in one.scenarios} == {12}
    got = A.min_cvar(s, ["id"], cap=0.18).toPandas()
    assert np.isclose(got.w.sum(), 1) and got.w.max() <= 0.18 + 1e-9 and set(got["status"]) == {"optimal"}
