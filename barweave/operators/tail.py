"""Weights of least CVaR for scenario rows of any size, with a gap that says how near they are to the least."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.operators.optimum import INCOMPLETE, INFEASIBLE, NOT_CONVERGED, OPTIMAL

ROUNDS, CHECKED, GAP = 6000, 50, 0.01  #: the gap is a share of the CVaR


def cvar(losses: np.ndarray, confidence: float) -> float:
    """Value at the confidence level plus the mean excess over it."""
    ordered = np.sort(losses)
    t = ordered[max(1, int(np.ceil(round(len(ordered) * confidence, 9)))) - 1]
    return float(t + np.maximum(losses - t, 0).sum() / ((1 - confidence) * len(losses)))


def worst_mean(returns: np.ndarray, losses: np.ndarray, confidence: float) -> np.ndarray:
    """Slope of the CVaR: mean loss per asset over the worst share of scenarios, the last of them in part."""
    tail = (1 - confidence) * len(losses)
    order = np.argsort(-losses, kind="stable")[: int(np.ceil(round(tail, 9)))]
    share = np.ones(len(order))
    share[-1] = tail - (len(order) - 1)
    return -(share @ returns[order]) / tail


def least_sum(slope: np.ndarray, cap: float) -> float:
    """Least slope'w over weights within the cap."""
    ordered = np.sort(slope)
    return float(ordered @ np.clip(1.0 - cap * np.arange(len(slope)), 0.0, cap))


def _nearest(y: np.ndarray, cap: float) -> np.ndarray:
    lo, hi = y.min() - cap - 1, y.max()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(y - mid, 0, cap).sum() > 1 else (lo, mid)
    w = np.clip(y - (lo + hi) / 2, 0, cap)
    return w / w.sum()


def cvar_weights(scenarios: np.ndarray, confidence: float, cap: float, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, float | None, str]:
    """Weights, gap and status by projected subgradients. The mean of the slopes bounds the CVaR of all weights
    from below, so the gap is a certificate; the search ends once it is a small enough share of the CVaR."""
    t, n = scenarios.shape
    w, cap = np.full(n, 1.0 / n), min(cap, 1.0)
    if n * cap < 1 - 1e-9 or t == 0:
        return w, None, INFEASIBLE if t else INCOMPLETE
    best, least, bound = w, cvar(-scenarios @ w, confidence), -np.inf
    average, slopes, scale = w, np.zeros(n), 1.0
    for k in range(1, rounds + 1):
        slope = worst_mean(scenarios, -scenarios @ w, confidence)
        slopes = slopes + (slope - slopes) * 2 / (k + 1)
        scale = max(scale if k > 1 else 0.0, float(np.linalg.norm(slope - slope.mean())), 1e-12)
        w = _nearest(w - 0.5 / np.sqrt(k) / scale * (slope - slope.mean()), cap)
        average = average + (w - average) * 2 / (k + 2)
        if k % CHECKED == 0 or k == rounds:
            bound = max(bound, least_sum(slopes, cap))
            for x in (w, average):
                if (value := cvar(-scenarios @ x, confidence)) < least:
                    best, least = x, value
            if least - bound <= gap * abs(least):
                break
    return best, least - bound, OPTIMAL if least - bound <= gap * abs(least) else NOT_CONVERGED


def least_cvar(rows: DataFrame, key: Sequence[str], confidence: float = 0.90, cap: float | None = None, item: str = "symbol", rounds: int = ROUNDS) -> DataFrame:
    """(key, item, w, status, gap) of least CVaR for scenario rows of any size."""
    key = list(key)
    base = rows.select(*key, "symbols", "scenarios")
    more = [T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("gap", T.DoubleType()), T.StructField("status", T.StringType())]
    schema = T.StructType([*[base.schema[c] for c in key], base.schema["symbols"], *more])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [cvar_weights(np.array([np.asarray(d, float) for d in s]).reshape(-1, len(n)), confidence, 1.0 if cap is None else cap, rounds) for s, n in zip(pdf["scenarios"], pdf["symbols"])]
            yield pdf[[*key, "symbols"]].assign(w=[d[0] for d in done], gap=pd.Series([d[1] for d in done], dtype="float64", index=pdf.index), status=[d[2] for d in done])

    out = base.mapInPandas(solve, schema).select(*key, "status", "gap", F.explode(F.arrays_zip("symbols", "w")).alias("_z"))
    return out.select(*key, F.col("_z.symbols").alias(item), F.col("_z.w").alias("w"), "status", "gap")
