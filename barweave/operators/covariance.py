"""Pairwise moments, covariance and correlation matrices in long form (group, i, j, value).

The matrix product is taken per batch of dates inside Arrow tasks and only the sums of each batch
are shuffled. Rows of a date are never joined to themselves, so the shuffle carries one row per
pair and batch instead of one per pair and date.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.exprs import ratio
from barweave.schemas import TRADING_DAYS
from barweave.session import settle

TILE = 1024  # items per side of one partial product held in memory
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _tiles(names: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, n_rows: int) -> Iterator[pd.DataFrame]:
    """Sums of all pairs from (date, item, value) triples; only two tiles of items are dense at a time."""
    order = np.argsort(col, kind="stable")
    row, col, val = row[order], col[order], val[order]

    def dense(a: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(col, [a, a + TILE])
        shape = (n_rows, min(TILE, len(names) - a))
        x, seen = np.zeros(shape), np.zeros(shape)
        x[row[lo:hi], col[lo:hi] - a] = val[lo:hi]
        seen[row[lo:hi], col[lo:hi] - a] = 1.0
        return x, seen

    for a in range(0, len(names), TILE):
        xa, ma = dense(a)
        for b in range(a, len(names), TILE):
            xb, mb = (xa, ma) if a == b else dense(b)
            n = ma.T @ mb
            keep = n > 0
            if a == b:
                keep &= np.tri(*n.shape, dtype=bool).T
            i, j = np.nonzero(keep)
            sums = [n, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb]
            yield pd.DataFrame({"i": names[a + i], "j": names[b + j], **{c: s[i, j] for c, s in zip(_SUMS, sums)}})


def pair_sums(df: DataFrame, item: str = "symbol", on: str = "dt", value: str = "ret", group: Sequence[str] = ()) -> DataFrame:
    """(group, i, j, n, sums) over the dates both items have, for i <= j.

    One date of one group is a vector with a value per item; its size is that of the universe.
    """
    group = list(group)
    days = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, on)
        .agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).alias("v"))).alias("_row"))
        .select(*group, F.transform("_row", lambda s: s["i"]).alias("_i"), F.transform("_row", lambda s: s["v"]).alias("_v"))
    )
    schema = T.StructType(
        [days.schema[g] for g in group]
        + [T.StructField(c, df.schema[item].dataType) for c in ("i", "j")]
        + [T.StructField(c, T.DoubleType()) for c in _SUMS]
    )
    n_group = len(group)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(n_group)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            codes, names = pd.factorize(lists.flatten().to_pandas(), sort=True)
            vals = batch.column(n_group + 1).flatten().to_numpy(zero_copy_only=False)
            groups = batch.select(list(range(n_group))).to_pandas() if n_group else None
            gid = groups.groupby(group, sort=False, dropna=False).ngroup().to_numpy() if n_group else np.zeros(batch.num_rows, int)
            for g in range(gid.max() + 1):
                days_of = np.flatnonzero(gid == g)
                mine = gid[row] == g
                used, col = np.unique(codes[mine], return_inverse=True)
                for part in _tiles(np.asarray(names)[used], np.searchsorted(days_of, row[mine]), col, vals[mine], len(days_of)):
                    for k, c in enumerate(group):
                        part.insert(k, c, groups[c].iloc[days_of[0]])
                    yield pa.RecordBatch.from_pandas(part, schema=batch_schema(batch), preserve_index=False)

    def batch_schema(batch: pa.RecordBatch) -> pa.Schema:
        item_type = batch.column(n_group).type.value_type
        return pa.schema(
            [batch.schema.field(k) for k in range(n_group)]
            + [pa.field(c, item_type) for c in ("i", "j")]
            + [pa.field(c, pa.float64()) for c in _SUMS]
        )

    partial = days.mapInArrow(products, schema)
    return partial.groupBy(*group, "i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def mirror(pairs: DataFrame) -> DataFrame:
    """Both triangles from the upper one; columns other than i, j are kept."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return pairs.select(*rest, F.explode(both).alias("_ij")).select(*rest, "_ij.*")


def correlation_matrix(df: DataFrame, item: str = "symbol", on: str = "dt", value: str = "ret", group: Sequence[str] = ()) -> DataFrame:
    """(group, i, j, corr) over pairwise complete dates."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    s = pair_sums(df, item, on, value, group)
    return mirror(s.select(*group, "i", "j", ratio(cov, F.sqrt(vx * vy)).alias("corr")).withColumn(
        "corr", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "corr"))))


def cov_sample(df: DataFrame, item: str = "symbol", on: str = "dt", value: str = "ret", group: Sequence[str] = (),
               days: int = TRADING_DAYS) -> DataFrame:
    """(group, i, j, cov): sample covariance x days."""
    n = F.col("n")
    cov = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, n - 1) * days
    return mirror(pair_sums(df, item, on, value, group).select(*group, "i", "j", cov.alias("cov")))


_STATE = ["n", "width", "quart", "mean_i", "mean_j", "s", "cubic"]


def _moment_states(days: DataFrame, group: list[str], item_type: T.DataType) -> DataFrame:
    """States of batches of dates: (group, part, i, j, ...) for i <= j, counted from the batch's own means.

    ``s`` sums the products, ``cubic`` x_i |x|^2 (on i = j) and ``quart`` |x|^4 of the centred vectors x. Dates of
    fewer items than the batch's widest cannot be complete and only name their items (n = 0).
    """
    n_group = len(group)
    schema = T.StructType([days.schema[g] for g in group] + [T.StructField("part", T.LongType())] + [T.StructField(c, item_type) for c in ("i", "j")] + [T.StructField(c, T.DoubleType()) for c in _STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, values = batch.column(n_group), batch.column(n_group + 1)
            groups = batch.select(list(range(n_group))).to_pandas() if n_group else None
            gid = groups.groupby(group, sort=False, dropna=False).ngroup().to_numpy() if n_group else np.zeros(batch.num_rows, int)
            for g in range(gid.max() + 1):
                part += 1
                mine = np.flatnonzero(gid == g)
                frame = _batch_state([lists[int(k)].as_py() for k in mine], [values[int(k)].values.to_numpy(zero_copy_only=False) for k in mine])
                frame.insert(0, "part", part)
                for k, c in enumerate(group):
                    frame.insert(k, c, groups[c].iloc[mine[0]])
                fields = [batch.schema.field(k) for k in range(n_group)] + [pa.field("part", pa.int64())] + [pa.field(c, lists.type.value_type) for c in ("i", "j")] + [pa.field(c, pa.float64()) for c in _STATE]
                yield pa.RecordBatch.from_pandas(frame, schema=pa.schema(fields), preserve_index=False)

    return days.mapInArrow(run, schema)


def _batch_state(names: list[list], values: list[np.ndarray]) -> pd.DataFrame:
    """State of some dates of one group; ``names`` are sorted within a date."""
    width = max(map(len, names))
    wide = [k for k, n in enumerate(names) if len(n) == width]
    every = sorted({x for n in names for x in n})
    known = pd.DataFrame({"i": every, "j": every}).assign(**dict.fromkeys(_STATE, 0.0))
    if len(every) > width:  # no date has all items seen here, so none is complete
        return known
    x = np.stack([values[k] for k in wide])
    mean = x.mean(axis=0)
    x = x - mean
    drift = x.mean(axis=0)  # what rounding of the mean left
    mean, x = mean + drift, x - drift
    square = (x * x).sum(axis=1)
    products, cubic = x.T @ x, x.T @ square
    i, j = np.triu_indices(width)
    named = np.array(every, object)
    return pd.DataFrame({
        "i": named[i], "j": named[j], "n": float(len(wide)), "width": float(width), "quart": float((square * square).sum()),
        "mean_i": mean[i], "mean_j": mean[j], "s": products[i, j], "cubic": np.where(i == j, cubic[i], 0.0),
    })


def _shrinkage_inputs(df: DataFrame, item: str, on: str, value: str, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs with population covariance, statistics with the sum of |x - mean|^4), from one read of the rows.

    Only dates on which every item of the group has a value count; a group without such a date raises. States
    of batches are moved to the common mean before they are added, so values at the level of prices do not cancel.
    """
    days = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, on)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v")))).alias("_row"))
        .select(*group, F.transform("_row", lambda s: s["i"]).alias("_i"), F.transform("_row", lambda s: s["v"]).alias("_v"))
    )
    # without a group the whole panel is one matrix; a constant key lets the same plan serve both
    own = ["_k", *group]
    states = settle(_moment_states(days, group, df.schema[item].dataType).withColumn("_k", F.lit(0)))
    p = states.groupBy(*own).agg(F.count_distinct("i").cast("double").alias("p"), F.max(F.when(F.col("n") > 0, F.col("width"))).alias("_width"))
    none = F.raise_error(F.lit("shrinkage needs dates on which all items have a value")).cast("double")
    p = p.select(*own, F.when(F.col("_width") == F.col("p"), F.col("p")).otherwise(none).alias("p"))
    full = states.join(p, own).filter((F.col("n") > 0) & (F.col("width") == F.col("p")))
    diagonal = F.col("i") == F.col("j")
    means = full.filter(diagonal).groupBy(*own, "i").agg((F.sum(F.col("n") * F.col("mean_i")) / F.sum("n")).alias("_m"))
    moved = full.join(means.withColumnRenamed("_m", "_mi"), [*own, "i"]).join(means.select(*own, F.col("i").alias("j"), F.col("_m").alias("_mj")), [*own, "j"])
    moved = moved.withColumns({"_di": F.col("mean_i") - F.col("_mi"), "_dj": F.col("mean_j") - F.col("_mj")})
    shift = F.col("_di") * F.col("_dj")
    pop = mirror(moved.groupBy(*own, "i", "j").agg(F.sum("n").alias("n"), (F.sum(F.col("s") + F.col("n") * shift) / F.sum("n")).alias("s")))
    own_row = lambda c: F.sum(F.when(diagonal, c).otherwise(0.0))
    parts = moved.groupBy(*own, "part").agg(
        F.first("n").alias("n"), F.first("quart").alias("quart"), F.sum(F.col("s") * shift * F.when(diagonal, 1.0).otherwise(2.0)).alias("dsd"),
        own_row(F.col("_di") * F.col("_di")).alias("dd"), own_row(F.col("cubic") * F.col("_di")).alias("cd"), own_row(F.col("s")).alias("ss"),
    )
    # |x + d|^4 = (|x|^2 + 2 d'x + |d|^2)^2, summed over centred x
    quart = F.col("quart") + 4 * F.col("dsd") + F.col("n") * F.col("dd") * F.col("dd") + 4 * F.col("cd") + 2 * F.col("dd") * F.col("ss")
    fourth = parts.groupBy(*own).agg(F.sum(quart).alias("_qq"))
    trace = F.sum(F.when(diagonal, F.col("s")))
    stats = pop.groupBy(*own).agg(
        F.max("n").alias("t"), F.count(F.when(diagonal, 1)).cast("double").alias("p"), trace.alias("trace"), F.sum(F.col("s") * F.col("s")).alias("ss")
    )
    return pop, stats.withColumn("m", F.col("trace") / F.col("p")).join(fourth, own)


def _shrink(keyed: DataFrame, stats: DataFrame, group: list[str], days: int) -> DataFrame:
    a = F.col("shrinkage")
    target = F.when(F.col("i") == F.col("j"), a * F.col("m")).otherwise(F.lit(0.0))
    return keyed.join(stats.select("_k", *group, "m", "shrinkage"), ["_k", *group]).select(
        *group, "i", "j", (((1 - a) * F.col("s") + target) * days).alias("cov"), "shrinkage"
    )


def cov_ledoit_wolf(df: DataFrame, item: str = "symbol", on: str = "dt", value: str = "ret", group: Sequence[str] = (),
                    days: int = TRADING_DAYS) -> DataFrame:
    """Shrinkage towards m * I with the Ledoit-Wolf (2004) intensity, over the complete dates of the panel."""
    group = list(group)
    keyed, stats = _shrinkage_inputs(df, item, on, value, group)
    m, p, t = F.col("m"), F.col("p"), F.col("t")
    delta = (F.col("ss") - 2 * m * F.col("trace") + p * m * m) / p
    beta = (F.col("_qq") / t - F.col("ss")) / (p * t)
    s = stats.withColumn("shrinkage", F.when(delta > 0, F.least(beta, delta) / delta).otherwise(F.lit(0.0)))
    return _shrink(keyed, s, group, days)


def cov_oas(df: DataFrame, item: str = "symbol", on: str = "dt", value: str = "ret", group: Sequence[str] = (),
            days: int = TRADING_DAYS) -> DataFrame:
    """Oracle approximating shrinkage (Chen et al. 2010) towards m * I, over the complete dates of the panel."""
    group = list(group)
    keyed, stats = _shrinkage_inputs(df, item, on, value, group)
    m, p, t = F.col("m"), F.col("p"), F.col("t")
    mean_sq = F.col("ss") / (p * p)
    num, den = mean_sq + m * m, (t + 1) * (mean_sq - m * m / p)
    s = stats.withColumn("shrinkage", F.when(den == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), num / den)))
    return _shrink(keyed, s, group, days)


COVARIANCES = {"sample": cov_sample, "ledoit_wolf": cov_ledoit_wolf, "oas": cov_oas}


def portfolio_moments(weights: DataFrame, mu: DataFrame, cov: DataFrame, key: Sequence[str] = ("portfolio_id",),
                      match: Sequence[str] = (), item: str = "symbol", rf: float = 0.02) -> DataFrame:
    """Expected return, volatility and Sharpe ratio of each portfolio.

    ``match`` names group columns shared by weights, mu and cov. Sigma w is summed per (portfolio, i)
    before it meets the weights again.
    """
    key, match = list(key), list(match)
    own = list(dict.fromkeys([*key, *match]))
    w = weights.select(*own, item, "w")
    ret = w.join(mu.select(*match, item, "mu"), [*match, item]).groupBy(*own).agg(F.sum(F.col("w") * F.col("mu")).alias("expected_return"))
    sw = (
        w.withColumnRenamed(item, "j")
        .join(cov.select(*match, "i", "j", "cov"), [*match, "j"])
        .groupBy(*own, "i")
        .agg(F.sum(F.col("w") * F.col("cov")).alias("_sw"))
        .withColumnRenamed("i", item)
    )
    var = w.join(sw, [*own, item]).groupBy(*own).agg(F.sum(F.col("w") * F.col("_sw")).alias("_var"))
    vol = F.sqrt(F.greatest(F.col("_var"), F.lit(0.0)))
    return ret.join(var, own).select(
        *own,
        "expected_return",
        vol.alias("expected_volatility"),
        ((F.col("expected_return") - rf) / F.greatest(vol, F.lit(1e-8))).alias("sharpe_ratio"),
    )
