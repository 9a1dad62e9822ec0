"""Whitening of embedding vectors on the leading components of their covariance.

Three reads of the vectors: count and sums per dimension, products of centred entries, and the projection of
every vector. A task keeps one square matrix as wide as a vector, and such matrices meet by dimension, so
what comes to the driver is one matrix whatever the number of rows. Its leading eigenpairs are found there by
spectrum slicing (`spectrum`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.spectrum import leading

SCALE, OFFSET = 64, 1_000_000
REACH = 1 << 52  #: entries of x end here; beyond it a double has no place for units
COMPONENTS = 32
BLOCK = 8192  #: vectors at a time
LOW = (1 << 26) - 1  #: sums are taken of the lower 26 bits and the rest apart, so that no long overflows


@dataclass
class Fit:
    n: int
    sums: list[int]  #: of x per dimension, exact
    values: np.ndarray  #: falling eigenvalues
    axes: np.ndarray  #: unit eigenvectors in columns
    trace: float
    identity_error: float = 0.0


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is there and has only finite entries.

    Of vectors of several lengths those of the most frequent length stay (ties: the longest), as the
    others have no place in one covariance.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = embeddings.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & finite)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    return rows.filter(F.size("v") == (width.w if width else -1))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_ids, x) of blocks of vectors of one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(SCALE * flat), -REACH, REACH).astype(np.int64) + OFFSET
            yield part.column("vec_id"), x.reshape(part.num_rows, len(flat) // part.num_rows)


def _moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs, or as integers of any size where those do not hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums), 0) if sums else 0
    if most < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviation(moved: np.ndarray) -> pa.Array:
    """Sum of squares per row, exact; null where no long holds it."""
    if moved.dtype != object and (len(moved) == 0 or float((moved.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0**62):
        return pa.array((moved * moved).sum(axis=1), pa.int64())
    total = [sum(int(v) * int(v) for v in row) for row in moved]
    return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, low, high = 0, 0, 0
    for _, x in _matrices(batches):
        n, low, high = n + len(x), low + (x & LOW).sum(axis=0), high + (x >> 26).sum(axis=0)
    if n:
        width = len(low)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width), "low": pa.array(low), "high": pa.array(high)})


def _products(n: int, sums: list[int], axes: np.ndarray | None):
    """Sums of products of centred entries, or of whitened ones, a row for each dimension and task; the last
    row holds the plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            c = _moved(x, n, sums).astype(np.float64) / n
            c = c if axes is None else c @ axes
            if total is None:
                total = np.zeros((c.shape[1] + 1, c.shape[1]))
            total[:-1] += c.T @ c
            total[-1] += c.sum(axis=0)
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "task": pa.array([task] * len(total), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
            row = row.values.to_numpy()
            totals[i] = totals[i] + row if i in totals else row.copy()
    if totals:
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(totals), pa.int32()), "row": pa.array(list(totals.values()), pa.list_(pa.float64()))})


def _covariance(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    partial = rows.mapInArrow(_products(n, sums, axes), "i int, task int, row array<double>")
    # rows of tasks are added in the order of the tasks, so reruns agree to the last bit
    merged = partial.repartition("i").sortWithinPartitions("i", "task").mapInArrow(_merged, "i int, row array<double>")
    got = np.array([r.row for r in sorted(merged.collect())])
    return got[:-1] / n - np.outer(got[-1] / n, got[-1] / n)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """Components of ``rows(vec_id, v)``: as many as asked for, fewer where the covariance has not the rank.

    Whitened vectors are checked once more: ``identity_error`` is the largest absolute entry of their
    covariance minus the identity.
    """
    got = rows.mapInArrow(_sums, "i int, n long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).collect()
    if not got:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = got[0].n, [(r.high << 26) + r.low for r in sorted(got)]
    v = _covariance(rows, n, sums)
    values, axes = leading(v, components)
    found = Fit(n, sums, values, axes, float(np.trace(v)))
    if len(values):
        error = _covariance(rows, n, sums, axes / np.sqrt(values)) - np.eye(len(values))
        found.identity_error = float(np.abs(error).max())
    return found


def whitened(rows: DataFrame, fitted: Fit) -> DataFrame:
    """(vec_id, deviation, whitened array) of every row: its place on each component, in units of its spread."""
    n, sums, scaled = fitted.n, fitted.sums, fitted.axes / np.sqrt(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            moved = _moved(x, n, sums)
            out = (moved.astype(np.float64) / n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "deviation": _deviation(moved), "whitened": lists})

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, deviation long, whitened array<double>")


def components(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened place of every usable row of ``embeddings(vec_id, embedding)`` on each leading component.

    Rows whose vector is null or holds null or non-finite entries are left out; equal rows and equal or null
    vec_ids are rows of their own. Other columns are ignored. An empty table, one vector or equal vectors have
    no component, and so no row. Components are fewer than asked for where the covariance has a lower rank; of
    equal eigenvalues some basis is taken, the same for all rows. ``deviation`` is null where it is beyond a
    long. Entries of x beyond 2^52 stop there.
    """
    rows = usable(embeddings)
    f = fit(rows, most)
    share = F.array(*[F.lit(float(e / f.trace)) for e in f.values]) if len(f.values) else F.array().cast("array<double>")
    placed = whitened(rows, f).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return placed.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation",
        "whitened", share[F.col("at")].alias("explained"), F.lit(f.identity_error).alias("identity_error"),
    )
