"""Worst fall from a peak of series of any length, from states of pieces that merge.

A piece of a series is described by its growth, its highest and lowest level and its worst fall, all counted
from the level at its start. Pieces in order merge to the state of the whole, so a series is cut into the ranges
of a range partitioning, each task walks its rows once, and what meets afterwards is a row for each key and range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = ("growth", "high", "low", "worst")


def _merge(a: tuple | None, b: tuple) -> tuple:
    """State of one piece followed by another."""
    if a is None:
        return b
    growth, high, low, worst = a
    g, h, lo, w = b
    # a level of the second piece is measured against the peak so far, of either piece
    fall = growth * lo / high if high > 0 else np.inf
    return growth * g, max(high, growth * h), min(low, growth * lo), min(worst, w, fall)


def _state(ret: np.ndarray) -> tuple:
    level = np.cumprod(1.0 + ret)
    peak = np.maximum.accumulate(level)
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = np.where(peak > 0, level / peak, np.inf)
    return float(level[-1]), float(peak[-1]), float(level.min()), float(fall.min())


def _walk(width: int):
    """A row (key, part, state) for every run of a key in the sorted rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held_key, held = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.select(list(range(width)))
            coded = [keys.column(k).dictionary_encode() for k in range(width)]
            codes = np.stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in coded], axis=1) if width else np.zeros((n, 1), int)
            starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]).any(axis=1))))
            ret = batch.column(width).to_numpy(zero_copy_only=False)
            done: list[tuple[pa.RecordBatch, tuple]] = []
            for a, b in zip(starts, [*starts[1:], n]):
                key = keys.slice(a, 1)
                state = _state(ret[a:b])
                if held_key is not None and key.equals(held_key):
                    held = _merge(held, state)
                    continue
                if held_key is not None:
                    done.append((held_key, held))
                held_key, held = key, state
            if done:
                yield _rows(done, part)
        if held_key is not None:
            yield _rows([(held_key, held)], part)

    def _rows(done: list, part: int) -> pa.RecordBatch:
        keys = pa.Table.from_batches([k for k, _ in done]).combine_chunks() if width else None
        columns = [keys.column(k).combine_chunks() for k in range(width)] + [pa.array([part] * len(done), pa.int32())]
        columns += [pa.array([s[k] for _, s in done], pa.float64()) for k in range(4)]
        names = [*(keys.schema.names if width else []), "_part", *STATE]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return run


def worst_falls(returns: DataFrame, key: Sequence[str], order: str, ret: str = "ret") -> DataFrame:
    """(key, max_drawdown): the largest fall of the compounded level of each key below its peak so far.

    The peak starts at the first level. Returns are meant to be above -1. Rows without a return are left out; a key without returns gives null.
    """
    key = list(key)
    known = returns.select(*key, order, F.col(ret).cast("double").alias("_r")).filter(F.col("_r").isNotNull())
    ranged = known.repartitionByRange(*key, order).sortWithinPartitions(*key, order).select(*key, "_r")
    kinds = dict(ranged.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "_part int", *(f"{s} double" for s in STATE)])
    parts = ranged.mapInArrow(_walk(len(key)), schema)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    growth = F.coalesce(F.product("growth").over(before), F.lit(1.0))
    placed = parts.withColumn("_growth", growth).withColumn("_high", F.col("_growth") * F.col("high"))
    peak = F.max("_high").over(before)
    fall = F.least("worst", F.when(peak > 0, F.col("_growth") * F.col("low") / peak))
    return placed.withColumn("_fall", fall).groupBy(*key).agg((F.min("_fall") - 1).alias("max_drawdown"))
