"""Shards as runs along a Hilbert curve over several metadata dimensions.

Language, source and size are quantised to levels that keep their order, and the levels of a row are a
point on the curve; neighbours on the curve are near in every dimension, so files cut from it can be
skipped by filters on any of them. Equal texts take the point of the one with the least doc_id, so they
stand together. Runs of equally many rows are the shards. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.ranks import levels, numbered
from barweave.session import settle

SHARDS, BITS = 24, 5


def curve_index(point: list[Column], bits: int = BITS) -> Column:
    """Place of a point along the Hilbert curve (Skilling's transform, 2004): bits * dimensions bits.

    Coordinates are 0 to 2 ** bits - 1.
    """
    n = len(point)
    x = F.array(*[c.cast("long") for c in point])
    zero = F.lit(0).cast("long")

    def turn(x: Column, i: int, q: Column) -> Column:
        """Invert the low bits of coordinate 0 where bit q of coordinate i is set, else exchange them."""
        low = q - 1
        here, first = F.element_at(x, i + 1), F.element_at(x, 1)
        change = F.when(here.bitwiseAND(q) != 0, low).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        both = here.bitwiseAND(q) == 0
        return F.transform(x, lambda v, j: F.when((j == 0) | (both & (j == i)), v.bitwiseXOR(change)).otherwise(v))

    def level(x: Column, q: Column) -> Column:
        # one coordinate after the other; aggregate keeps the steps from nesting into one expression
        return F.aggregate(
            F.array(*[F.lit(i) for i in range(n)]),
            x,
            lambda acc, i: F.element_at(F.array(*[turn(acc, k, q) for k in range(n)]), i + 1),
        )

    highest_first = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    x = F.aggregate(highest_first, x, level)
    # Gray code: running exclusive or over the coordinates
    x = F.aggregate(
        x,
        F.array().cast("array<bigint>"),
        lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero)))),
    )
    spread = lambda x: F.aggregate(
        highest_first, zero, lambda t, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
    )
    x = F.transform(F.array(x), lambda y: F.transform(y, lambda v: v.bitwiseXOR(spread(y))))[0]

    def interleaved(y: Column) -> Column:
        out = zero
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out * 2 + F.shiftright(F.element_at(y, i + 1), b).bitwiseAND(F.lit(1).cast("long"))
        return out

    return F.transform(F.array(x), interleaved)[0]


def sharded(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every row of
    ``docs(doc_id, text, lang, source)``.

    size is the UTF-8 bytes of the text plus 8; a null text has none and counts as an empty one. The law is
    `rows`: shards differ by one row at most. Null languages and sources are the lowest level. Rows
    that repeat each other stand side by side. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("lang").cast("string"),
        F.col("source").cast("string"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    rows = settle(rows)
    same = ["text_key", "text_crc32", "size"]
    heads = rows.groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "lang", "source")).alias("head"))
    heads = heads.select(*same, F.col("head.lang").alias("lang"), F.col("head.source").alias("source"))
    most = 1 << bits
    cuts = [k / most for k in range(1, most)]
    of_sizes = rows.agg(F.percentile_approx("size", cuts, 10_000)).first()[0] or []
    heads = levels(levels(heads, F.col("lang"), most, "x"), F.col("source"), most, "y")
    above = F.aggregate(F.array(*[F.lit(c) for c in of_sizes]), F.lit(0), lambda acc, c: acc + (F.col("size") > c).cast("int")) if of_sizes else F.lit(0)
    heads = heads.select(*same, curve_index([F.col("x"), F.col("y"), above], bits).alias("curve"))
    placed = numbered(rows.drop("lang", "source").join(heads, same), "curve", "text_key", "text_crc32", "doc_id")
    n = rows.count()
    # integer arithmetic: the first row of shard s is the least p with p * shards >= s * n
    shard = F.expr(f"cast(place * {shards} div {max(1, n)} as int)")
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
