"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id. A source's part is all of its documents some whole number of
times, and once more those whose hash is at most a threshold. The threshold is found from sums of
words per source and hash bucket: the bucket in which the budget ends is cut into buckets of its own,
five times, until it is a single hash. Nothing is sorted, and a larger budget contains a smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.ranks import numbered, unused
from barweave.session import settle

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
LEVEL_BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """60 bits of a hash of the id; rows of one id (or of none) share theirs and are taken together."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target from ``rows(source, size)``.

    Sources in code point order, null last, have the weights in turn. A target stops at ``most`` times its
    source's size; what is beyond goes to the others by weight, until none is above.
    """
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull()))
    turn = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = settle(numbered(sizes, "_last", "source").withColumn("weight", weight).select("source", "source_size", "weight"))
    cap = F.col("source_size") * float(most)
    whole = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # a scalar a round; the level only rises, so each round caps further sources or is the last
        full = (F.col("weight") * level > cap) if level else F.lit(False)
        capped, free, n = ranked.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        now = (whole - capped) / free if free else level
        if now == level:
            break
        level = now
    share_of = F.col("weight") * level
    return ranked.select("source", "source_size", F.when(share_of > cap, cap).otherwise(share_of).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, times (whole passes) and cut (hashes up to it are taken once more).

    The document at the cut is taken if that brings the sum nearer to the target.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    # prefix: the bits of the boundary found so far; below: words under it
    state = settle(state.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")}))
    for level in range(1, LEVELS + 1):
        here = state.select(F.col("source").alias("_s"), "prefix", "below", "rest").filter("rest > 0")
        shift = LEVEL_BITS * (LEVELS - level)
        inside = rows.join(here, F.col("source").eqNullSafe(F.col("_s"))).filter(F.shiftright("draw", shift + LEVEL_BITS) == F.col("prefix"))
        histogram = inside.groupBy("_s", "below", "rest", F.shiftright("draw", shift).alias("at")).agg(F.sum("size").alias("held"))
        up_to = F.col("below") + F.sum("held").over(Window.partitionBy("_s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        found = (
            histogram.withColumn("up_to", up_to)
            .filter("up_to > rest")
            .groupBy("_s")
            .agg(F.min(F.struct("at", (F.col("up_to") - F.col("held")).alias("below"), "held")).alias("m"))
            .select("_s", F.col("m.at").alias("p"), F.col("m.below").alias("b"), F.col("m.held").alias("h"))
        )
        state = settle(
            state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "times", "rest", F.col("p").alias("prefix"), F.col("b").alias("below"), F.col("h").alias("edge")
            )
        )
    nearer = (F.col("below") + F.col("edge") - F.col("rest")) < (F.col("rest") - F.col("below"))
    cut = F.when(F.col("prefix").isNull(), F.lit(-1)).otherwise(F.col("prefix") - F.when(nearer, 0).otherwise(1)).cast("long")
    return state.select("source", "source_size", "target", "times", cut.alias("cut"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, source, size and draw, written once; the thresholds of their sources)."""
    rows = settle(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), draw(F.col("doc_id").cast("long")).alias("draw"))
    )
    return rows, settle(thresholds(rows, targets(rows)))


def times_taken() -> Column:
    return F.col("times") + (F.col("draw") <= F.col("cut")).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs(doc_id, text, source)``.

    Sizes are words; a null text has none. Null sources are one source. Rows that repeat a doc_id are
    taken together. An empty table gives an empty table.
    """
    rows, cuts = plan(docs)
    cuts = cuts.withColumnRenamed("source", "_s")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them."""
    _, cuts = plan(docs)
    source, times, cut, copy = (unused(docs, c) for c in ("_source", "_times", "_cut", "_copy"))
    cuts = cuts.select(F.col("source").alias(source), F.col("times").alias(times), F.col("cut").alias(cut))
    joined = docs.join(cuts, docs["source"].cast("string").eqNullSafe(cuts[source]))
    taken = F.col(times) + (draw(docs["doc_id"].cast("long")) <= F.col(cut)).cast("long")
    copies = F.explode(F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken)))
    return joined.withColumn(copy, copies).drop(source, times, cut, copy)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER w, 0)::DOUBLE AS capped, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS free,
             1.5::DOUBLE * sum(source_size) OVER () AS whole
      FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((whole - capped) / free, capped) AS level FROM o WHERE weight * ((whole - capped) / free) <= cap),
t AS (SELECT source, source_size, least(weight * level, cap) AS target FROM r, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
e AS (SELECT d.*, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
             sum(size) OVER (PARTITION BY d.source, draw) AS held
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (times + CASE WHEN up_to <= rest OR (up_to - held <= rest AND up_to - rest < rest - (up_to - held)) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM e
"""
