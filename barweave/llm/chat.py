"""Collapse of cumulative conversation snapshots, and chat rendering.

Logs often hold a conversation again after every turn. Each turn has a hash of its place, role and
text; the running exclusive or of two such hashes names the turns so far (128 bits). A conversation
whose name is that of the first turns of a longer one is a snapshot and goes, by an anti-join; of equal
conversations the least conv_id stays.

Turns are placed by range, and running values are taken over slices of SLICE turns with one row a
slice carried forward, so one conversation may hold any part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.ranks import numbered
from barweave.session import settle

SLICE = 4096
#: turns of one rendered row; longer conversations continue in further parts
PART = 1024
NO_ID = -(1 << 63)


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def placed_turns(turns: DataFrame) -> DataFrame:
    """_c (the conversation), turn, role, text and pos (from 0, by turn, then role and text)."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("_c"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
        F.xxhash64("text").alias("_tie"),
    )
    all_ = numbered(rows, "_c", "turn", "role", "_tie")
    first = all_.groupBy("_c").agg(F.min("place").alias("_first"))
    return settle(all_.join(first, "_c").withColumn("pos", F.col("place") - F.col("_first")).drop("place", "_first", "_tie"))


def prefixes(placed: DataFrame) -> DataFrame:
    """_c, n, h1 and h2 for every number n of first turns of every conversation."""
    rows = placed.select(
        "_c", "pos", F.floor(F.col("pos") / SLICE).alias("_slice"), _hash(1, F.col("pos"), F.col("role"), F.col("text")).alias("a"), _hash(2, F.col("text"), F.col("role"), F.col("pos")).alias("b")
    )
    rows = settle(rows)
    earlier = Window.partitionBy("_c").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = (
        rows.groupBy("_c", "_slice")
        .agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        .select("_c", "_slice", F.coalesce(F.bit_xor("a").over(earlier), zero).alias("_a"), F.coalesce(F.bit_xor("b").over(earlier), zero).alias("_b"))
    )
    here = Window.partitionBy("_c", "_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("_c", "_slice", (F.col("pos") + 1).alias("n"), F.bit_xor("a").over(here).alias("a"), F.bit_xor("b").over(here).alias("b"))
    joined = inside.join(carried, ["_c", "_slice"])
    return joined.select("_c", "n", F.col("a").bitwiseXOR(F.col("_a")).alias("h1"), F.col("b").bitwiseXOR(F.col("_b")).alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """_c of the conversations that are no first part of another, the least id of equal ones."""
    steps = settle(prefixes(placed))
    whole = steps.groupBy("_c").agg(F.max(F.struct("n", "h1", "h2")).alias("e")).select("_c", "e.*")
    kept = whole.groupBy("n", "h1", "h2").agg(F.min("_c").alias("_c"))
    # what a longer conversation begins with: all its steps but the last
    last = whole.select("_c", F.col("n").alias("_n"))
    begun = steps.join(last, "_c").filter("n < _n").select("n", "h1", "h2").distinct()
    return kept.join(begun, ["n", "h1", "h2"], "left_anti").select("_c")


def segment(role: Column, text: Column) -> Column:
    """One turn. Marks of the template inside a text are broken up, so that no text can open a turn."""
    inert = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), inert, F.lit("<|end|>\n"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and text of the conversations that remain of ``turns(conv_id, turn, role, text)``.

    A conversation is one part for every PART turns. Turns without an id are one conversation. Equal turn
    numbers are ordered by role, repeated rows are turns of their own. A null role is `unknown` and a null
    text is empty in the output, but both differ from such values in the comparison. Other columns
    are ignored; an empty table gives an empty table.
    """
    placed = placed_turns(turns)
    rows = placed.join(maximal(placed), "_c", "left_semi")
    pieces = rows.select("_c", F.floor(F.col("pos") / PART).alias("part"), F.struct("pos", segment(F.col("role"), F.col("text")).alias("piece")).alias("piece"))
    whole = pieces.groupBy("_c", "part").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select(
        F.nullif(F.col("_c"), F.lit(NO_ID)).alias("conv_id"), "part", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.col("pieces.piece"), "").alias("text")
    )


SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT conv_id, pos, n, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far FROM t),
k AS (SELECT min(conv_id) AS conv_id, so_far FROM p WHERE pos = n - 1 GROUP BY so_far),
m AS (SELECT conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n - 1 AND p.so_far = k.so_far))
SELECT conv_id, pos // 1024 AS part, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN m USING (conv_id) GROUP BY conv_id, part
"""
