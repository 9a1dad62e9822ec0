"""Quality rules with thresholds that follow each language and source.

Values of a text are shares (symbols per character, copied lines per line, repeated words per word) and the
mean word length. Their distribution per language and source is kept in a quantile sketch of logarithmic
buckets with bounded relative error: counts of buckets, merged by addition, so any split of the rows gives
the same sketch.

A rule reads a high (or low) quantile of the group's sketch and stretches it by a factor: the limit. For what junk
shows most, the quantile is one that junk does not reach while it is under a fifth of a group; for copied
lines and words it is the outermost half percent. Groups borrow ``PRIOR`` rows of their language and as many of the
whole, so small ones lean on those, and no limit goes beyond a multiple of its language's own. Limits replace fixed
cut-offs and are joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.words import BYTE, SPACE, Text, mix, rolled, slices, span_hash, words
from barweave.session import settle

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: relative width of a sketch bucket, and the offset that gives zero a bucket
GROWTH, OFFSET = 1.02, 1e-3
#: rows that a group borrows of its language and of the whole; how far a limit may go beyond its language's
PRIOR, BOUND = 25, 8.0
#: value, quantile, factor (below 1: a lower limit). A value counts from OFFSET below zero, where its sketch begins
RULES: tuple[tuple[str, float, float], ...] = (
    ("symbol_share", 0.80, 8.0), ("line_share", 0.995, 1.5), ("repeat_share", 0.995, 1.5), ("mean_word", 0.80, 1.28), ("mean_word", 0.20, 1 / 1.28),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines")  #: and the lines with a word


def measure(text: Text) -> dict[str, np.ndarray]:
    """The base counts of every text."""
    data, bounds = text.data, text.bounds
    texts = len(bounds) - 1
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
    w = words(text, lower=False)
    solid = ~SPACE[data]
    out = {"n_words": w.per_doc, "word_chars": total(solid & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[data])}

    # lines: cut at \n and at the ends of texts
    ends = np.unique(np.concatenate((np.flatnonzero(data == 0x0A), bounds[1:])))
    # a line that ends with its text and one that a \n ends are both spans of bytes without \n
    starts = np.concatenate(([0], ends[:-1] + (data[ends[:-1]] == 0x0A if len(ends) > 1 else 0)))
    starts = np.minimum(starts, ends) if len(ends) else starts[:0]
    prefix = rolled(BYTE[data])
    has_word = np.concatenate(([0], np.cumsum(solid)))
    worded = has_word[ends] > has_word[starts]
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(bounds, starts, "right") - 1
    key = mix(span_hash(prefix, starts, ends) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(doc, minlength=texts)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=texts)

    # 3-word windows that occur twice or more in their text mark their words
    n = len(w.hash)
    count = max(0, n - 2)
    inside = w.doc[:count] == w.doc[2:] if count else np.zeros(0, bool)
    gram = np.zeros(count, np.uint64)
    for k in range(3):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + count]
    gram = mix(gram + w.doc[:count].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    place = np.flatnonzero(inside)
    _, which, often = np.unique(gram[place], return_inverse=True, return_counts=True)
    place = place[often[which] > 1]
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[place + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[marked], minlength=texts)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure(t) for t in slices(batch.column("text"))]
        columns = [np.concatenate([p[name] for p in parts] or [np.zeros(0)]).astype(np.int64) for name in COUNTS]
        keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, columns)], names=[*(batch.schema.names[k] for k in keep), *COUNTS])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of ``docs(doc_id, text, lang, source)``. A null or empty
    text counts 0 everywhere."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return rows.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def values() -> dict[str, Column]:
    per = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / per,
        "mean_word": F.col("word_chars") / per,
    }


def bucket(value: Column) -> Column:
    return F.floor(F.log(value + OFFSET) / float(np.log(GROWTH))).cast("int")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n over the rows that pass the base rules."""
    kept = rows.filter(~base_failed())
    entries = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), bucket(v).alias("bucket")) for name, v in values().items()]))
    return kept.select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.rule", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(weighted: DataFrame, by: list[str], levels: dict[str, float]) -> DataFrame:
    """(by, rows, a column for each level) from ``weighted(by, bucket, n)``: the middle of the bucket in which the running
    sum reaches the level's share of all."""
    merged = weighted.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # buckets of a sketch are few (about 700 span 1e-3 to 1e3), so one array holds them
    held = merged.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("held"), F.sum("n").alias("rows"))

    def at(share: float) -> Column:
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("at"))
        step = lambda acc, x: F.struct(
            (acc["seen"] + x["n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + x["n"] + 1e-6 >= share * F.col("rows")), x["bucket"]).otherwise(acc["at"]).alias("at")
        )
        return F.greatest(F.pow(F.lit(GROWTH), F.aggregate("held", start, step)["at"] + 0.5) - OFFSET, F.lit(0.0))

    return held.select(*by, "rows", *[at(share).alias(name) for name, share in levels.items()])


LIMITS = {f"limit_{k}": rule for k, rule in enumerate(RULES)}


def _stretched(mixed: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """(by, a column for each rule): quantiles of the mixed sketches, stretched by the rule's factor."""
    found = quantiles(mixed, [*by, "rule"], {f"q_{level}": level for level in {level for _, level, _ in RULES}})
    limit = lambda rule: (F.col(f"`q_{rule[1]}`") + OFFSET) * rule[2] - OFFSET
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("rule") == rule[0], limit(rule))).alias(prefix + name) for name, rule in LIMITS.items()])


def limits(sketch: DataFrame, prior: float = PRIOR, bound: float = BOUND) -> DataFrame:
    """A row for each language and source with the limit of every rule."""
    own = sketch.select("lang", "source", "rule", "bucket", F.col("n").cast("double").alias("n"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"_{c}")  # noqa: E731  null languages are one

    def shares(by: list[str]) -> DataFrame:
        """A sketch that weighs ``prior`` rows."""
        counted = own.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
        sums = counted.groupBy(*by, "rule").agg(F.sum("n").alias("_all"))
        return counted.join(sums, [*by, "rule"]).select(*by, "rule", "bucket", (prior * F.col("n") / F.col("_all")).alias("n"))

    own = own.withColumn("_lang", name("lang"))
    groups, langs = own.select("lang", "source", "_lang", "rule").distinct(), own.select("_lang", "rule").distinct()
    of_lang, of_all = shares(["_lang"]), shares([])
    cols = ["lang", "source", "_lang", "rule", "bucket", "n"]
    mixed = own.select(cols).union(groups.join(of_lang, ["_lang", "rule"]).select(cols)).union(groups.join(of_all, "rule").select(cols))
    wide = own.select("_lang", "rule", "bucket", "n").union(langs.join(of_all, "rule").select("_lang", "rule", "bucket", "n"))
    joined = _stretched(mixed, ["lang", "source", "_lang"]).join(_stretched(wide, ["_lang"], "w_"), "_lang")
    far = lambda name, factor: (F.col(f"w_{name}") + OFFSET) * (bound if factor > 1 else 1 / bound) - OFFSET
    pick = {n: (F.least if factor > 1 else F.greatest)(n, far(n, factor)) for n, (_, _, factor) in LIMITS.items()}
    return joined.select("lang", "source", *[c.alias(n) for n, c in pick.items()])


def fits() -> dict[str, Column]:
    """Whether a row keeps each rule's limit."""
    value = values()
    return {n: value[v] <= F.col(n) if factor > 1 else value[v] >= F.col(n) for n, (v, _, factor) in LIMITS.items()}


def judged(docs: DataFrame, prior: float = PRIOR, bound: float = BOUND) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs(doc_id, text, lang, source)``.

    Null languages and null sources are groups of their own. Repeated rows each count and give a row. Other
    columns are ignored; an empty table gives an empty table. A text of any length is measured whole.
    """
    rows = settle(base_counts(docs))
    joined = with_limits(rows, limits(sketches(rows), prior, bound))
    inside = F.lit(True)
    for ok in fits().values():
        inside = inside & ok
    return joined.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def with_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")


def sql() -> str:
    """The query over ``documents`` in SQL."""
    step = repr(float(np.log(GROWTH)))
    value = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)::DOUBLE", "line_share": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)::DOUBLE", "mean_word": "word_chars / greatest(n_words, 1)::DOUBLE",
    }
    entries = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, floor(ln({v} + {OFFSET}e0) / {step}) AS bucket FROM b WHERE NOT base_failed" for k, v in value.items())
    at = lambda level: f"greatest(pow({GROWTH}e0, min(bucket) FILTER (seen + 1e-6 >= {level}e0 * total) + 0.5e0) - {OFFSET}e0, 0e0)"

    def level(name: str, mixed: str, by: str) -> str:
        each = ", ".join(f"max(CASE WHEN rule = '{v}' THEN (q{k} + {OFFSET}e0) * {factor!r}e0 - {OFFSET}e0 END) AS l{k}" for k, (v, _, factor) in enumerate(RULES))
        found = ", ".join(f"{at(q)} AS q{k}" for k, (_, q, _) in enumerate(RULES))
        return f"""{name} AS (SELECT {by}, {each} FROM (SELECT {by}, rule, {found} FROM (SELECT {by}, rule, bucket,
          sum(n) OVER (PARTITION BY {by}, rule ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {by}, rule) AS total
          FROM (SELECT {by}, rule, bucket, sum(n) AS n FROM ({mixed}) GROUP BY ALL)) GROUP BY {by}, rule) GROUP BY {by})"""

    pick = ", ".join(f"{'least' if f > 1 else 'greatest'}(o.l{k}, (g.l{k} + {OFFSET}e0) * {BOUND if f > 1 else 1 / BOUND}e0 - {OFFSET}e0) AS l{k}" for k, (_, _, f) in enumerate(RULES))
    checks = " AND ".join(f"{value[v]} {'<=' if f > 1 else '>='} l{k}" for k, (v, _, f) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g3 AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS gram FROM d, unnest(range(1, greatest(len(ws) - 1, 1))) AS t(i)),
marked AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS k FROM g3) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM marked GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
b AS (SELECT *, coalesce('=' || lang, '') AS lk, coalesce('=' || source, '') AS sk, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
e AS (SELECT coalesce('=' || lang, '') AS lk, coalesce('=' || source, '') AS sk, rule, bucket, count(*)::DOUBLE AS n FROM ({entries}) GROUP BY ALL),
pl AS (SELECT lk, rule, bucket, {PRIOR} * n / sum(n) OVER (PARTITION BY lk, rule) AS n FROM (SELECT lk, rule, bucket, sum(n) AS n FROM e GROUP BY ALL)),
pa AS (SELECT rule, bucket, {PRIOR} * n / sum(n) OVER (PARTITION BY rule) AS n FROM (SELECT rule, bucket, sum(n) AS n FROM e GROUP BY ALL)),
gr AS (SELECT DISTINCT lk, sk, rule FROM e),
{level("own", "SELECT lk, sk, rule, bucket, n FROM e UNION ALL SELECT lk, sk, rule, bucket, n FROM gr JOIN pl USING (lk, rule) UNION ALL SELECT lk, sk, rule, bucket, n FROM gr JOIN pa USING (rule)", "lk, sk")},
{level("wide", "SELECT lk, rule, bucket, n FROM e UNION ALL SELECT lk, rule, bucket, n FROM (SELECT DISTINCT lk, rule FROM gr) JOIN pa USING (rule)", "lk")},
f AS (SELECT o.lk, o.sk, {pick} FROM own o JOIN wide g USING (lk))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({checks}, FALSE) AS kept
FROM b LEFT JOIN f USING (lk, sk)
"""
