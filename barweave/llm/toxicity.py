"""Toxicity classifier that is kept from reacting to the mere mention of a group.

Features are words and beginnings of words (4 to 8 bytes) of the lower-cased text, hashed to buckets; their values are
their shares of the text's words, so long and short texts weigh alike. A logistic model is fitted on those buckets
that toxic texts hold most beyond the others, and on the names of groups. Every labelled text is read twice
more: one that names a group with the name exchanged for another of its kind, any other with two names of a
kind put in at the same place. The squared change of the model's score from one to the other is a penalty, so
weight stays away from names and on the words around them.

Fitting uses at most ``sample`` labelled rows, those of least id hash: the one bounded part. Scoring
reads all texts whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.llm.langid import held_out
from barweave.llm.ranks import unused
from barweave.llm.words import BYTE, PUNCT, Text, U, mix, rolled, runs, slices, span_hash, tidy, words
from barweave.session import settle

BUCKETS, PREFIXES = 1 << 20, (4, 5, 6, 7, 8)
MOST_SHARE, UNIT = 0.05, 0.02  #: shares count up to the first, in units of the second
SAMPLE, FEATURES = 20_000, 2048
PENALTY, RIDGE, STEPS, RATE = 1.0, 1e-5, 200, 0.05
#: names of groups that may stand for each other in a sentence
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"), ("elderly", "young"), ("disabled", "healthy"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def measured(text: Text, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the features of some texts, in ascending order; with ``wanted`` only of marked buckets."""
    w = words(text, lower=False, separators=PUNCT)
    prefix = rolled(BYTE[text.data])
    keys = []
    for size in (*PREFIXES, 0):
        at = np.flatnonzero(w.end - w.start >= size)
        value = span_hash(prefix, w.start[at], w.start[at] + size) if size else mix(w.hash + U(1))  # a whole word is no beginning
        bucket, own = (value & U(BUCKETS - 1)).astype(np.int64), w.doc[at].astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket]
            bucket, own = bucket[hit], own[hit]
        keys.append(own * BUCKETS + bucket)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc = key // BUCKETS
    return doc, key % BUCKETS, np.minimum(count / w.per_doc[doc], MOST_SHARE) / UNIT


def features(text: Text, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in ascending order."""
    return measured(text, wanted)[:2]


def exchange(text: str, terms: Sequence[Sequence[str]], pattern: re.Pattern) -> str:
    """Every group name replaced by the next of its kind."""
    after = {a: b for kind in terms for a, b in zip(kind, [*kind[1:], kind[0]], strict=True)}
    return pattern.sub(lambda m: after[m[0]], text)


def put_in(text: str, terms: Sequence[Sequence[str]]) -> tuple[str, str]:
    """The text with a group name put in at some place, and with another of its kind there; place and names follow
    from the text."""
    h = zlib.crc32(text.encode())
    kind = terms[h % len(terms)]
    k = (h >> 8) % len(kind)
    gaps = [m.start() for m in re.finditer(" ", text)]
    at = gaps[(h >> 16) % len(gaps)] if gaps else len(text)
    one, other = (f"{text[:at]} {name}{text[at:]}" for name in (kind[k], kind[(k + 1) % len(kind)]))
    return one, other


def name_buckets(terms: Sequence[Sequence[str]]) -> np.ndarray:
    """Buckets that some group name falls into."""
    names = sorted({n for kind in terms for n in kind})
    return np.unique(np.concatenate([features(t)[1] for t in slices(pa.array(names, pa.string()))] or [np.zeros(0, np.int64)]))


def _counts():
    """Texts of each class that hold a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for text in slices(batch.column("text"), fold=True):
                doc, bucket = features(text)
                own = label[text.first + doc]
                for k in (0, 1):
                    held[k] += np.bincount(bucket[own == k], minlength=BUCKETS)
        some = np.flatnonzero(held.sum(0) > 0)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part), "neg": pa.array(held[0, part]), "pos": pa.array(held[1, part])})

    return run


ROWS = "label int, held array<short>, held_x array<float>, named array<short>, named_x array<float>, turned array<short>, turned_x array<float>"


def _rows(chosen, terms: Sequence[Sequence[str]]):
    """Places among the chosen buckets, and values, of each text as it is, with a group name, and with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(r"\b(?:" + "|".join(re.escape(t) for kind in terms for t in kind) + r")\b") if terms else re.compile(r"(?!)")
        wanted = np.zeros(BUCKETS, bool)
        wanted[chosen.value] = True

        def of(texts: list[str]) -> list[pa.Array]:
            places, values = [], []
            for text in slices(pa.array(texts, pa.string())):
                doc, bucket, value = measured(text, wanted)
                cuts = np.searchsorted(doc, np.arange(1, len(text.bounds) - 1))
                places.extend(np.split(np.searchsorted(chosen.value, bucket).astype(np.int16), cuts))
                values.extend(np.split(value.astype(np.float32), cuts))
            return [pa.array(places, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))]

        for batch in (part for whole in batches for part in runs(whole)):
            plain = pc.utf8_lower(batch.column("text")).fill_null("").to_pylist()
            swapped = [exchange(t, terms, pattern) for t in plain]
            pairs = [(a, b) if a != b or not terms else put_in(a, terms) for a, b in zip(plain, swapped, strict=True)]
            columns = [batch.column("label"), *of(plain), *of([a for a, _ in pairs]), *of([b for _, b in pairs])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return run


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)


def fit(label: np.ndarray, held: tuple, named: tuple, turned: tuple, buckets: np.ndarray, penalty: float) -> Model:
    """Minimise log loss + ridge + penalty * mean squared score change, by full-batch descent with a step
    size of its own for every weight (Adam), so that rare but telling features are learned too.

    Texts are given as (places, values): two lists of arrays."""

    def sparse(texts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, values = texts
        flat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        return np.repeat(np.arange(len(places)), [len(p) for p in places]), flat(places, np.int64), flat(values, float)

    n, width = len(label), len(buckets)
    row, column, x = sparse(held)
    (row_a, column_a, x_a), (row_b, column_b, x_b) = sparse(named), sparse(turned)
    pairs = len(named[0])
    value = np.append(np.zeros(width), np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        weights, bias = value[:-1], value[-1]
        score = np.bincount(row, x * weights[column], minlength=n) + bias
        miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label
        slope = np.bincount(column, x * miss[row], minlength=width) / n + RIDGE * weights
        if pairs and penalty:
            change = np.bincount(row_a, x_a * weights[column_a], minlength=pairs) - np.bincount(row_b, x_b * weights[column_b], minlength=pairs)
            slope += 2 * penalty / pairs * (np.bincount(column_a, x_a * change[row_a], minlength=width) - np.bincount(column_b, x_b * change[row_b], minlength=width))
        slope = np.append(slope, miss.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        value = value - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(buckets, value[:-1], float(value[-1]))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, count: int = FEATURES
) -> Model:
    """Fit on at most ``sample`` rows of ``labels(doc_id, toxic)`` joined with ``docs(doc_id, text)``.

    Of several documents of one id the text that hashes least is read. Rows with a null id or label are not used; of several labels of one id the mean decides (0.5: toxic).
    Without any row nothing is learned and every score is 0.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    # one text of an id, so that repeated ids do not pass the bound; only sampled texts are moved
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    rows = settle(one.select("r.text", "r.label"))
    held = rows.mapInArrow(tidy(_counts()), "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return NOTHING
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    p0, p1, both = (F.col("neg") + 0.5) / (n0 + 1), (F.col("pos") + 0.5) / (n1 + 1), (F.col("neg") + F.col("pos") + 0.5) / (n0 + n1 + 1)
    gap = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / (n0 + 1) + 1 / (n1 + 1)) + 1e-12)
    best = held.filter(F.col("pos") + F.col("neg") >= 4).orderBy(F.desc(F.round(gap, 6)), "bucket").limit(count).select("bucket").toArrow().to_pandas()
    buckets = np.union1d(best["bucket"].to_numpy(np.int64), name_buckets(terms))
    got = rows.mapInArrow(tidy(_rows(spark.sparkContext.broadcast(buckets), terms)), ROWS).toArrow().to_pandas()
    # sums of floats follow the order of rows, which tasks do not fix
    got = got.iloc[sorted(range(len(got)), key=lambda k: (got["label"].iat[k], got["held"].iat[k].tobytes(), got["held_x"].iat[k].tobytes(), got["named"].iat[k].tobytes(), got["turned"].iat[k].tobytes()))]
    part = lambda name: (list(got[name]), list(got[f"{name}_x"]))
    return fit(got["label"].to_numpy(float), part("held"), part("named"), part("turned"), buckets, penalty)


def _scores(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, weight = np.zeros(BUCKETS, bool), np.zeros(BUCKETS)
        wanted[model.buckets], weight[model.buckets] = True, model.weights
        for batch in (part for whole in batches for part in runs(whole)):
            score = np.full(batch.num_rows, model.bias)
            for text in slices(batch.column("text"), fold=True):
                doc, bucket, value = measured(text, wanted)
                score[text.first : text.first + len(text.bounds) - 1] += np.bincount(doc, value * weight[bucket], minlength=len(text.bounds) - 1)
            value = np.round(1 / (1 + np.exp(-np.clip(score, -700, 700))), 6)
            value[np.isneginf(score)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with all columns and a score (0 to 1), from the text alone. A null or empty text has the base rate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_scores(shared, name)), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def learnable(labels: DataFrame, doc_id: Column) -> DataFrame:
    return labels.filter(~held_out(doc_id))


def fold_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row of ``docs``, learned from the labels that
    are not held out."""
    model = train(docs, learnable(labels, F.col("doc_id")), **options)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""
    model = train(docs, learnable(labels, F.col("doc_id")), **options)
    name = unused(docs, "_toxicity")
    return scored(docs, model, name).filter(F.col(name) < 0.5).drop(name)
