"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, drawn from its code point. An n-gram is the product of
its letters' vectors, each rotated by its place (binding); a text is the sum of its n-grams (bundling);
a language prototype is the sum of its texts. The language is the prototype with the largest cosine.

The length of a document's own vector is the same in all its cosines, so neither the choice nor the
score (the winner's part of the positive cosines) needs it: the product of a document with a prototype
is the sum of the products of its n-grams, which are computed once per run of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.words import Text, slices

DIMENSIONS, GRAM = 1024, 3
FOLDS = 5
UNKNOWN = "und"
GRAMS_AT_ONCE = 2048
SLICE_BYTES = 1 << 20  #: the vectors of a slice's distinct n-grams are made once


@cache
def letters() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter; 0 is the gap between words."""
    return np.random.Generator(np.random.PCG64([20_240_607, code])).integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)


def grams(text: Text, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each n-gram, its number, distinct n-grams as rows of letters, letters per text).

    Runs of other characters are one gap; a text begins and ends with a gap.
    """
    texts = len(text.bounds) - 1
    raw = text.data.tobytes()
    # code points by byte: a character belongs to the text in which it starts
    first = (text.data & 0xC0) != 0x80
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    doc = np.searchsorted(text.bounds, np.flatnonzero(first), "right") - 1
    low = letters()[code]
    per_text = np.bincount(doc[low > 0], minlength=texts)
    # a gap before each text and one at the end
    at = np.searchsorted(doc, np.arange(texts))
    low = np.append(np.insert(low, at, 0), 0)
    doc = np.append(np.insert(doc, at, np.arange(texts)), texts)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0) | (doc[1:] != doc[:-1])
    # the gap that ends a text is the one that begins the next; it is repeated so that each text has both
    low, doc = low[keep], doc[keep]
    alphabet, number = np.unique(low, return_inverse=True)
    count = max(0, len(low) - size + 1)
    gram = np.zeros(count, np.int64)
    gap_inside = np.zeros(count, bool)
    for k in range(size):
        gram = gram * len(alphabet) + number[k : k + count]
        if 0 < k < size - 1:
            gap_inside |= low[k : k + count] == 0
    # a gap inside is dropped only where it is the border of two texts
    border = doc[:count] != doc[size - 1 :]
    good = ~border | ((low[size - 1 :] == 0) & ~gap_inside)
    some = np.zeros(count, bool)
    for k in range(size):
        some |= low[k : k + count] > 0
    good &= some
    distinct, which = np.unique(gram[good], return_inverse=True)
    rows = np.empty((len(distinct), size), np.int64)
    rest = distinct.copy()
    for k in range(size - 1, -1, -1):
        rows[:, k] = alphabet[rest % len(alphabet)]
        rest //= len(alphabet)
    return doc[:count][good], which, rows, per_text


def gram_vectors(rows: np.ndarray, dimensions: int) -> np.ndarray:
    out = np.ones((len(rows), dimensions), np.int8)
    for k in range(rows.shape[1]):
        codes, at = np.unique(rows[:, k], return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c), dimensions), rows.shape[1] - 1 - k) for c in codes])[at]
    return out


def _bundles(dimensions: int, size: int):
    """Sums of the n-gram vectors of a batch, one row for each language and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            names, number = np.unique(langs.astype(str), return_inverse=True)
            for text in slices(batch.column("text"), SLICE_BYTES):
                doc, which, rows, _ = grams(text, size)
                own = number[text.first + doc]
                counts = np.zeros((len(names), len(rows)), np.int64)
                np.add.at(counts, (own, which), 1)
                for a in range(0, len(rows), GRAMS_AT_ONCE):
                    part = counts[:, a : a + GRAMS_AT_ONCE].astype(np.float64) @ gram_vectors(rows[a : a + GRAMS_AT_ONCE], dimensions).astype(np.float64)
                    for k, name in enumerate(names):
                        totals[name] = totals.get(name, 0) + part[k].astype(np.int64)
        for name, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "dim": pa.array(np.arange(dimensions, dtype=np.int32)), "total": pa.array(total)})

    return run


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, size: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their unit prototypes from ``docs(text, lang)``, all rows with both.

    Tasks bundle what they read; a number for each language and dimension comes to the driver.
    """
    known = docs.select("text", F.col("lang").cast("string")).filter("text is not null and lang is not null")
    sums = known.mapInArrow(_bundles(dimensions, size), "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    table = sums.toArrow().to_pandas().pivot(index="lang", columns="dim", values="total").sort_index()
    vectors = table.to_numpy(float) if len(table) else np.zeros((0, dimensions))
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return list(table.index), vectors / np.where(length > 0, length, 1)


def _predict(names: list[str], shared, dimensions: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = shared.value.T.astype(np.float32)
        labels = np.array([*names, UNKNOWN], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows)
            for text in slices(batch.column("text"), SLICE_BYTES) if names else ():
                doc, which, rows, per_text = grams(text, size)
                if not len(rows):
                    continue
                table = np.concatenate([gram_vectors(rows[a : a + GRAMS_AT_ONCE], dimensions).astype(np.float32) @ proto for a in range(0, len(rows), GRAMS_AT_ONCE)])
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                sums = np.add.reduceat(table[which].astype(np.float64), at, axis=0)
                row = doc[at]
                sums, row = sums[per_text[row] > 0], row[per_text[row] > 0]
                likely = np.maximum(sums, 0)
                total = likely.sum(1)
                best[text.first + row] = sums.argmax(1)
                score[text.first + row] = np.where(total > 0, likely.max(1) / np.where(total > 0, total, 1), 1 / len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(labels[best], pa.string()), pa.array(np.round(score, 6))], names=["doc_id", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, names: list[str], vectors: np.ndarray, size: int = GRAM) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of ``docs(doc_id, text)``; other columns are ignored.

    A text that is null or has no letter is `und` with score 0, as is every text where nothing was learned.
    Of equal cosines the first language in order wins. Repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    dimensions = vectors.shape[1] if len(names) else DIMENSIONS
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(names, shared, dimensions, size), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The documents whose labels are never learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fold_prediction(docs: DataFrame, dimensions: int = DIMENSIONS, size: int = GRAM) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    names, vectors = prototypes(docs.filter(~held_out(F.col("doc_id"))), dimensions, size)
    return identify(docs, names, vectors, size).withColumn("held_out", held_out(F.col("doc_id")))
