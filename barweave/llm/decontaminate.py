"""Benchmark decontamination: SimHash chooses item-sized windows, exact weighted similarity verifies them.

Text is lower-cased and cut at everything but letters, digits and non-ASCII characters. A shingle is
``width`` words and weighs 1/2 + 1/(2 * items that hold it), at most 1, so wording that items share
counts less. Items are counted over the whole benchmark, those of equal words once. A window of a
document has as many words as the item it is held against (all words of a shorter document). Its
fingerprint has 64 bits: bit k is set when the weights of shingles whose hash has bit k exceed the others.

The 64 bits are four blocks of 16, and two fingerprints within ``radius`` agree in some block up to radius // 4
bits, so a table per block from value to items within that many bits finds every item within the radius. What
the tables give is verified by the exact weighted Jaccard similarity of the shingle sets. Only items are looked
for of which a document holds enough shingles to reach the similarity at all, a bound that loses nothing.

A similar window may lie outside any radius. An item that passed that bound but of which the fingerprints gave no
window is therefore completed: by the weighted similarity of all its windows and, where none reaches it, by the
plain one, so that wording shared by items does not hide an edited copy. ``by_fingerprint`` tells the two apart.

Items are handled in groups of bounded size, a pass over the documents each; what
several passes find is written, so a task holds one group. Beyond the group, 16 bytes
are sent for every shingle that several items of the benchmark hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.llm.jaccard import _small
from barweave.llm.ranks import unused
from barweave.llm.words import PUNCT, U, runs, shingles, slices, tidy, words
from barweave.session import settle

WIDTH, SIMILARITY = 5, 0.75
BLOCKS, BLOCK_BITS = 4, 16
#: bits in which fingerprints may differ; tables of radius // BLOCKS bits serve 20 to 23 alike
RADIUS = 23
#: items and bytes of item text sent to the executors at a time; the tables of a block hold 8 KB an item
GROUP_ITEMS, GROUP_BYTES = 2048, 4 << 20
WINDOWS = 1 << 14  #: windows fingerprinted at a time
BITS = np.array([bin(v).count("1") for v in range(1 << BLOCK_BITS)], np.uint8)


def bits(value: np.ndarray) -> np.ndarray:
    """-1 or 1 for every bit of every hash, one row a hash."""
    raw = np.unpackbits(np.ascontiguousarray(value.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.float32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 1e-4, axis=1, bitorder="little").view("<u8").reshape(-1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a ^ b).view(np.uint16).reshape(*np.shape(a ^ b), BLOCKS)
    return BITS[x].sum(-1, dtype=np.int64)


@dataclass
class Items:
    """A group of benchmark items, ready to be looked up. Picklable without its block tables and fingerprints."""

    ids: list[list[int | None]]  #: item_ids of each text
    sizes: np.ndarray  #: words
    sets: list[np.ndarray]
    vocabulary: np.ndarray
    weights: np.ndarray
    prints: np.ndarray | None = None
    #: shingles of the whole benchmark that several items hold, ascending, and their weights
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0))

    def __post_init__(self):
        sizes = np.array([len(s) for s in self.sets], np.int64)
        at = np.searchsorted(self.vocabulary, np.concatenate([*self.sets, np.zeros(0, U)]))
        #: per item, places of its shingles in the vocabulary; per shingle, the items that hold it
        self.places = np.split(at, np.cumsum(sizes)[:-1]) if len(sizes) else []
        owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(at, kind="stable")]
        self.holding, self.first = owner, np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.vocabulary)))))
        self.lengths = sizes
        self.totals = np.array([self.weights[p].sum() for p in self.places])

    def weight(self, value: np.ndarray) -> np.ndarray:
        """Weights of shingles; one that no two items of the benchmark hold weighs 1."""
        return weighed(value, self.common)

    def print_of(self, item: int) -> np.ndarray:
        s = self.sets[item]
        return fingerprints((self.weight(s)[:, None] * bits(s)).sum(0, keepdims=True))

    def blocks(self, radius: int) -> list[np.ndarray]:
        """For each block, a bit set of the items near each of its values."""
        if self.prints is None:
            self.prints = np.concatenate([self.print_of(m) for m in range(len(self.sets))])
        held = getattr(self, "_blocks", None)
        if held is None or held[0] != radius:
            tables = []
            for b in range(BLOCKS):
                own = ((self.prints >> U(BLOCK_BITS * b)) & U(0xFFFF)).astype(np.uint32)
                near = np.zeros((1 << BLOCK_BITS, -(-len(own) // 8)), np.uint8)
                for k in range(0, len(own), 8):
                    hit = BITS[np.arange(1 << BLOCK_BITS, dtype=np.uint32)[:, None] ^ own[k : k + 8]] <= radius // BLOCKS
                    near[:, k // 8] = np.packbits(hit, axis=1, bitorder="little")[:, 0]
                tables.append(near)
            held = self._blocks = (radius, tables)
        return held[1]

    def near(self, starts: np.ndarray, value: np.ndarray, weight: np.ndarray, span: int, item: int, radius: int) -> np.ndarray:
        """Whether the fingerprints of windows are within ``radius`` of an item's."""
        tables, out = self.blocks(radius), np.zeros(len(starts), bool)
        for k in range(0, len(starts), WINDOWS):
            at = starts[k : k + WINDOWS]
            a, b = at[0], at[-1] + span
            sums = np.zeros((b - a + 1, 64))
            np.cumsum(weight[a:b, None] * bits(value[a:b]), axis=0, out=sums[1:])
            prints = fingerprints(sums[at - a + span] - sums[at - a])
            close = np.zeros(len(at), bool)
            for block, table in enumerate(tables):
                close |= (table[(prints >> U(BLOCK_BITS * block)) & U(0xFFFF), item // 8] >> (item % 8) & 1).astype(bool)
            out[k : k + WINDOWS] = close & (distance(prints, self.prints[item]) <= radius)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_blocks", "common")}


def weighed(value: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(common[0]):
        return np.ones(len(value))
    at = np.minimum(np.searchsorted(common[0], value), len(common[0]) - 1)
    return np.where(common[0][at] == value, common[1][at], 1.0)


def _shingled(width: int):
    """Words, shingles and a name of its word sequence for every item with at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in slices(batch.column("text"), fold=True):
                w = words(text, separators=PUNCT)
                doc, value = shingles(w, width)
                at = np.searchsorted(doc, np.arange(len(text.bounds)))
                first = np.concatenate(([0], np.cumsum(w.per_doc)))
                kept = np.flatnonzero(w.per_doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(text.first + kept)),
                        pa.array([hashlib.sha256(w.hash[first[k] : first[k + 1]].tobytes()).digest() for k in kept], pa.binary()),
                        pa.array(w.per_doc[kept].astype(np.int64)),
                        pa.array([np.unique(value[at[k] : at[k + 1]]).view(np.int64) for k in kept], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "item", "n_words", "shingles"],
                )

    return run


def prepared(benchmark: DataFrame, width: int) -> DataFrame:
    """A row for every distinct word sequence of the benchmark: ids, n_words, shingles."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tidy(_shingled(width)), "item_id long, item binary, n_words long, shingles array<long>")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("item_id"))), lambda x: x["item_id"])  # a null id is an id
    return settle(rows.groupBy("item").agg(ids.alias("ids"), F.first("n_words").alias("n_words"), F.first("shingles").alias("shingles")).drop("item"))


def shared_weights(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of all items hold, ascending, and their weights."""
    held = items.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").toArrow()
    shingle = held["shingle"].to_numpy().astype(np.int64).view(U)
    order = np.argsort(shingle)
    return shingle[order], 0.5 + 0.5 / held["holders"].to_numpy()[order]


def _starts(width: int, span: int, place: np.ndarray, before: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """For each of ``width`` window starts, the sum of ``amount`` over the distinct shingles at ``place`` in ``span`` from there.

    A place counts in the windows that begin behind the same shingle's place ``before``.
    """
    low, high = np.maximum(np.maximum(before + 1, place - span + 1), 0), np.minimum(place + 1, width)
    some = low < high
    step = np.bincount(low[some], amount[some], width + 1) - np.bincount(high[some], amount[some], width + 1)
    return np.cumsum(step)[:width]


def _search(value: np.ndarray, n_words: int, items: Items, at: np.ndarray, word: np.ndarray, width: int, least: float, radius: int) -> dict[int, tuple]:
    """The best window of one document for each item: item -> (similarity, -start, words, distance, by fingerprint).

    value: shingles in order; at: places of those that the benchmark holds; word: these in its vocabulary.
    """
    # no window shares more of an item than the document does
    own = np.unique(word)
    count = items.first[own + 1] - items.first[own]
    holder = items.holding[np.repeat(items.first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    weight = np.bincount(holder, np.repeat(items.weights[own], count), len(items.sets))
    maybe = (weight >= least * items.totals - 1e-6) | (np.bincount(holder, minlength=len(items.sets)) >= least * items.lengths - 1e-6)
    maybe &= (items.sizes >= width) == (n_words >= width)
    maybe &= (items.sizes >= width) | (items.sizes == n_words)
    best: dict[int, tuple] = {}
    for m in np.flatnonzero(maybe & (weight > 0)):
        mine = at[np.isin(word, items.places[m])]
        size = int(items.sizes[m])
        span = max(1, min(size, n_words) - width + 1)  # shingles of a window
        a, b = max(0, int(mine[0]) - span + 1), min(len(value), int(mine[-1]) + span)
        part = value[a:b]
        order = np.argsort(part, kind="stable")
        before = np.full(len(part), -1)
        same = part[order[1:]] == part[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        each, every, mine = items.weight(part), np.arange(len(part)), mine - a
        starts = len(part) - span + 1
        both = _starts(starts, span, mine, before[mine], each[mine])
        similar = np.round(both / (_starts(starts, span, every, before, each) + items.totals[m] - both), 9)
        chosen = items.near(np.arange(starts), part, each, span, m, radius)
        by_fingerprint = bool((chosen & (similar >= least - 1e-9)).any())
        if by_fingerprint:
            similar = np.where(chosen, similar, 0)
        elif similar.max(initial=0) < least - 1e-9:
            both = _starts(starts, span, mine, before[mine], np.ones(len(mine)))
            similar = np.round(both / (_starts(starts, span, every, before, np.ones(len(part))) + items.lengths[m] - both), 9)
        fits = np.flatnonzero((similar >= least - 1e-9) & (both > 1e-9))
        if len(fits):
            k = int(fits[np.argmax(similar[fits])])
            own_print = fingerprints((each[k : k + span, None] * bits(part[k : k + span])).sum(0, keepdims=True))
            best[int(m)] = (float(similar[k]), -(a + k), min(size, n_words), int(distance(own_print, items.print_of(m))[0]), by_fingerprint)
    return best


def search(column: pa.Array, items: Items, width: int, least: float, radius: int) -> Iterator[tuple[int, dict[int, tuple]]]:
    """(row, best windows) of every text that holds an item."""
    sieve = np.zeros(1 << 20, bool)
    sieve[items.vocabulary & U(len(sieve) - 1)] = True
    for text in slices(column, fold=True):
        w = words(text, separators=PUNCT)
        doc, value = shingles(w, width)
        maybe = np.flatnonzero(sieve[value & U(len(sieve) - 1)])
        word = np.minimum(np.searchsorted(items.vocabulary, value[maybe]), len(items.vocabulary) - 1)
        known = items.vocabulary[word] == value[maybe]
        at, word = maybe[known], word[known]
        bounds = np.searchsorted(doc, np.arange(len(text.bounds)))
        hits = np.searchsorted(at, bounds)
        for k in np.flatnonzero(np.diff(hits)):
            a, b, part = bounds[k], bounds[k + 1], slice(hits[k], hits[k + 1])
            if found := _search(value[a:b], int(w.per_doc[k]), items, at[part] - a, word[part], width, least, radius):
                yield text.first + int(k), found


def groups(items: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> Iterator[Items]:
    """The prepared items, GROUP_ITEMS or GROUP_BYTES at a time; one longer item stands alone."""
    ids, sizes, sets, size = [], [], [], 0

    def group() -> Items:
        vocabulary = np.unique(np.concatenate(sets))
        return Items(ids, np.array(sizes), sets, vocabulary, weighed(vocabulary, common))

    for row in items.toLocalIterator():
        ids.append(row.ids)
        sizes.append(row.n_words)
        sets.append(np.sort(np.array(row.shingles, np.int64).view(U)))
        size += 8 * (len(row.shingles) + len(row.ids))
        if len(ids) >= GROUP_ITEMS or size >= GROUP_BYTES:
            yield group()
            ids, sizes, sets, size = [], [], [], 0
    if ids:
        yield group()


def broadcasts(benchmark: DataFrame, width: int) -> Iterator[tuple[Broadcast, Broadcast, bool]]:
    """Each group, the weights of the whole benchmark, and whether the group is the only one.

    One of several groups is given up as the next is asked for, so what uses it must be written by then.
    """
    context, items = benchmark.sparkSession.sparkContext, prepared(benchmark, width)
    weights = shared_weights(items)
    each = groups(items, weights)
    common, group, alone = context.broadcast(weights), next(each, None), True
    while group is not None:
        following = next(each, None)
        alone &= following is None
        shared = context.broadcast(group)
        yield shared, common, alone
        if not alone:
            shared.destroy()
        group = following


def ready(shared, common) -> Items:
    """A group in a task, with the weights of the whole benchmark."""
    shared.value.common = common.value
    return shared.value


HITS = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming long, by_fingerprint boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """A row for every document and benchmark item that it holds, with its best window.

    Columns: doc_id, item_id, similarity (weighted or, where no window reaches ``least`` so, plain; rounded to 6 digits), start_word and n_words of the window,
    hamming (of the fingerprints), by_fingerprint (the block tables gave the window; else it was completed). Of
    equally similar windows the first counts. A text of any length is read in slices of bounded bytes, its words
    and shingles as arrays. Documents without a hit give no row;
    repeated rows each give their own. A null or empty text holds nothing. An item without words is not looked
    for; an item of fewer than ``width`` words is only found where it is the whole document, as it would
    otherwise flag every use of a phrase. An empty table on either side gives an empty table.
    """
    spark = docs.sparkSession

    def finder(shared, common):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ready(shared, common)
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [
                    (ids[row].as_py(), item, round(s, 6), -start, n, far, chosen)
                    for row, found in search(batch.column("text"), items, width, least, radius)
                    for m, (s, start, n, far, chosen) in sorted(found.items())
                    for item in items.ids[m]
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        return run

    out = None
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for shared, common, alone in broadcasts(benchmark, width):
        part = rows.mapInArrow(tidy(finder(shared, common)), HITS)
        part = part if alone else settle(part)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], HITS) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item.

    Of several groups of items, each writes the keys (of their bytes) of texts that hold one; these rows then go at once.
    """

    def stays(shared, common):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ready(shared, common)
            for batch in (part for whole in batches for part in runs(whole)):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in search(batch.column("text"), items, width, least, radius)]] = False
                yield batch.filter(pa.array(keep))

        return run

    def texts(shared, common):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ready(shared, common)
            for batch in batches:
                column = batch.column("text")
                keys = {hashlib.sha256(column[row].as_py().encode()).hexdigest() for row, _ in search(column, items, width, least, radius)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

        return run

    gone = None
    for shared, common, alone in broadcasts(benchmark, width):
        if alone:
            return docs.mapInArrow(tidy(stays(shared, common)), T.StructType(docs.schema.fields))
        part = settle(docs.select("text").mapInArrow(tidy(texts(shared, common)), "key string"))
        gone = part if gone is None else gone.union(part)
    if gone is None:
        return docs
    name = unused(docs, "_text_key")
    gone = settle(gone.select(F.col("key").alias(name)).distinct())
    return docs.withColumn(name, F.sha2("text", 256)).join(_small(gone), name, "left_anti").drop(name)
