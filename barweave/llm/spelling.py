"""Words that differ by one character, by pairs of trie nodes.

The words are put into two tries, one read forwards, one backwards, and every node gets a number. A place in a
word then is a pair of numbers: the node of what stands before it and the node of what stands behind it. A
word has one pair for each character skipped and one for each gap between characters. Two words with the same
pair of a skipped character differ by one replacement; a skipped character of one and a gap of the other with
the same pair differ by one insertion. Equal pairs mean equal texts, so nothing has to be verified, and as the
characters at one place are the letters of an alphabet, no pair is shared by more words than that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.words import LOWER, slices
from barweave.session import settle

#: a run of A-Z, a-z and U+00C0 to U+00FF, which in UTF-8 are the byte 0xC3 and one of 0x80 to 0xBF
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
TYPO, LEAST_LENGTH, LEAST_COUNT, FACTOR = 97, 5, 3, 2
HELD, PART_BYTES, SLICE_BYTES = 1 << 17, 1 << 20, 1 << 18
PART_BITS = 40  #: a node's number is the partition that made it and its place there
SKIP_INSIDE, SKIP, GAP = 0, 1, 2  #: a character followed by its like, any other character, a gap


def _spelled(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about PART_BYTES that end where no run goes on."""
    at = 0
    while len(data) - at > PART_BYTES:
        run = RUN.search(data, at + PART_BYTES)
        # a run that goes on from before the cut is found from the cut on: end behind it
        end = run.end() if run else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        long = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
        held.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w, _ in long], pa.string()), "n": pa.array([n for _, n in long], pa.int64())})

    for batch in batches:
        ids = batch.column("doc_id")
        for part in slices(batch.column("text"), SLICE_BYTES):
            raw, at = LOWER[part.data].tobytes(), part.bounds.tolist()
            for k, (a, b) in enumerate(pairwise(at)):
                doc = ids[part.first + k].as_py()
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _parts(raw[a:b]):
                    for word, n in Counter(RUN.findall(piece)).items():
                        h = zlib.crc32(word, base)
                        held[word if h % TYPO else _spelled(word, h)] += n
                    if len(held) > HELD:
                        yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least five characters that occur three times or more in ``docs(doc_id, text)``.

    In one of 97 (document, run) pairs, chosen by checksum, the run lacks a character; a null doc_id is
    written as nothing there.
    """
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    return next(k for k, (x, y) in enumerate(zip(a, b + "\0")) if x != y) if a else 0


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from the root to the end of each key, for keys in ascending order: what a key shares with the one
    before it has its numbers, the rest are new. ``shared`` tells how much it has in common with the first."""
    part = TaskContext.get().partitionId()
    count, before, first, path = part << PART_BITS, "", None, []
    for batch in batches:
        paths, shared, twin = [], [], []
        for key in batch.column("key").to_pylist():
            first = key if first is None else first
            same = _shared(before, key)
            path = path[:same] + list(range(count + 1, count + 1 + len(key) - same))
            count += len(key) - same
            before = key
            paths.append(path)
            shared.append(_shared(first, key) if first[:1] == key[:1] else 0)
            twin.append([x == y for x, y in pairwise(key)] + [False])
        columns = {name: batch.column(name) for name in batch.schema.names} | {
            "part": pa.array([part] * len(paths), pa.int32()), "shared": pa.array(shared, pa.int32()),
            "path": pa.array(paths, pa.list_(pa.int64())), "twin": pa.array(twin, pa.list_(pa.bool_())),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _seams(ends: list) -> list[tuple[int, list[int]]]:
    """(part, nodes) of the beginning that the keys of a part share with those of earlier parts.

    ``ends`` holds part, first key, last key and the last key's path for each part, in order.
    """
    out, before, carried = [], "", []
    for e in ends:
        seam = carried[: _shared(before, e.first) if before else 0]
        own = min(len(seam), _shared(e.first, e.last))
        if seam:
            out.append((e.part, seam))
        before, carried = e.last, seam[:own] + e.path[own:]
    return out


def trie_nodes(rows: DataFrame) -> DataFrame:
    """``rows(key, ...)``, keys distinct and not empty, with ``path``: the numbers of the trie nodes of its beginnings.

    Keys are cut into ranges and each range numbers its own nodes. Beginnings that reach over the border of
    ranges are those of a range's first key; their numbers are handed on from range to range, which takes one
    row a range on the driver. ``twin`` tells which characters are followed by their like. The number of the
    end of a key rises with the key in code-point order.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange("key").sortWithinPartitions("key")
    more = "part int, shared int, path array<long>, twin array<boolean>"
    placed = settle(ranged.mapInArrow(_paths, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), more])))
    ends = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path")).collect()
    seams = spark.createDataFrame(_seams(sorted(ends)), "part int, seam array<long>")
    kept = F.least(F.size("seam"), F.col("shared"))
    whole = F.concat(F.slice("seam", 1, kept), F.slice("path", kept + 1, F.size("path")))
    return placed.join(seams, "part", "left").withColumn("path", F.when(F.col("seam").isNotNull(), whole).otherwise(F.col("path"))).drop("part", "shared", "seam")


def _places(length: Column) -> Column:
    """Pairs of nodes of a word for every skipped character and every gap."""
    before = lambda k: F.when(k == 0, 0).otherwise(F.get("path", k - 1))
    behind = lambda k: F.when(k == length, 0).otherwise(F.get("back", length - k - 1))
    skip = lambda k: F.struct(before(k).alias("a"), behind(k + 1).alias("b"), F.when(F.get("twin", k), SKIP_INSIDE).otherwise(SKIP).alias("kind"))
    gap = lambda k: F.struct(before(k).alias("a"), behind(k).alias("b"), F.lit(GAP).alias("kind"))
    return F.concat(F.transform(F.sequence(F.lit(0), length - 1), skip), F.transform(F.sequence(F.lit(0), length), gap))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, near) of the words that have near ones, from ``words(id, n, path, back, twin)``.

    ``near`` holds n and id of the near word of largest n (ties: least id). At most one word has a given gap,
    and each word one skipped character at a given place, so a place counts its words and keeps the best two;
    pairs of words are never made. Of like characters in a row only the last counts as left out, as leaving
    out another gives the same word.
    """
    place = Window.partitionBy("a", "b")
    ordered = place.orderBy(F.col("kind") == GAP, F.desc("n"), "id")
    best = lambda when: F.max(F.when(when, F.struct("n", (-F.col("id")).alias("m")))).over(place)
    kind, count = F.col("kind"), lambda when: F.count(F.when(when, 1)).over(place)
    here = words.select("id", "n", F.inline(_places(F.size("path")))).withColumns({
        "skips": count(kind != GAP), "apart": count(kind == SKIP), "gap": best(kind == GAP), "skipped": best(kind == SKIP), "top": best(kind != GAP),
        "next": F.lead(F.when(kind != GAP, F.struct("n", (-F.col("id")).alias("m")))).over(ordered), "at": F.row_number().over(ordered),
    })
    other = F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("top"))  # the best of the others with a character here
    found = here.filter((F.col("skips") > 1) | (F.col("gap").isNotNull() & (F.col("apart") > 0))).select(
        "id",
        F.when(kind == GAP, F.col("apart")).otherwise(F.col("skips") - 1 + F.when((kind == SKIP) & F.col("gap").isNotNull(), 1).otherwise(0)).alias("count"),
        F.when(kind == GAP, F.col("skipped")).when(kind == SKIP, F.greatest(other, F.col("gap"))).otherwise(other).alias("best"),
    )
    merged = found.filter("count > 0").groupBy("id").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))
    return merged.select("id", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.m")).alias("id")).alias("near"))


def last_forms(links: DataFrame) -> DataFrame:
    """(id, root) from ``links(id, form_id)``: the end of the chain that starts at each id, by jumps of doubled length."""
    jumps = settle(links.select("id", F.col("form_id").alias("root")))
    while True:
        ahead = jumps.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        joined = jumps.join(ahead, "root", "left")
        if joined.filter(F.col("_next").isNotNull()).isEmpty():
            return jumps
        jumps = settle(joined.select("id", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame) -> DataFrame:
    """Every word of ``docs(doc_id, text)`` with its form, root, counts and number of near words.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least
    twice its own; the root is the last of the chain of forms. Null and empty texts have no words, rows of one
    doc_id count like any others, other columns are ignored, and an empty table gives no word. A word of any
    length is taken whole; its number of places grows with its length.
    """
    words = settle(vocabulary(docs).withColumnRenamed("word", "key"))
    forward = trie_nodes(words).withColumn("id", F.element_at("path", -1))
    backward = trie_nodes(forward.select(F.reverse("key").alias("key"), "id")).select("id", F.col("path").alias("back"))
    near = settle(neighbours(forward.join(backward, "id")))
    named = forward.select("id", F.col("key").alias("word"), "n")
    form = named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    close = named.join(near, "id", "left").withColumn("form_id", F.when(F.col("near.n") >= FACTOR * F.col("n"), F.col("near.id")))
    root = last_forms(close.filter("form_id is not null")).join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = close.join(form, "form_id", "left").join(root, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
