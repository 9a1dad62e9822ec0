"""N-gram Jaccard join by prefix filters under several global token orders.

A token is the hash of a shingle of ``width`` words; a document is the set of its tokens. Texts of
equal sets are one node. Two nodes link when 100 * intersection >= percent * union.

Order 0 puts tokens that were counted often last and breaks ties by hash. Nodes that link must share
a token within the prefixes that their sizes allow, so only prefix tokens are shuffled, and only those
held in two or more places are kept. Orders 1 and 2 permute the hashes. Under them a prefix runs up to a
fixed place, a quarter of the order, and every node carries a bit map of its prefix. Linked sets of n and m
tokens lack at most n - need of each other, so of p prefix tokens at least p - (n - need) must be shared:
pairs have to share as many under each of these orders, too, before sets are read. What passes all orders has
to pass counts of tokens per hash bucket, whose smaller ones bound the intersection, and is then compared exactly.

A group of g near copies never becomes g * g pairs: each node first meets the most copied node of
each of its tokens, links found so are closed to components, and only pairs of nodes in different
components are looked at afterwards, again by prefix, size and position. No pair that could link is
left out, so components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.graph import components
from barweave.llm.words import U, distinct, mix, shingles, slices, tidy, words
from barweave.llm.ranks import unused
from barweave.session import settle

WIDTH, PERCENT = 5, 75
#: counted tokens that order 0 knows by rank; others rank by hash alone. It bounds a broadcast, not the result.
RANKED, RANK_FROM = 1 << 18, 8
#: tokens that a task counts at a time
RUN_TOKENS = 1 << 21
#: size of the map of shared tokens (4 MB)
HELD_BITS = 1 << 25
#: rows of live nodes that may be broadcast (8 bytes each); beyond it the same join shuffles
BROADCAST_ROWS = 1 << 20
#: pairs that a task looks at at a time
NEAR_ROWS = 256
LOW = U((1 << 56) - 1)
SEEDS = (U(0x51A3C1D7E2B40F69), U(0x2C9277B5A5E1D3F8))
#: where prefixes under the further orders end: a quarter of all places
PREFIX = U(1 << 62)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for text in slices(column):
        doc, value = shingles(words(text), width)
        yield text.first, distinct(doc, value >> U(8), len(text.bounds) - 1)


def _histogram(tokens: np.ndarray) -> bytes:
    """Tokens per bucket of their lowest bits, one byte each; empty if a byte cannot hold a count."""
    size = max(256, 1 << (len(tokens) // 4).bit_length())
    held = np.bincount((tokens & U(size - 1)).astype(np.int64), minlength=size)
    return held.astype(np.uint8).tobytes() if held.max() < 256 else b""


def shared_at_most(x: bytes, y: bytes) -> float:
    """A bound on the intersection of two sets from their histograms."""
    if not x or not y:
        return float("inf")
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    size = min(len(a), len(b))  # the larger one is folded, as both count by the lowest bits
    return int(np.minimum(a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)).sum())


def prefix_maps(tokens: np.ndarray) -> list[bytes]:
    """For each further order, a bit map of the tokens in its first quarter, behind their number (8 bytes)."""
    size, out = 1 << max(8, (2 * len(tokens)).bit_length()), []
    for seed in SEEDS:
        moved = mix((tokens & LOW) ^ seed)
        moved = moved[moved < PREFIX]
        bit = np.zeros(size, bool)
        bit[moved & U(size - 1)] = True
        out.append(np.array([len(moved)], "<u8").tobytes() + np.packbits(bit, bitorder="little").tobytes())
    return out


def prefixes_allow(x: bytes, y: bytes, n: int, m: int, need: int) -> bool:
    """Whether prefixes of sets of n and m tokens under one order can share what an intersection of ``need`` asks for."""
    p, q = (int(np.frombuffer(v, "<u8", 1)[0]) for v in (x, y))
    a, b = (np.frombuffer(v, np.uint8, offset=8) for v in (x, y))
    size = min(len(a), len(b))  # the larger one is folded, as both places are the lowest bits
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    both = int(np.bitwise_count(a & b).sum())
    # tokens that share a bit with another of their own set may all be shared
    shared = both + min(p - int(np.bitwise_count(a).sum()), q - int(np.bitwise_count(b).sum()))
    return shared >= max(p - (n - need), q - (m - need))


def _node(tokens: np.ndarray) -> int:
    """64 bits that name a set: equal for equal sets."""
    if not len(tokens):
        return 0
    total = mix(tokens + U(1)).sum(dtype=U)
    return int(mix(np.array([total ^ U(len(tokens))], U)).view(np.int64)[0])


def _rank(tokens: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Order 0 of 56-bit tokens: class in the top byte, hash below; sorted."""
    known, classes, sieve = table
    out = tokens.copy()
    maybe = np.flatnonzero(sieve[tokens & U(len(sieve) - 1)]) if len(known) else np.zeros(0, np.int64)
    if len(maybe):
        at = np.minimum(np.searchsorted(known, tokens[maybe]), len(known) - 1)
        hit = known[at] == tokens[maybe]
        out[maybe[hit]] |= classes[at[hit]] << U(56)
        out.sort()
    return out


def _profiles(width: int):
    """A row for every text (node and size), and one for every token that several nodes of a run of texts hold."""

    def rows(batch: pa.RecordBatch, first: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        nodes, n = np.array([_node(s) for s in sets], np.int64), len(sets)
        # equal sets count once, as order 0 is about nodes
        _, once = np.unique(nodes, return_index=True)
        tokens, counts = np.unique(np.concatenate([sets[i] for i in once]), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        none = pa.nulls(len(tokens), pa.int64())
        first_of = np.zeros(n, bool)
        first_of[once] = True
        counts_of = [_histogram(s) if f and len(s) else None for s, f in zip(sets, first_of, strict=True)]
        maps = [prefix_maps(s) if f and len(s) else None for s, f in zip(sets, first_of, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([False, True], [n, len(tokens)])),
                pa.concat_arrays([batch.column("doc_id").slice(first, n), none]),
                pa.concat_arrays([batch.column("row_key").slice(first, n), none]),
                pa.array(np.concatenate((nodes, tokens.astype(np.int64)))),
                pa.array(np.concatenate(([len(s) for s in sets], counts)).astype(np.int64)),
                pa.array([*counts_of, *[None] * len(tokens)], pa.binary()),
                pa.array([*maps, *[None] * len(tokens)], pa.list_(pa.binary())),
            ],
            names=["counted", "doc_id", "row_key", "node", "n", "histogram", "prefixes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            first = size = 0
            for _, sets in _sets(batch.column("text"), width):
                held.extend(sets)
                size += sum(map(len, sets))
                if size >= RUN_TOKENS:
                    yield rows(batch, first, held)
                    first, size, held = first + len(held), 0, []
            if held:
                yield rows(batch, first, held)

    return run


def _postings(width: int, percent: int, table, held=None):
    """Prefix tokens under order 0; with ``held``, only those whose bit in that map is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for _, sets in _sets(batch.column("text"), width):
                parts, nodes, sizes, kept = [], [], [], []
                for s in sets:
                    if len(s) and (node := _node(s)) not in done:
                        done.add(node)
                        k = len(s) - (-(-percent * len(s) // 100)) + 1
                        parts.append(_rank(s, table.value)[:k])
                        nodes.append(node)
                        sizes.append(len(s))
                        kept.append(k)
                if parts:
                    kept = np.array(kept)
                    pos = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
                    tokens = np.concatenate(parts)
                    columns = [tokens.view(np.int64), np.repeat(np.array(nodes, np.int64), kept), np.repeat(np.array(sizes, np.int32), kept), pos.astype(np.int32)]
                    if held is not None:
                        bit = tokens & U(HELD_BITS - 1)
                        some = ((held.value[bit >> U(6)] >> (bit & U(63))) & U(1)).astype(bool)
                        columns = [c[some] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "pos"])

    return run


def _tokens(width: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for _, sets in _sets(batch.column("text"), width):
                fresh = {node: s for s in sets if len(s) and (node := _node(s)) not in done}
                done.update(fresh)
                if fresh:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fresh.keys(), pa.int64()), pa.array([_rank(s, table.value).tobytes() for s in fresh.values()], pa.binary())],
                        names=["node", "tokens"],
                    )

    return run


def needed(n: int, m: int, percent: int) -> int:
    """Least intersection of linked sets of n and m tokens."""
    return -(-percent * (n + m) // (100 + percent))


def _near(percent: int, dropped: Sequence[Accumulator] = ()):
    """Pairs whose prefixes under every further order, and then whose histograms, allow a link.

    ``dropped``: counters of the pairs that each order and the histogram drop (a task run again counts again).
    """

    def stopped(n: int, m: int, xs: list[bytes], ys: list[bytes], x: bytes, y: bytes) -> int | None:
        need = needed(n, m, percent)
        for order, (p, q) in enumerate(zip(xs, ys, strict=True)):
            if not prefixes_allow(p, q, n, m, need):
                return order
        return None if shared_at_most(x, y) >= need else len(SEEDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                columns = [batch.column(c).to_pylist() for c in ("n", "m", "xs", "ys", "x", "y")]
                at = [stopped(*row) for row in zip(*columns, strict=True)]
                for i, counter in enumerate(dropped):
                    counter.add(at.count(i))
                yield batch.select(["a", "b"]).filter(pa.array([i is None for i in at], pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            sets = ((np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)) for p, q in zip(x, y, strict=True))
            hit = [len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q), percent) for p, q in sets]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _ranking(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most counted tokens with a class that grows with the count (an order for all, no filter)."""
    top = (
        counted.groupBy(F.col("node").alias("token"))
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= RANK_FROM)
        .orderBy(F.desc("n"), "token")
        .limit(RANKED)
        .toArrow().to_pandas()
    )
    known = top["token"].to_numpy(np.int64).view(U)
    order = np.argsort(known)
    classes = np.minimum(1 + (4 * np.log2(np.maximum(top["n"].to_numpy(float), 1))).astype(int), 255).astype(U)
    sieve = np.zeros(1 << 22, bool)
    sieve[known & U(len(sieve) - 1)] = True
    return known[order], classes[order], sieve


def _held(shared: DataFrame) -> np.ndarray:
    """A map of HELD_BITS bits, set for tokens that several nodes hold. Its size is fixed; with more
    tokens it lets more others through, which the join after it removes."""
    bit = F.col("token").bitwiseAND(HELD_BITS - 1)
    words = shared.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_pandas()
    out = np.zeros(HELD_BITS // 64, U)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U)
    return out


def _small(keys: DataFrame) -> DataFrame:
    """Written keys, to be broadcast if they are few enough; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _fits(pos: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether a token at ``pos`` of a set of n can be the first shared one with a set of m."""
    return pos <= n - F.ceil(F.lit(percent) * (n + m) / (100 + percent))


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of rows with node, n, pos and node2, n2, pos2 that sizes and positions allow."""
    n, m = F.col("n"), F.col("n2")
    return (
        joined.filter("node <> node2")
        .filter((percent * F.greatest(n, m) <= 100 * F.least(n, m)) & _fits(F.col("pos"), n, m, percent) & _fits(F.col("pos2"), m, n, percent))
        .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        .distinct()
    )


def _links(pairs: DataFrame, heads: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, dropped: Sequence[Accumulator]) -> DataFrame:
    """The pairs that link. Sets are read again only for nodes of pairs that all orders and the histograms allow."""
    of = heads.select("node", "n", "prefixes", "histogram")
    x, y = of.toDF("a", "n", "xs", "x"), of.toDF("b", "m", "ys", "y")
    near = settle(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "xs", "ys", "x", "y").mapInArrow(tidy(_near(percent, dropped)), "a long, b long"))
    sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return settle(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(_verify(percent)), "a long, b long").distinct())


def _across(live: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share a prefix token, a bin of sizes at a time.

    The largest component of a token is only looked up, never paired within itself.
    """
    placed = settle(
        live.join(found.withColumnRenamed("component", "_c"), "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    )
    mixed = (
        placed.groupBy("token", "component")
        .agg(F.count(F.lit(1)).alias("held"))
        .groupBy("token")
        .agg(F.max(F.struct("held", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("token", F.col("most.component").alias("main"))
    )
    rows = settle(placed.join(mixed, "token"))
    size_bin = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(1.1)))
    n = F.col("n")
    # partners of a token at pos have up to (n - pos) * (100 + p) / p - n tokens
    most = F.least(n * 100 / percent, (n - F.col("pos")) * (100 + percent) / percent - n)
    probe = (
        rows.filter("component <> main")
        .withColumn("low", n * percent / 100)
        .withColumn("high", most)
        .filter("high >= low")
        .withColumn("bin", F.explode(F.sequence(size_bin(F.greatest(F.col("low") - 1, F.lit(1.0))), size_bin(F.col("high") + 1))))
        .select("token", "bin", "node", "n", "pos", "component")
    )
    index = rows.select(
        "token", size_bin(n).alias("bin"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2")
    )
    return _pairs(probe.join(index, ["token", "bin"]).filter("component <> component2"), percent)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, dropped: Sequence[Accumulator] = ()) -> DataFrame:
    """doc_id, n_shingles, row_key (a hash of id and text) and component_id of every row of ``docs(doc_id, text)``; other columns are ignored.

    ``component_id`` is the least doc_id reachable by links, its own included. A null, empty or blank
    text has no shingles and links with nothing; fewer than ``width`` words are one shingle. Equal texts
    always share a component. Rows of one doc_id, or of a null one, each give a row; a null doc_id is never
    a component_id unless all of the component are null. An empty table gives an empty table. ``dropped`` may hold
    three counters: candidate pairs that order 1, order 2 and the histogram drop.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text", "doc_id").alias("row_key"))
    spec = "counted boolean, doc_id long, row_key long, node long, n long, histogram binary, prefixes array<binary>"
    profiled = settle(rows.mapInArrow(tidy(_profiles(width)), spec))
    own = profiled.filter("not counted").drop("counted")
    heads = settle(
        own.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"), F.max("histogram").alias("histogram"), F.max("prefixes").alias("prefixes"))
    )
    table = spark.sparkContext.broadcast(_ranking(profiled.filter("counted")))

    spec = "token long, node long, n int, pos int"
    postings = rows.select("text").mapInArrow(tidy(_postings(width, percent, table)), spec)
    shared = settle(postings.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("token"))
    held = spark.sparkContext.broadcast(_held(shared))
    live = rows.select("text").mapInArrow(tidy(_postings(width, percent, table, held)), spec).join(shared, "token", "left_semi")
    live = settle(live.groupBy("token", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        chosen = settle(heads.join(nodes, "node", "left_semi").select("row_key"))
        return settle(rows.join(_small(chosen), "row_key", "left_semi").select("text").mapInArrow(tidy(_tokens(width, table)), "node long, tokens binary"))

    # a node with very many copies is the likeliest centre of a group of near copies
    hubs = live.join(heads.select("node", "copies"), "node").groupBy("token").agg(F.max(F.struct("copies", "node", "n", "pos")).alias("hub"))
    toward = live.join(hubs.select("token", F.col("hub.node").alias("node2"), F.col("hub.n").alias("n2"), F.col("hub.pos").alias("pos2")), "token")
    links = _links(_pairs(toward, percent), heads, sets_of, percent, dropped)
    further = _links(_across(live, components(links), percent), heads, sets_of, percent, dropped)
    # pairs closed by the first links need no second look, so both tables together hold the components
    found = components(links.union(further))

    placed = own.join(found.withColumnRenamed("component", "_c"), "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    least = placed.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component.

    The document with the least doc_id stays (nulls last; of rows that share it, the one whose text hashes least),
    and of repeated rows one. Texts without words all stay.
    """
    found = settle(jaccard_components(docs, width, percent).filter("n_shingles > 0"))
    # components of null ids only have no component_id; each such row key stands for itself
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("row_key")).alias("alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("k")
    )
    kept = kept.select(F.col("k.row_key").alias("row_key"))
    gone = settle(found.select("row_key").distinct().join(kept, "row_key", "left_anti"))
    name = unused(docs, "_row_key")
    keyed = docs.withColumn(name, F.xxhash64("text", F.col("doc_id").cast("long")))
    rows = keyed.join(_small(gone).withColumnRenamed("row_key", name), name, "left_anti")
    again = settle(found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(gone, "row_key", "left_anti").select(F.col("row_key").alias(name)))
    if not again.isEmpty():  # repeated rows of what stays
        once = rows.join(_small(again), name, "left_semi").dropDuplicates([name])
        rows = rows.join(_small(again), name, "left_anti").unionByName(once)
    return rows.drop(name)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
u AS MATERIALIZED (SELECT doc_id, unnest(sh) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT l.b, r.reached FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, n_shingles, min(reached) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL
"""
