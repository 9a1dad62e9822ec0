"""Token ids of all texts in binary shards with Elias-Fano coded document boundaries.

A shard is one file: the ids of its documents one after the other (two bytes each where the
vocabulary allows, else four), then the coded boundaries, the coded doc_ids, and a footer that says
where each part begins. Shards follow each other in ascending doc_id order. Boundaries cost about
2 + log2(mean length) bits a document instead of a table of 64-bit offsets.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.elias_fano import Sequence, encode
from barweave.llm.piece_table import Table, take
from barweave.llm.words import BYTE, Text, U, mix, rolled, slices, span_hash, tidy
from barweave.session import workspace

END_ID = 0
FOOTER = "<8sQQQQQQ"  #: magic, bytes of an id, ids, null doc_ids, where boundaries, doc_ids and the footer begin
MAGIC = b"BWTOKID1"
SLICE_BYTES, BLOCK_IDS = 1 << 18, 1 << 20


BLANK = np.zeros(256, bool)  #: ASCII bytes that some Unicode definition of white space holds
BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
ASCII = np.arange(256) < 128
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
MARK = np.isin(np.arange(256), list(b".,;:!?"))
OTHER = mix(np.arange(1001, 1257))  #: a second value for every byte, so that pieces are told apart by 96 bits


class Encoder:
    """Ids of whole texts with a byte-level BPE file, encoding every distinct piece of text once.

    The pre-tokenizer of these files never joins across some places, so the pieces between them are encoded
    apart: before a space that follows a non-space, between a letter and a punctuation mark after it
    (apostrophes aside), and behind a single line end between non-spaces.
    """

    SIMPLE = re.compile(r"[^ ]*[^ \s]\Z")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer.__class__.__name__
        if kind != "ByteLevel":
            raise ValueError(f"a byte-level tokenizer is needed, {path} has {kind}")
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        self.table = Table(self.dtype)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str], bare: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces, bare or after a space. Simple pieces share a call: only their first
        token begins with a space."""
        out: list = [None] * len(pieces)
        simple, odd = [], []
        for k, (piece, alone) in enumerate(zip(pieces, bare, strict=True)):
            (simple if not alone and self.SIMPLE.match(piece) else odd).append(k)
        blocks = [simple[k : k + 256] for k in range(0, len(simple), 256)]
        for block, ids in zip(blocks, self._encode([" " + " ".join([pieces[k] for k in b]) for b in blocks]), strict=True):
            got = np.array(ids, self.dtype)
            at = np.flatnonzero(self.spaced[got]).tolist()
            if len(at) == len(block):
                for k, x, y in zip(block, at, [*at[1:], len(got)], strict=True):
                    out[k] = got[x:y]
            else:  # an added token of the file stands in a piece
                odd.extend(block)
        for k, ids in zip(odd, self._encode([pieces[k] if bare[k] else " " + pieces[k] for k in odd]), strict=True):
            out[k] = np.array(ids, self.dtype)
        return np.concatenate([*out, np.zeros(0, self.dtype)]), np.fromiter(map(len, out), np.int64, len(out))

    @staticmethod
    def cuts(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bare) of the pieces of some texts; a space before a piece that is not bare is no part of it."""
        data, bounds = text.data, text.bounds
        n = len(data)
        blank = BLANK[data]
        before = np.full(n, True)  # nothing is known to be no space before the first byte
        before[1:] = blank[:-1]
        space = np.flatnonzero((data == 0x20) & ~before)
        wide = space[data[space - 1] >= 0x80]  # the character before may be a space of several bytes
        if len(wide):
            two, three = data[wide - 2], data[np.maximum(wide - 3, 0)]
            odd = (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))
            space = np.setdiff1d(space, wide[odd], assume_unique=True)
        mark = np.flatnonzero(LETTER[data[:-1]] & MARK[data[1:]]) + 1 if n else space
        solid = ASCII[data] & ~blank
        line = np.flatnonzero((data[1:-1] == 0x0A) & solid[:-2] & solid[2:]) + 2 if n > 2 else space
        kind = np.zeros(n + 1, np.int8)  # 1: a space to leave out, 2: a bare piece begins
        kind[space], kind[mark], kind[line] = 1, 2, 2
        heads = bounds[:-1][np.diff(bounds) > 0]
        kind[heads] = 2
        start = np.flatnonzero(kind[:n])
        end = np.append(start[1:], n)[: len(start)]
        bare = kind[start] == 2
        return start + ~bare, end, bare

    def ids_of(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, and the number of ids of every text."""
        start, end, bare = self.cuts(text)
        runs, sizes = [], []
        step = np.searchsorted(start, np.arange(0, len(text.data), SLICE_BYTES)).tolist() if len(start) else []
        for a, b in zip(step, [*step[1:], len(start)]):
            if a < b:
                ids, size = self._some(text.data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a], bare[a:b])
                runs.append(ids)
                sizes.append(size)
        total = np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))))
        # a bare piece begins with its text, any other behind a space of it: both stand inside
        per_text = np.diff(total[np.searchsorted(start - ~bare, text.bounds)])
        return np.concatenate([*runs, np.zeros(0, self.dtype)]), per_text

    def _some(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = span_hash(rolled(BYTE[data]), start, end)
        key[bare] = mix(key[bare] + U(1))
        key[key == 0] = U(1)  # 0 marks a free slot
        check = (span_hash(rolled(OTHER[data]), start, end) >> U(32)).astype(np.uint32)
        at = self.table.find(key, check)
        known = at >= 0
        begins, sizes = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        begins[known], sizes[known] = self.table.begin[at[known]], self.table.size[at[known]]
        pool = self.table.pool
        missing = np.flatnonzero(~known)
        if len(missing):
            both = np.stack((key[missing], check[missing].astype(U)), axis=1)
            order = np.lexsort((both[:, 1], both[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (both[order[1:]] != both[order[:-1]]).any(axis=1)
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            first = missing[order[new]]
            raw = data.tobytes()
            pieces = [raw[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            ids, n = self._new(pieces, bare[first].tolist())
            begins[missing], sizes[missing] = (self.table.filled + np.cumsum(n) - n)[which], n[which]
            out = take(np.concatenate((pool[: self.table.filled], ids)), begins, sizes)
            self.table.add(key[first], check[first], ids, n)
            return out, sizes
        return take(pool, begins, sizes), sizes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.ids_of(t) for t in slices(pa.array(texts, pa.large_string()), SLICE_BYTES)]
        return np.concatenate([*(p[0] for p in parts), np.zeros(0, self.dtype)]), np.concatenate([*(p[1] for p in parts), np.zeros(0, np.int64)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that its pieces serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Shard:
    number: int
    path: str
    docs: int
    ids: int


def _writer(folder: str, tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/ids-{number:06d}.bin"
        # another attempt at this task writes the same bytes under a name of its own
        draft = f"{root}/_draft-{number:06d}-{uuid.uuid4().hex}"
        lengths, doc_ids, nulls = [], [], 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                ids_of = batch.column("doc_id")
                nulls += ids_of.null_count
                doc_ids.append(ids_of.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                for text in slices(batch.column("text"), SLICE_BYTES):
                    ids, n = enc.ids_of(text)
                    ends = np.cumsum(n)
                    out.write(np.insert(ids, ends, END_ID).astype(enc.dtype).tobytes())
                    lengths.append(n + 1)
            n = np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(n)))
            at = enc.dtype.itemsize * int(bounds[-1])
            coded, named = encode(bounds), encode(np.concatenate([*doc_ids, np.zeros(0, np.int64)]))
            out.write(coded + named)
            out.write(struct.pack(FOOTER, MAGIC, enc.dtype.itemsize, int(bounds[-1]), nulls, at, at + len(coded), at + len(coded) + len(named)))
        fs.move(draft, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "docs": pa.array([len(n)], pa.int64()), "ids": pa.array([int(bounds[-1])], pa.int64())})

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> list[Shard]:
    """Encode ``docs(doc_id, text)`` and write one file for every range of doc_ids; other columns are ignored.

    A null or empty text is one end id. Null doc_ids come first; rows of one doc_id follow each other in the
    order of a hash of their text. An empty table gives no shard. The folder must be one that all executors
    reach; it is a new one in the shared folder unless given. Only one row a shard comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or workspace(spark, "token-ids")
    tie = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = ranged.mapInArrow(tidy(_writer(folder, tokenizer_path)), "shard long, docs long, ids long").filter("docs > 0").collect()
    root = folder.rstrip("/")
    return [Shard(r.shard, f"{root}/ids-{r.shard:06d}.bin", r.docs, r.ids) for r in sorted(made)]


class Reader:
    """One shard: offsets by select, ids by range; nothing but the coded parts is held."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        magic, self.item, self.ids, self.nulls, a, b, c = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        self.bounds, self.names = Sequence(self.file.read_at(b - a, a)), Sequence(self.file.read_at(c - b, b))
        self.docs = self.bounds.count - 1

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        none = max(0, min(self.nulls - first, count))
        return [None] * none + self.names.select(max(0, first - self.nulls), count - none).tolist()

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids at places ``first`` to ``last`` of the shard."""
        return np.frombuffer(self.file.read_at((last - first) * self.item, first * self.item), f"<u{self.item}")


def _reader(shards: list[Shard], bases: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard = Reader(shards[k].path)
                for first in range(0, shard.docs, 4096):
                    count = min(4096, shard.docs - first)
                    at = shard.bounds.select(first, count + 1)
                    crc = []
                    block, low = np.zeros(0, np.uint16), int(at[0])
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        value = 0
                        while a < b:  # a document longer than a block is read in parts
                            if a - low >= len(block):
                                block, low = shard.read(a, min(shard.ids, a + BLOCK_IDS)), a
                            part = block[a - low : b - low]
                            value = zlib.crc32(part.astype("<u4").tobytes(), value)
                            a += len(part)
                        crc.append(value)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.doc_ids(first, count), pa.int64()),
                            "start": pa.array(at[:-1] + bases[k]),
                            "n_tokens": pa.array(np.diff(at)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    return run


def read_shards(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files, a task for each shard."""
    bases = np.concatenate(([0], np.cumsum([s.ids for s in shards]))).astype(int).tolist()
    places = spark.range(0, len(shards), 1, max(1, len(shards)))
    return places.mapInArrow(tidy(_reader(shards, bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of all documents and describe each from the files read back."""
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer_path))
