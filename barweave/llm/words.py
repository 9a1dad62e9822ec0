"""Words, shingles and bounded slices of Arrow text columns, computed on the byte buffer.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide and depend on the
bytes only, so they agree between tasks, runs and machines. A slice holds 256 KB of text at most
(one longer text stands alone), which bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: every ASCII byte that is no letter or digit separates words
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tidy(run: Callable) -> Callable:
    """A task function that gives freed memory back when it ends: workers outlive their tasks and serve all stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; elsewhere nothing is to be done
            if trim:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (a bijection)."""
    x = x.astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        step = np.full(size, U(base))
        step[0] = 1
        have = np.cumprod(step)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Text:
    """The bytes of some texts; text i spans bytes bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    bounds: np.ndarray
    first: int  #: row of the batch that text 0 comes from


@dataclass
class Words:
    doc: np.ndarray  #: text of each word, ascending
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray  #: number of words of every text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a text column without nulls, uncopied."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), at


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, fold: bool = False) -> Iterator[Text]:
    """Consecutive runs of texts of about ``size`` bytes, lower-cased on request. A null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    data, at = _bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        if fold:
            own, to = _bytes(pc.utf8_lower(column.slice(first, last - first)))
            yield Text(own[to[0] : to[-1]], to - to[0], first)
        else:
            yield Text(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def runs(batch: pa.RecordBatch, size: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, with about ``size`` bytes of text at a time, uncopied."""
    for text in slices(batch.column("text"), size):
        yield batch.slice(text.first, len(text.bounds) - 1)


def rolled(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE ** i, one longer than the input."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans from the prefix sums of `rolled`, whatever their place."""
    shift = powers(INVERSE, len(prefix))[start]
    return mix((prefix[end] - prefix[start]) * shift + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(text: Text, lower: bool = True, separators: np.ndarray = SPACE) -> Words:
    data, bounds = text.data, text.bounds
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    solid = ~separators[data]
    before = np.concatenate(([False], solid[:-1])) if n else solid
    after = np.concatenate((solid[1:], [False])) if n else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    prefix = rolled(BYTE[LOWER[data] if lower else data])
    return Words(doc, start, end, span_hash(prefix, start, end), np.bincount(doc, minlength=len(bounds) - 1))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every window of ``width`` words; a text of fewer words, but at least one,
    gives one shingle of its whole sequence."""
    n = len(w.hash)
    count = max(0, n - width + 1)
    value = np.zeros(count, U)
    for k in range(width):
        value = value * U(BASE) + w.hash[k : k + count]
    inside = w.doc[:count] == w.doc[width - 1 :] if count else np.zeros(0, bool)
    doc, value = w.doc[:count][inside], mix(value[inside])
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(w.per_doc)))
        tail = np.zeros(len(short), U)
        for k in range(width - 1):
            more = w.per_doc[short] > k
            tail[more] = tail[more] * U(BASE) + w.hash[first[short[more]] + k]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix(tail + w.per_doc[short].astype(U))))
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def distinct(doc: np.ndarray, value: np.ndarray, texts: int) -> list[np.ndarray]:
    """Sorted distinct values of every text; ``doc`` is ascending."""
    at = np.searchsorted(doc, np.arange(texts + 1))
    return [np.unique(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
