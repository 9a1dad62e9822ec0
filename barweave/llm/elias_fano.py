"""Elias-Fano coded ascending integers: low bits packed, high bits in unary, sampled select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<qqQQ")  #: count, least value, width of the low part in bits, bytes of the unary part


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of every value, least bit first, without gaps."""
    if not width:
        return b""
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values, so blocks end on whole bytes
        part = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :width].reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """Values ``first`` to ``first + count`` of what `pack` wrote."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    a, b = first * width, (first + count) * width
    bits = np.unpackbits(data[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, width)
    full = np.zeros((count, 64), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(count)


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending int64 sequence (repeats allowed): about 2 + log2(span / count) bits a value."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return HEAD.pack(0, 0, 0, 0)
    least = int(values[0])
    up = values.astype(np.uint64) - np.array([least]).astype(np.uint64)
    width = max(0, int(up[-1] // np.uint64(len(up))).bit_length() - 1)
    ones = (up >> np.uint64(width)).astype(np.int64) + np.arange(len(up))
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    high = np.packbits(unary, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<i8").tobytes()
    return HEAD.pack(len(up), least, width, len(high)) + samples + high + pack(up, width)


class Sequence:
    """Random access to encoded values; ``data`` may be a memory-mapped file."""

    def __init__(self, data: bytes | memoryview | np.ndarray):
        data = np.frombuffer(data, np.uint8)
        self.count, self.least, self.width, high = HEAD.unpack(data[: HEAD.size].tobytes())
        at = HEAD.size + 8 * -(-self.count // SAMPLE)
        self.samples = data[HEAD.size : at].view("<i8")
        self.high = data[at : at + high]
        self.low = data[at + high :]

    def _ones(self, first: int, count: int) -> np.ndarray:
        """Places of ones ``first`` to ``first + count`` in the unary part, read from the sample before."""
        block = first // SAMPLE
        a = int(self.samples[block])
        after = -(-(first + count) // SAMPLE)
        b = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[a // 8 : -(-b // 8)], bitorder="little")
        places = np.flatnonzero(bits[a % 8 :]) + a
        return places[first - block * SAMPLE :][:count]

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Values ``first`` to ``first + count``."""
        count = min(count, self.count - first)
        if count <= 0:
            return np.zeros(0, np.int64)
        high = (self._ones(first, count) - np.arange(first, first + count)).astype(np.uint64)
        up = (high << np.uint64(self.width)) | unpack(self.low, self.width, first, count)
        return (up + np.array([self.least]).astype(np.uint64)).astype(np.int64)
