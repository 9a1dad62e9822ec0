"""Exact encoding and decoding with a SentencePiece BPE model, by backtracking over longest matches.

Merging is defined by the model: of all neighbours whose joint text is a piece, the pair of the best score
(ties: the leftmost) becomes one symbol, until no pair is left. Two facts make a search from the left exact.
Any run of neighbours in a result is what merging makes of its own text, and a sequence of tokens is the
result if every two neighbours are. So a token may follow another if re-merging their joint text gives the two
back, and each prefix of the text has one valid sequence at most: a position from which nothing led on never
needs a second visit, which a bit field keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barweave.llm.memo import Generations
from barweave.llm.words import slices

SPACE = "▁"  #: stands for a space inside the model
ID = np.dtype("<i4")
MEMO_BYTES = 64 << 20  #: of each of two generations of remembered parts of text
PAIRS = 1 << 18  #: remembered verdicts on two tokens
SLICE_BYTES = 1 << 18
MARKS = frozenset(".,;:!?)\"'")
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what an unknown id reads as
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
BPE = 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class Model:
    """A BPE model file: pieces with scores, bytes for what no piece covers.

    Models of another kind, with a normaliser that rewrites texts, or with user-defined or unused pieces, raise.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer, normal = ({k: v for part, raw in parts if part == number for k, v in fields(raw)} for number in (2, 3))
        pieces = [dict(fields(raw)) for part, raw in parts if part == 1]
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        rewrites = normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1)
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or rewrites or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is no BPE model with bytes for unknown characters and texts as they are")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.score = {t: float(np.frombuffer(pieces[i].get(2, b"\0\0\0\0"), "<f4")[0]) for t, i in self.ids.items()}
        self.of_byte = [0] * 256
        for i, (t, k) in enumerate(zip(self.texts, self.kinds)):
            if k == BYTE:
                self.of_byte[int(t[1:-1], 16)] = i
        self.joined = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}  #: neighbouring characters of some piece
        self.cut = not any(j[1] == SPACE != j[0] for j in self.joined)  #: no piece has a space after a non-space
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t[::-1], t)
        self.automaton.make_automaton()
        self.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), t[0] if len(t) > 1 else None) for t in self.ids}
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.memo = Generations(MEMO_BYTES, self._part)
        surface = [{CONTROL: "", UNKNOWN: UNKNOWN_SURFACE}.get(k, t.replace(SPACE, " ")).encode() for t, k in zip(self.texts, self.kinds)]
        for b, i in enumerate(self.of_byte):
            surface[i] = bytes([b])
        self.spaced = np.array([t.startswith(SPACE) and k == NORMAL for t, k in zip(self.texts, self.kinds)])
        self.visible = np.array([k != CONTROL for k in self.kinds])
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.lengths = np.array(list(map(len, surface)), np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    # encoding

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best pair until none is left. For the short texts of two tokens."""
        symbols = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                value = score.get(symbols[k] + symbols[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves the two tokens as they are, side by side."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self.stands(right) if left[-1] + right[0] not in self.joined else self.merged(left + right) == [left, right]
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def stands(self, token: str) -> bool:
        """Whether merging the token's own text gives the token (a piece may be out of reach)."""
        found = self.alone.get(token)
        if found is None:
            found = self.merged(token) == [token]
            if token in self.ids:
                self.alone[token] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text whose spaces are escaped; a character without a piece stands for itself."""
        size = len(text)
        longest: list[str | None] = [None] * size
        last = -1
        for end, piece in self.automaton.iter(text[::-1]):
            if end != last:  # the longest match comes first
                longest[size - 1 - end] = piece
                last = end
        failed = bytearray((size >> 3) + 1)
        shorter, fits, out, pos = self.shorter, self.fits, [], 0
        token = longest[0] or text[0] if size else None
        while pos < size:
            end = pos + len(token)
            if not failed[end >> 3] >> (end & 7) & 1 and ((fits.get((out[-1], token)) or self.may_follow(out[-1], token)) if out else self.stands(token)):
                out.append(token)
                pos = end
                if pos < size:
                    token = longest[pos] or text[pos]
                continue
            token = shorter.get(token)
            while token is None:  # nothing leads on from here: step back and shorten what led here
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
                token = shorter.get(token)
        return out

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for t in self.tokens(text):
            i = self.ids.get(t)
            if i is None:
                out.extend(self.of_byte[b] for b in t.encode())
            else:
                out.append(i)
        return np.array(out, ID).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part of text behind a space. A mark at its end that no piece joins to what stands before goes apart."""
        if len(part) > 1 and part[-1] in MARKS and part[-2:] not in self.joined:
            return self.memo[part[:-1]] + self._ids(part[-1])
        return self._ids(SPACE + part)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. A model whose pieces have spaces only in front is asked for each part between
        spaces, and equal parts once for as long as they are remembered."""
        if not text:
            return np.zeros(0, ID)
        text = text.replace(" ", SPACE)
        if not self.cut:
            return np.frombuffer(self._ids(SPACE + text), ID)
        parts = text.split(SPACE)
        if "" in parts:  # a run of spaces belongs to the part behind it
            joined, run = [], 0
            for part in parts[:-1]:
                if part:
                    joined.append(SPACE * run + part)
                    run = 0
                else:
                    run += 1
            parts = [*joined, SPACE * run + parts[-1]]
        return np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), ID)

    # decoding

    def surfaces(self, ids: np.ndarray, bounds: np.ndarray, front: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the texts of sequences of ids without control ids.

        The space that encoding puts in ``front`` goes, if the first piece begins with one. Bytes that form no
        character are left as they are; see `text_of`.
        """
        sizes = self.lengths[ids]
        begins = self.begins[ids]
        first = bounds[:-1][bounds[:-1] < bounds[1:]] if front else bounds[:0]
        first = first[self.spaced[ids[first]]]
        begins[first] += 1
        sizes[first] -= 1
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(begins - ends[:-1], sizes)
        return self.flat[at], ends[bounds]

    @staticmethod
    def text_of(data: bytes) -> str:
        """Text of bytes; each byte that is in no character is replaced."""
        out = []
        while True:
            try:
                out.append(data.decode())
                return "".join(out)
            except UnicodeDecodeError as e:
                out.append(data[: e.start].decode() + "�")
                data = data[e.start + 1 :]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids show nothing and part the bytes on their sides."""
        out = []
        given = np.array(ids, np.int64)
        hidden = np.flatnonzero(~self.visible[given]) if len(ids) else given
        for run in np.split(given, hidden):
            run = run[self.visible[run]]
            if len(run):
                data, _ = self.surfaces(run, np.array([0, len(run)]), not out)
                out.append(self.text_of(data.tobytes()))
        return "".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """One per worker process, so that what it remembers serves all its tasks."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _strings(bpe: Model, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data, ends = bpe.surfaces(ids, bounds)
    made = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
    try:
        made.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        made = pa.array([bpe.text_of(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
    return made.cast(pa.string())


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES):
                raw, at = part.data.tobytes(), part.bounds.tolist()
                rows = [bpe.encode(raw[a:b].decode()) for a, b in zip(at[:-1], at[1:])]
                ids = np.concatenate(rows)
                bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(part.first, len(rows)), "ids": lists, "decoded": _strings(bpe, ids, bounds)})

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs(doc_id, text)``: all ids of its text, and the text that they read as.

    A null or empty text has no ids and reads as empty. Rows of one doc_id stay apart; other columns are ignored.
    A text is taken whole; a part between spaces of any length is searched in time that grows with it. The file at
    ``path`` must be there on every executor, as an installed package is.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path), f"doc_id {kind}, ids array<int>, decoded string")
