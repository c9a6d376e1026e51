"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi over each text.

At each position the automaton's output links list the pieces that end there; each relaxes the best score of the position from the one where it
begins. In a unigram model every such arc is open and the best sum of scores wins. A BPE model's result is not the best sum of its scores, but its
arcs can be told locally: a piece t may follow u just if the merges, run on u + t alone, leave the two. An arc that fails this scores minus infinity.
A sequence whose neighbours all pass is the whole text's result, and each prefix has one such sequence (merges inside a prefix don't depend on what
follows), so the same relaxation gives exactly the library's ids. Which pairs pass is found by running the merges on the pair once, and remembered.

Where no piece has a space mark after another character, texts fall apart at space marks, and each part is encoded once and remembered in a table
of bounded size.

Defined cases: null text is empty and has no ids; characters without a piece become byte pieces, or the unknown id in models without them; null
doc_id stays null; repeated rows each yield a row; an empty table yields no row; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, byte_slices, only_held

#: The space mark, and of the model file the field numbers and codes that are read.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The score of an arc that may not be taken.
CLOSED = float("-inf")
#: Entries remembered by a Python worker, and the longest part that is remembered.
TABLE_ENTRIES, TABLE_CHARS, PAIR_ENTRIES = 600_000, 48, 1_000_000


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[i]
        i += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, i
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0
    while i < len(raw):
        key, i = _varint(raw, i)
        if key & 7 == 0:
            value, i = _varint(raw, i)
        else:
            size, i = _varint(raw, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """A model file's pieces, with encode and decode for texts."""

    def __init__(self, path: str | None = None, raw: bytes | None = None):
        import ahocorasick

        if raw is None:
            with open(path, "rb") as f:
                raw = f.read()
        pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, collapse, rules, escape = UNIGRAM, True, True, b"", True
        for number, value in _fields(raw):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                rules, self.dummy_prefix, collapse, escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        if rules or collapse or not escape or self.kind not in (UNIGRAM, BPE) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("this model's normaliser, type or pieces are not supported")
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if all(MARK not in p.lstrip(MARK) for p in self.ids) else re.compile("(?s).+")
        self.table: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merges(self, text: str) -> list[str]:
        """The pieces that a BPE model leaves of a short text: the best-scored neighbours merge first, of equals the leftmost."""
        at = list(text)
        scores = self.scores
        while len(at) > 1:
            best, where = None, -1
            for k in range(len(at) - 1):
                s = scores.get(at[k] + at[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if where < 0:
                break
            at[where : where + 2] = [at[where] + at[where + 1]]
        return at

    def _open(self, u: str, t: str) -> bool:
        known = self.pairs.get((u, t))
        if known is None:
            known = self.merges(u + t) == ([u, t] if u else [t])
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            self.pairs[u, t] = known
        return known

    def _bpe(self, text: str) -> list[str]:
        n = len(text)
        best, last = [0.0] + [CLOSED] * n, [""] + [None] * n  # of each prefix the best score, and the piece that ends it
        done, pairs, scores, worst = 0, self.pairs, self.scores, self.worst

        def alone(j: int) -> None:
            if best[j] == CLOSED:  # no arc into here is open: the character stands alone
                best[j], last[j] = best[j - 1] + worst, text[j - 1]

        for end, t in self.automaton.iter(text):
            while done < end:
                done += 1
                alone(done)
            j = end + 1
            start = j - len(t)
            u = last[start]
            known = pairs.get((u, t))
            value = best[start] + scores[t] if known or known is None and self._open(u, t) else CLOSED
            if value > best[j]:
                best[j], last[j] = value, t
        while done < n:
            done += 1
            alone(done)
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _unigram(self, text: str) -> list[str]:
        n = len(text)
        best, back = [0.0] + [None] * n, [0] * (n + 1)
        scores, worst, done = self.scores, self.worst, 0

        def alone(j: int) -> None:
            if (text[j - 1] not in scores) and (best[j] is None or best[j - 1] + worst > best[j]):
                best[j], back[j] = best[j - 1] + worst, j - 1

        for end, t in self.automaton.iter(text):
            while done < end:
                done += 1
                alone(done)
            j = end + 1
            value = best[j - len(t)] + scores[t]
            if best[j] is None or value > best[j]:
                best[j], back[j] = value, j - len(t)
        while done < n:
            done += 1
            alone(done)
        out = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]

    def _ids(self, part: str) -> bytes:
        out = array(self.code)
        unknown_before = False
        for piece in self._bpe(part) if self.kind == BPE else self._unigram(part):
            i = self.ids.get(piece)
            if i is None and self.bytes:
                out.extend([self.bytes[b] for b in piece.encode()])
            elif i is not None or not unknown_before:  # neighbouring unknown characters share an id
                out.append(self.unknown if i is None else i)
            unknown_before = i is None
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian bytes of dtype."""
        if not text:
            return b""
        parts = self.parts.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))
        table = self.table
        try:
            return b"".join(map(table.__getitem__, parts))
        except KeyError:
            pass
        if len(table) > TABLE_ENTRIES:
            table.clear()
        out = []
        for part in parts:
            ids = table.get(part)
            if ids is None:
                ids = self._ids(part)
                if len(part) <= TABLE_CHARS:
                    table[part] = ids
            out.append(ids)
        return b"".join(out)

    @cached_property
    def _spelled(self) -> list[bytes]:
        """What each id adds to a text."""
        return [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.pieces]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        spelled = self._spelled
        text = b"".join([spelled[i] for i in array(self.code, ids)]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def piece_model(path: str) -> PieceModel:
    """The model of this Python process."""
    return only_held(("pieces", path), lambda: PieceModel(path))


def encode(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs with ids array<int>, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip, whether decoding the ids gives the text."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for whole in batches:
            for b in byte_slices(whole, whole.num_columns - 1, 2 * SLICE_BYTES):
                texts = b.column(b.num_columns - 1).to_pylist()
                raw = [m.encode(t) for t in texts]
                ids = [np.frombuffer(x, m.dtype).astype("<u4") for x in raw]
                sizes = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                made = [lists, pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([m.decode(x) == t for x, t in zip(raw, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, "ids", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns keep of encoded with text, decoded from ids (null: empty)."""
    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("_ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches:
            texts = [m.decode(np.array(x, m.dtype).tobytes()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)
