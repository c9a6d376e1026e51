"""Exact and fast encoding with byte-level BPE of the tokenizers library: each distinct chunk of white space and word is encoded once and remembered.

The tokenizer's pattern never joins a character that isn't white space to white space after it, nor a letter or digit to punctuation of ASCII after
it, so the ids of a text are the ids of its chunks. A chunk is a run of white space with the run of other characters that follows it, and ends before
punctuation that follows a letter or digit; where a run goes on with a character that is neither, it goes on to white space. So a word is one chunk
whatever punctuation it has after it. Chunks are looked up in a table of bounded size.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import numpy as np

from quarry.llm.common import only_held

#: Fixed value: characters with Unicode's White_Space property.
_WS = "\t-\r \x85\xa0  -     　"
_WS_SET = frozenset(re.findall(f"[{_WS}]", "".join(map(chr, range(0x3001)))))
#: Characters that are letters or digits, and that are none of letters, digits and white space, in every version of Unicode.
_WORD, _MARK = "A-Za-z0-9À-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_CHUNK = re.compile(f"[{_WS}]*+[{_MARK}]*+[{_WORD}]++(?=[{_WS}{_MARK}]|\\Z)|[{_WS}]*+[^{_WS}]+|[{_WS}]+")
#: Entries remembered by a Python worker, and the longest chunk that is remembered.
TABLE_ENTRIES, TABLE_CHARS = 800_000, 48
#: Characters of text whose new chunks are encoded together.
GROUP_CHARS = 2_000_000


class ChunkEncoder:
    """Encodes texts to ids as little-endian bytes of the narrowest unsigned type for the vocabulary."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode new chunks: those that begin with white space and end with another character as one text, whose ids are then cut at the chunks' ends."""
        apart = [c for c in chunks if c[0] not in _WS_SET or c[-1] in _WS_SET]
        out = dict(zip(apart, (x.tobytes() for x in self._ids(apart)), strict=True))
        whole = [c for c in chunks if c not in out]
        if whole:
            ids = self._ids(["".join(whole)])[0]
            ends = np.cumsum([len(c.encode()) for c in whole])
            cuts = np.searchsorted(np.cumsum(self.byte_lengths()[ids]), ends, side="left") + 1
            raw, width = ids.tobytes(), self.dtype.itemsize
            at = (cuts * width).tolist()
            out.update((c, raw[i:j]) for c, i, j in zip(whole, [0, *at], at, strict=False))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text; equal to the library's own for every text."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars > GROUP_CHARS:
                out += self._encode(group)
                group, chars = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        table = self.table
        split = [None if any(s in t for s in self.special) else _CHUNK.findall(t) for t in texts]
        new = set().union(*(s for s in split if s)).difference(table)
        fresh = self._learn(list(new)) if new else {}
        table.update(fresh)
        out = [self._ids([t])[0].tobytes() if s is None else b"".join(map(table.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        for c in fresh:
            if len(c) > TABLE_CHARS:
                del table[c]
        return out

    def byte_lengths(self) -> np.ndarray:
        """The number of UTF-8 bytes that each id stands for: one per character of a byte-level piece, all bytes of an added token."""
        return self._byte_lengths

    @cached_property
    def _byte_lengths(self) -> np.ndarray:
        lengths = np.zeros(self.size, dtype=np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            lengths[i] = len(piece.encode()) if piece in self.special else len(piece)
        return lengths


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python process."""
    return only_held(("chunks", path), lambda: ChunkEncoder(path))
