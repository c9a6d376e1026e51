"""Token counts per section by offset-mapped attribution: encode a whole document once, join token spans with section spans, share out boundary tokens by a rule.

A byte-level token stands for a run of bytes, so the running sum of the tokens' byte lengths gives each token's span; spans are then counted in
characters, a token that begins or ends inside a character covering it whole. Sections are half-open character intervals that partition the text,
so the interval join is a binary search of the tokens' first and last characters among the sections' starts.

RULES for a token that crosses a boundary: "start", the section of its first character; "end", of its last; "majority", the section with most of
its characters, of equals the first. Every token is counted in exactly one section, so the counts of a document add up to its tokens.

Defined cases: null text is empty: no token, one empty section; a section may be empty and counts 0; repeated rows each yield a row; null doc_id
stays null; other columns are ignored; an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunk_encoding import encoder
from quarry.llm.common import SLICE_BYTES

RULES = ("start", "end", "majority")
COUNTS = "n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, whose byte lengths are given."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if not text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return character[starts], character[ends - 1]
    return starts, ends - 1


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a boundary. starts: where the sections begin, ascending from 0; size: the text's characters."""
    of_first, of_last = (np.searchsorted(starts, x, side="right") - 1 for x in (first, last))
    crossing = np.flatnonzero(of_first != of_last)
    owner = of_last if rule == "end" else of_first
    if rule == "majority" and len(crossing):
        owner = owner.copy()
        stops = np.append(starts[1:], size)
        for k in crossing.tolist():
            inside = slice(of_first[k], of_last[k] + 1)
            shared = np.minimum(stops[inside], last[k] + 1) - np.maximum(starts[inside], first[k])
            owner[k] = of_first[k] + int(np.argmax(shared))
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def line_starts(text: str) -> np.ndarray:
    """Sections are lines, each with its line feed."""
    marks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.concatenate([[0], marks[marks < len(text)]])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices by the bytes of its last column, an array of texts."""
    parts = batch.column(batch.num_columns - 1)
    bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(parts.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = bytes_[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    i = 0
    while i < batch.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))), i + 2000)
        yield batch.slice(i, j - i)
        i = j


def count_tokens(df: DataFrame, tokenizer: str, keys: list[str], text: str | Column | None = None, fields: list[str] | None = None, rule: str = "majority") -> DataFrame:
    """keys with COUNTS. Either the sections are the lines of one text, or the fields, joined by line feeds that belong to the field before (null: empty)."""
    if rule not in RULES or (text is None) == (fields is None):
        raise ValueError("count_tokens takes a rule of RULES and either text or fields")
    columns = [text if isinstance(text, Column) else F.col(text)] if fields is None else [F.col(f).cast("string") for f in fields]
    rows = df.select(*keys, F.array(*[F.coalesce(c, F.lit("")) for c in columns]).alias("_parts"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        lengths = enc.byte_lengths()
        for whole in batches:
            for b in _slices(whole):
                parts = b.column(b.num_columns - 1).to_pylist()
                texts = ["\n".join(p) for p in parts]
                out: list[tuple] = []
                for t, p, ids in zip(texts, parts, enc.encode(texts), strict=True):
                    first, last = token_spans(t, lengths[np.frombuffer(ids, enc.dtype)])
                    starts = line_starts(t) if fields is None else np.cumsum([0, *(len(x) + 1 for x in p[:-1])])
                    counts, crossing = attribute(first, last, starts, len(t), rule)
                    out.append((len(first), len(starts), crossing, counts))
                made = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([x[3] for x in out], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keys, "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return rows.mapInArrow(run, schema)
