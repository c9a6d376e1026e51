"""Content hashes, chunk identifiers and token estimates."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Name space of chunk identifiers; a configuration may give another.
NAMESPACE = "5b0c6d1e-93f4-5d0b-8a57-7a2f6f1f1c3e"


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """64 hexadecimal digits of the UTF-8 text: sha256 stays in the JVM; blake3 runs in Arrow batches."""
    if algorithm == "sha256":
        return F.sha2(text.cast("binary"), 256)
    if algorithm == "blake3":
        return _blake3(text)
    raise ValueError(f"no hash algorithm {algorithm!r}")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(repo, path, symbol_path, byte_start, byte_end, hashed, namespace: str = NAMESPACE) -> Column:
    """The identifier that a chunk keeps as long as place and content stay."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (repo, path, symbol_path, byte_start, byte_end, hashed)]
    return uuid5(F.concat_ws(":", *[c.cast("string") for c in cols]), namespace)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def multimodal_token_estimate(text: Column, data_base64: Column, remote: bool = True) -> Column:
    """Remote models count an image as 258 tokens and a thousandth of its data; the local one counts text, or 10 without any."""
    if remote:
        return F.coalesce(token_estimate(text), F.lit(0)) + 258 + F.floor(F.octet_length(data_base64) / 1000).cast("long")
    return F.coalesce(token_estimate(text), F.lit(10))


#: Initial state and word order of the published hash function.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_QUADS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, words, counter: int, size: int, flags: int) -> list[int]:
    mask = 0xFFFFFFFF
    v = [*cv, *_IV[:4], counter & mask, counter >> 32, size, flags]
    words = list(words)
    for _ in range(7):
        for q, (a, b, c, d) in enumerate(_QUADS):
            for word, r1, r2 in ((words[2 * q], 16, 12), (words[2 * q + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & mask
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << (32 - r1)) & mask
                v[c] = (v[c] + v[d]) & mask
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << (32 - r2)) & mask
        words = [words[k] for k in _ORDER]
    return [x ^ y for x, y in zip(v[:8], v[8:], strict=True)]


def blake3_hex(data: bytes) -> str:
    """BLAKE3-256 in plain Python, for parity with stores that were filled with it."""

    def chunk(part: bytes, index: int, last: int) -> list[int]:
        cv = list(_IV)
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, block in enumerate(blocks):
            flags = _START * (i == 0) | (_END | last) * (i == len(blocks) - 1)
            cv = _compress(cv, struct.unpack("<16I", block.ljust(64, b"\0")), index, len(block), flags)
        return cv

    def tree(first: int, n: int, last: int) -> list[int]:
        if n == 1:
            return chunk(data[first * 1024 : (first + 1) * 1024], first, last)
        left = 1 << (n - 1).bit_length() - 1
        return _compress(_IV, tree(first, left, 0) + tree(first + left, n - left, 0), 0, 64, _PARENT | last)

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), _ROOT)).hex()


@F.pandas_udf(StringType())
def _blake3(texts: pd.Series) -> pd.Series:
    try:
        from blake3 import blake3

        digest = lambda t: blake3(t.encode()).hexdigest()
    except ImportError:
        digest = lambda t: blake3_hex(t.encode())
    return texts.map(lambda t: None if t is None else digest(t))
