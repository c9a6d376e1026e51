"""Language-model scores by context-tree weighting over bytes, trained on all training rows, beside a smoothed unigram base.

Model: each byte is eight binary decisions, most significant bit first; each of the 255 decision nodes has a context tree over the DEPTH bytes before.
A tree node weighs its own Krichevsky-Trofimov estimate against the product of its children, half and half; with the training counts fixed, the
predictive probability of a bit is the mixture of the estimates along the path, each depth with its posterior weight, and one half where training
never was. A text is its UTF-8 bytes with A-Z in lower case and a zero byte as end; before it stand zero bytes.

Plan: rows are dealt to blocks of about BLOCK_BYTES. Each block lists its distinct grams (context and byte) and distinct tokens with their training
counts, dealt to buckets: grams by the two bytes before the last, so that a bucket holds whole subtrees below depth 2. A bucket sums the counts of all
blocks and answers each block in the order of its list: tokens with counts, grams with log-probabilities. Between lies a pass that weighs the
subtrees up to depth 2 and sums them to at most 256 * 255 nodes of depth 1, which go through the driver to all buckets. Blocks then add up their rows.
Log-probabilities travel as 32-bit floats, and are added up in double precision.
What is gathered grows with the distinct grams and tokens; no task holds more than a block, or a bucket's share of all blocks.

Defined cases: null text is empty: one token, the end; null doc_id trains and is not held out; repeated rows train as often as they occur and each
yields a row; without training rows the counts are 0 and every bit has probability one half; an empty table yields no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, folded_words, mix, text_bytes, word_hashes

#: Buckets per block keep a bucket's trees small beside a block.
DEPTH, BLOCK_BYTES, CHUNK_BYTES, SPREAD = 5, 24 << 20, 2 << 20, 4
TOKENS, GRAMS = 0, 1
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
_LISTS = "kind int, bucket int, block int, keys binary, counts binary"
_ANSWERS = "kind int, bucket int, block int, answer binary, total long, distinct long"
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    rise = np.ones_like(y)
    for k in range(8):
        rise = rise * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(rise)


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of values for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision nodes (1 to 255) and bits of bytes, each of shape (8, n)."""
    level = np.arange(8, dtype=np.uint64)[:, None]
    nodes = (np.uint64(1) << level) | (symbols[None, :] >> (np.uint64(8) - level))
    return nodes, (symbols[None, :] >> (np.uint64(7) - level)) & np.uint64(1)


def _nodes(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of grams with counts the nodes of a depth, (context << 8 | decision node), with their zeros and ones."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    nodes, bits = decisions(grams & np.uint64(255))
    keys = ((context << np.uint64(8))[None, :] | nodes).reshape(-1)
    ones = (bits * counts.astype(np.uint64)).reshape(-1).astype(np.float64)
    return summed(keys, np.tile(counts.astype(np.float64), 8) - ones, ones)


def weigh(grams: np.ndarray, counts: np.ndarray, top: int) -> dict[int, tuple]:
    """For each depth from DEPTH up to top: nodes, zeros, ones, log-probability by weighting, and the own estimate's posterior weight."""
    out: dict[int, tuple] = {}
    for depth in range(DEPTH, top - 1, -1):
        keys, a, b = _nodes(grams, counts, depth)
        own = kt_log(a, b)
        if depth == DEPTH:
            out[depth] = keys, a, b, own, np.ones(len(keys))
            continue
        child_keys, _, _, child, _ = out[depth + 1]
        context = (child_keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
        parents, product = summed(context << np.uint64(8) | child_keys & np.uint64(255), child)
        log = np.logaddexp(_HALF + own, _HALF + product)
        out[depth] = keys, a, b, log, np.exp(_HALF + own - log)
    return out


def weigh_top(rows: list[tuple[int, float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of depth-1 nodes (byte << 8 | decision node) with zeros, ones and the product of their children's log-probabilities: for each
    of 256 * 256 nodes the probability gathered by depths 0 and 1 for a one, and the weight left for what is deeper."""
    a, b, product = (np.zeros(1 << 16) for _ in range(3))
    for key, zeros, ones, log in rows:
        a[key], b[key], product[key] = zeros, ones, log
    own = kt_log(a, b)
    seen = a + b > 0
    log = np.where(seen, np.logaddexp(_HALF + own, _HALF + product), 0.0)
    share = np.where(seen, np.exp(_HALF + own - log), 1.0)
    a0, b0, product0 = (x.reshape(256, 256).sum(axis=0) for x in (a, b, log))
    own0 = kt_log(a0, b0)
    seen0 = a0 + b0 > 0
    share0 = np.where(seen0, np.exp(_HALF + own0 - np.logaddexp(_HALF + own0, _HALF + product0)), 1.0)
    gathered = np.tile(share0 * (b0 + 0.5) / (a0 + b0 + 1), 256)
    left = np.tile(1 - share0, 256)
    return gathered + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)


def log_probabilities(grams: np.ndarray, tree: dict[int, tuple], gathered: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context."""
    nodes, bits = decisions(grams & np.uint64(255))
    at = ((grams >> np.uint64(8)) & np.uint64(255)).astype(np.int64) << 8
    out = np.zeros(len(grams))
    for level in range(8):
        place = at | nodes[level].astype(np.int64)
        p, rest = gathered[place], left[place]
        for depth in range(2, DEPTH + 1):
            keys, a, b, _, share = tree[depth]
            wanted = ((grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | nodes[level]
            k = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            if not len(keys):
                continue
            there = keys[k] == wanted
            own = np.where(there, (b[k] + 0.5) / (a[k] + b[k] + 1), 0.5)
            w = np.where(there, share[k], 1.0)
            p = p + rest * w * own
            rest = rest * (1 - w)
        p = p + rest * 0.5
        out += np.log10(np.where(bits[level] == 1, p, 1 - p))
    return out


class _Chunks:
    """A block's rows in chunks: for each chunk its rows, their grams and their token hashes."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()

    def __iter__(self):
        text = self.table.column("text").combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        sizes = np.asarray(pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        of = np.cumsum(sizes) // CHUNK_BYTES
        for c in np.unique(of):
            rows = np.flatnonzero(of == c)
            start, n = int(rows[0]), len(rows)
            raw, offsets = text_bytes(text.slice(start, n))
            low, starts, ends, words = folded_words(raw, offsets)
            size = np.diff(offsets)
            padded = np.zeros(len(low) + n * (DEPTH + 1), np.uint8)
            of_row = np.repeat(np.arange(n), size)
            padded[np.arange(len(low)) + of_row * (DEPTH + 1) + DEPTH] = low
            ends_at = np.cumsum(size + DEPTH + 1)
            grams = np.zeros(len(padded) - DEPTH, np.uint64)
            for k in range(DEPTH + 1):
                grams = (grams << np.uint64(8)) | padded[k : len(padded) - DEPTH + k]
            # places whose gram would reach into the row before are no predictions
            valid = np.ones(len(grams), bool)
            for row_end in (ends_at[:-1, None] - DEPTH + np.arange(DEPTH)[None, :]).reshape(-1):
                valid[row_end] = False
            yield start, n, grams[valid], np.concatenate([[0], np.cumsum(size + 1)]), word_hashes(low, starts, ends), words


def packed(values: np.ndarray) -> bytes:
    """An array's bytes by place, all first bytes before all second ones, compressed: sorted grams have few distinct leading bytes."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 3)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _lists(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    bucket = bucket_of(kind, keys, buckets)
    order = np.lexsort((keys, bucket))
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    present = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    return pa.table(
        {
            "kind": pa.array([kind] * len(present), pa.int32()),
            "bucket": pa.array(present, pa.int32()),
            "block": pa.array([block] * len(present), pa.int32()),
            "keys": pa.array([packed(keys[cuts[k] : cuts[k + 1]]) for k in present], pa.binary()),
            "counts": pa.array([packed(counts[cuts[k] : cuts[k + 1]].astype("<u4")) for k in present], pa.binary()),
        }
    )


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == GRAMS else keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _count(table: pa.Table, buckets: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    train = table.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
    found: dict[int, list] = {TOKENS: [], GRAMS: []}
    for start, n, grams, gram_rows, tokens, words in _Chunks(table):
        mine = train[start : start + n]
        for kind, keys, rows in ((GRAMS, grams, gram_rows), (TOKENS, tokens, words)):
            found[kind].append(summed(keys, np.repeat(mine, np.diff(rows))))
    parts = []
    for kind, lists in found.items():
        keys, counts = summed(*(np.concatenate([x[i] for x in lists]) for i in (0, 1)))
        parts.append(_lists(block, kind, keys, counts, buckets))
    return pa.concat_tables(parts)


def _gathered(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a bucket's lists: blocks, their keys, and the distinct keys with their sums."""
    blocks = table.column("block").to_pylist()
    keys = [unpacked(x.as_py(), "<u8") for x in table.column("keys")]
    counts = [unpacked(x.as_py(), "<u4").astype(np.float64) for x in table.column("counts")]
    return blocks, keys, *summed(np.concatenate(keys), np.concatenate(counts))


def _answers(kind: int, bucket: int, blocks: list[int], answers: list[bytes], total: int, distinct: int) -> pa.Table:
    n = len(blocks)
    ints = [pa.array([x] * n, t) for x, t in ((kind, pa.int32()), (bucket, pa.int32()), (total, pa.int64()), (distinct, pa.int64()))]
    return pa.table([ints[0], ints[1], pa.array(blocks, pa.int32()), pa.array(answers, pa.binary()), ints[2], ints[3]], names=["kind", "bucket", "block", "answer", "total", "distinct"])


def _answer_tokens(table: pa.Table) -> pa.Table:
    blocks, lists, keys, counts = _gathered(table)
    answers = [packed(counts[np.searchsorted(keys, x)].astype("<i8")) for x in lists]
    return _answers(TOKENS, table.column("bucket")[0].as_py(), blocks, answers, int(counts.sum()), int((counts > 0).sum()))


def _subtrees(table: pa.Table) -> pa.Table:
    _, _, keys, counts = _gathered(table)
    keys, counts = keys[counts > 0], counts[counts > 0]
    nodes, a, b, log, _ = weigh(keys, counts, 2)[2]
    top, a, b, log = summed(nodes & np.uint64(0xFFFF), a, b, log)
    return pa.table({"node": pa.array(top.astype(np.int32)), "zeros": pa.array(a), "ones": pa.array(b), "log": pa.array(log)})


def score(docs: DataFrame) -> DataFrame:
    """Per row of docs: SCORED. The base's unigrams and the tree learn from rows whose crc32(doc_id) mod 10 is not 0."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (~held).alias("train"))
    size, rows_trained = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count_if("train")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    buckets = blocks * SPREAD
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    lists = cut(rows.groupBy("block").applyInArrow(lambda t: _count(t, buckets), _LISTS), "lists")
    token_answers = cut(lists.where(F.col("kind") == TOKENS).groupBy("bucket").applyInArrow(_answer_tokens, _ANSWERS), "token-answers")
    per_bucket = token_answers.groupBy("bucket").agg(F.first("total").alias("total"), F.first("distinct").alias("distinct"))
    total, distinct = per_bucket.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = total + rows_trained, distinct + (rows_trained > 0)

    grams = lists.where(F.col("kind") == GRAMS)
    top = grams.groupBy("bucket").applyInArrow(_subtrees, "node int, zeros double, ones double, log double")
    gathered, left = weigh_top([tuple(r) for r in top.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log")).collect()])  # at most 256 * 255 rows

    def answer_grams(table: pa.Table) -> pa.Table:
        blocks, lists, keys, counts = _gathered(table)
        tree = weigh(keys[counts > 0], counts[counts > 0], 2)
        logs = np.concatenate([log_probabilities(keys[i : i + 50_000], tree, gathered, left) for i in range(0, len(keys), 50_000)])
        answers = [packed(logs[np.searchsorted(keys, x)].astype("<f4")) for x in lists]
        return _answers(GRAMS, table.column("bucket")[0].as_py(), blocks, answers, 0, 0)

    answers = token_answers.union(grams.groupBy("bucket").applyInArrow(answer_grams, _ANSWERS)).select("block", "kind", "bucket", "answer")

    def add_up(table: pa.Table, given: pa.Table) -> pa.Table:
        kinds, at = given.column("kind").to_pylist(), given.column("bucket").to_pylist()

        def joined(kind: int, dtype: str) -> np.ndarray:
            mine = sorted((i for i, x in enumerate(kinds) if x == kind), key=at.__getitem__)
            return np.concatenate([np.zeros(0, dtype), *(unpacked(given.column("answer")[i].as_py(), dtype) for i in mine)])

        counts, logs = joined(TOKENS, "<i8"), joined(GRAMS, "<f4").astype(np.float64)

        def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, back = np.unique(keys, return_inverse=True)
            return found, back.astype(np.int32)

        chunks = [(s, k, *distinct_of(g), gr, *distinct_of(t), w) for s, k, g, gr, t, w in _Chunks(table)]
        ordered = {}
        for kind, col in ((GRAMS, 2), (TOKENS, 5)):
            keys = np.unique(np.concatenate([c[col] for c in chunks]))
            order = np.lexsort((keys, bucket_of(kind, keys, buckets)))
            values = np.empty(len(keys), logs.dtype if kind == GRAMS else counts.dtype)
            values[order] = logs if kind == GRAMS else counts
            ordered[kind] = keys, values
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        end = rows_trained
        scale = n + 0.1 * (v + 1)
        for _, rows_here, g, g_back, g_rows, t, t_back, words in chunks:
            log = ordered[GRAMS][1][np.searchsorted(ordered[GRAMS][0], g)][g_back]
            c = ordered[TOKENS][1][np.searchsorted(ordered[TOKENS][0], t)][t_back]
            of_row = np.repeat(np.arange(rows_here), np.diff(words))
            base = np.bincount(of_row, np.log10((c + 0.1) / scale), rows_here) + np.log10((end + 0.1) / scale)
            made = (np.diff(words) + 1, np.bincount(of_row, c > 0, rows_here).astype(np.int64) + (end > 0), base, np.add.reduceat(log, g_rows[:-1]), np.diff(g_rows) - 1)
            for column, x in zip(columns, made, strict=True):
                column.append(x)
        sizes, known, base, scores, n_bytes = (np.concatenate(x) for x in columns)
        held_out = pa.compute.invert(table.column("train"))
        constant = pa.array(np.full(len(sizes), n, np.int64))
        return pa.table([table.column("doc_id"), held_out, *(pa.array(x) for x in (sizes, known)), constant, pa.array(base), pa.array(scores), pa.array(n_bytes)], names=[x.split()[0] for x in SCORED.split(", ")])

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, SCORED)
