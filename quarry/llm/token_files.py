"""Token-ID output: shards in Arrow's stream-file format whose batches are fixed-size lists, for zero-copy random access to equal-length sequences and masks.

A shard is two files in the shared folder. ``*.seq.arrow`` holds batches of ``ids: fixed_size_list<uint16|uint32>[L]`` and ``mask:
fixed_size_list<bool>[L]``: the ids of consecutive documents, cut into sequences of L; only the shard's last sequence has padding, masked out.
``*.doc.arrow`` holds the documents in that order with their number of ids. Shards cover disjoint, ascending ranges of doc_id; a manifest lists them.

Defined cases: null text is empty and yields the end id alone; a null doc_id sorts first; repeated rows are written as often as they occur, rows of
one doc_id in the order of their texts; an empty table gives no shard and no row; other columns are ignored.
Recovery: a task writes under a fresh name, and only names in the manifest, itself written by Spark's committer, are read. A task that runs twice
leaves an orphan, never a doubled shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.chunk_encoding import encoder
from quarry.llm.common import SLICE_BYTES, byte_slices, cut, file_system, read_tasks, shared_dir

SEQUENCE, BATCH_SEQUENCES = 2048, 512
#: Rows below which another shard is not worth a task.
SHARD_ROWS = 8
MANIFEST = T.StructType([T.StructField(n, T.StringType() if n == "uri" else T.LongType()) for n in ("first_id", "uri", "n_docs", "n_tokens")])
COUNTED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


class ShardWriter:
    """Writes one shard; memory is bounded by a batch of sequences and one document."""

    def __init__(self, uri: str, dtype: np.dtype, length: int):
        fs, path = file_system(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.length, self.dtype = length, dtype
        value = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [fs.open_output_stream(f"{path}.{kind}.arrow") for kind in ("seq", "doc")]
        self.writers = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.docs_schema), strict=True)]
        self.waiting = bytearray()
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        width = self.dtype.itemsize
        counts = [len(x) // width for x in ids]
        self.writers[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64())], schema=self.docs_schema))
        self.n_docs += len(ids)
        self.n_tokens += sum(counts)
        most = self.length * width * BATCH_SEQUENCES
        for x in ids:
            self.waiting += x
            if len(self.waiting) >= most:
                whole = len(self.waiting) // most * most
                self._write(bytes(self.waiting[:whole]))
                del self.waiting[:whole]

    def _write(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype=self.dtype)
        n = -(-len(ids) // self.length)
        mask = np.ones(n * self.length, dtype=bool)
        mask[len(ids) :] = False
        if len(ids) < len(mask):
            ids = np.concatenate([ids, np.zeros(len(mask) - len(ids), self.dtype)])
        for i in range(0, n, BATCH_SEQUENCES):
            part = slice(i * self.length, min(n, i + BATCH_SEQUENCES) * self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (ids, mask)]
            self.writers[0].write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(bytes(self.waiting))
        for x in [*self.writers, *self.files]:
            x.close()


class TokenShard:
    """Reads a shard. On a local file system the file is mapped, and ids and masks are views of it."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        local = fs.type_name == "local"
        self.files = [pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p)) for p in (f"{path}.seq.arrow", f"{path}.doc.arrow")]
        self.length = self.files[0].schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i, both views: the mask stays Arrow's bits, which numpy could only copy."""
        batch = self.files[0].get_batch(i // BATCH_SEQUENCES)
        k = (i % BATCH_SEQUENCES) * self.length
        ids, mask = (batch.column(c).flatten().slice(k, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self) -> Iterator[np.ndarray]:
        """The ids of each batch without padding."""
        for b in range(self.files[0].num_record_batches):
            batch = self.files[0].get_batch(b)
            mask = batch.column(1).flatten()
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            yield ids[: mask.true_count]

    def documents(self) -> tuple[list[int | None], list[int]]:
        table = self.files[1].read_all()
        return table.column(0).to_pylist(), table.column(1).to_pylist()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Encode every text, end it with end_id, write the shards in ascending doc_id order and return the manifest (MANIFEST)."""
    folder = shared_dir(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        uri, out, first = f"{folder}/{uuid.uuid4().hex}", None, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out, first = ShardWriter(uri, enc.dtype, length), b.column(0)[0].as_py()
            for part in byte_slices(b, 1, 4 * SLICE_BYTES):
                out.add(part.column(0).to_pylist(), [x + end for x in enc.encode(part.column(1).to_pylist())])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"first_id": first, "uri": uri, "n_docs": out.n_docs, "n_tokens": out.n_tokens}], schema=pa.schema([("first_id", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a number of its own, which is not coalesced by the rows' bytes
    shards = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // SHARD_ROWS))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """From the shards: doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = TokenShard(uri)
                parts, at, have = shard.tokens(), 0, np.zeros(0, np.uint16)
                ids, counts = shard.documents()
                crcs = []
                for n in counts:
                    crc, left = 0, n
                    while left:
                        if at == len(have):
                            have, at = next(parts), 0
                        take = min(left, len(have) - at)
                        crc = zlib.crc32(have[at : at + take].astype("<u4"), crc)
                        at, left = at + take, left - take
                    crcs.append(crc)
                starts = start + np.cumsum([0, *counts[:-1]], dtype=np.int64)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("uri", "start").repartition(read_tasks(manifest)).mapInArrow(read, COUNTED)
