"""Ingest from a stream of files: each micro-batch is chunked, embedded and put into the store by key, so a batch that runs twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.identity import chunk_id
from quarry.functions.text import rfc3339
from quarry.operators.chunking import chunk_files
from quarry.operators.embedding import Embedder, embed_chunks
from quarry.operators.store import ChunkStore
from quarry.schema import STORED


def ingest_stream(files: DataFrame, repo: str, store: ChunkStore, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Start a query that takes what there is of files (path, mtime, size, content) and ends."""

    def put(batch: DataFrame, _: int) -> None:
        made = embed_chunks(chunk_files(batch, repo).where("error is null").drop("error"), embedder).where("error is null")
        key = chunk_id("repo", "path", "symbol_path", "byte_start", "byte_end", "content_hash")
        rows = made.withColumn("chunk_id", key).withColumn("indexed_at", rfc3339(F.current_timestamp())).select(*[c.split()[0] for c in STORED.split(", ")])
        rows.persist()  # a put reads them several times, and a chunk is embedded once
        try:
            store.upsert(repo, rows)
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
