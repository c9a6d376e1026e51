"""Embedding: a cache joined by content, models behind one protocol, retries, adaptive batches and a circuit breaker."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import embedding_text
from quarry.operators.batching import MAX_ITEMS, MAX_TOKENS, greedy
from quarry.schema import EMBEDDING_VERSION

DOCUMENT, QUERY = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"
#: Fixed values of the retry policy, in seconds and numbers.
BACKOFF_CAP, JITTER, CLIENT_ERROR_WAIT, BREAKER_AFTER, BREAKER_PAUSE, BATCH_FLOOR = 60.0, 0.5, 2.0, 3, 30.0, 5


class EmbeddingError(Exception):
    """An embedding that failed for good."""


class HttpError(Exception):
    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"HTTP status {status}")
        self.status, self.retry_after = status, retry_after


class Embedder(Protocol):
    model: str
    start_batch: int

    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


@dataclass
class HashEmbedder:
    """A deterministic model without network: words fall into signed buckets; unit length."""

    dim: int = 64
    model: str = "hash"
    start_batch: int = 50

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[int.from_bytes(h[:4], "little") % self.dim] += 1.0 if h[4] & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


@dataclass
class HttpEmbedder:
    """A model behind HTTP. kind "batch": one request entry per text, with task and dimension; kind "simple": model and inputs alone."""

    url: str
    model: str
    api_key: str = ""
    dim: int = 3072
    kind: str = "batch"
    start_batch: int = 50
    timeout: float = 120.0
    post: Callable[[str, dict, dict, float], dict] | None = None

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        post = self.post or _post
        if self.kind == "simple":
            return post(f"{self.url}/api/embed", {"model": self.model, "input": texts}, {}, self.timeout)["embeddings"]
        name = f"models/{self.model}"
        entries = [{"model": name, "content": {"parts": [{"text": t}]}, "taskType": task, "outputDimensionality": self.dim} for t in texts]
        answer = post(f"{self.url}/{name}:batchEmbedContents", {"requests": entries}, {"x-goog-api-key": self.api_key}, self.timeout)
        return [e["values"] for e in answer["embeddings"]]


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.headers.get("Retry-After")) from e


@dataclass
class RetryingEmbedder:
    """Embeds with retries. 429 waits as told, or exponentially with jitter; other 4xx wait 2 s and make that the base; 5xx wait exponentially; all else
    fails at once. 429 and 4xx halve the batch limit down to its floor; three 429 in a row pause all calls, a success resets the row."""

    inner: Embedder
    max_retries: int = 5
    base: float = 0.5
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = lambda: random.random() * JITTER
    batch_max: int = field(init=False)
    limited: int = field(default=0, init=False)

    def __post_init__(self):
        self.batch_max = self.inner.start_batch

    @property
    def model(self) -> str:
        return self.inner.model

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        base = self.base
        for attempt in range(self.max_retries + 1):
            if self.limited >= BREAKER_AFTER:
                self.sleep(BREAKER_PAUSE)
                self.limited = 0
            try:
                vectors = self.inner.embed(texts, task)
            except HttpError as e:
                if not 400 <= e.status < 600 or attempt == self.max_retries:
                    raise EmbeddingError(f"{e} after {attempt + 1} attempts") from e
                backoff = min(BACKOFF_CAP, base * 2**attempt) + self.jitter()
                if e.status < 500:
                    self.batch_max = max(BATCH_FLOOR, self.batch_max // 2)
                if e.status == 429:
                    self.limited += 1
                    self.sleep(backoff if e.retry_after is None else float(e.retry_after) if e.retry_after.isdigit() else base)
                elif e.status < 500:
                    base = CLIENT_ERROR_WAIT
                    self.sleep(CLIENT_ERROR_WAIT)
                else:
                    self.sleep(backoff)
                continue
            except OSError as e:
                raise EmbeddingError(str(e)) from e
            self.limited = 0
            if len(vectors) != len(texts):
                raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        raise EmbeddingError("no attempt was made")

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text], QUERY)[0]


def embedding_cache(stored: DataFrame, by_model: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """Of stored chunks one vector per content (and model): that of the smallest chunk_id. wanted (content_hash) keeps all other vectors out of the shuffle."""
    if wanted is not None:
        stored = stored.join(wanted.select("content_hash").distinct(), "content_hash", "left_semi")
    keys = ["content_hash", "embedding_model"] if by_model else ["content_hash"]
    return stored.groupBy(*keys).agg(F.min_by("embedding", "chunk_id").alias("embedding"))


def embed_chunks(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, by_model: bool = True, max_tokens: int = MAX_TOKENS, max_items: int = MAX_ITEMS, max_retries: int = 5) -> DataFrame:
    """chunks with embedding_model, embedding_version, embedding and error. Vectors in the cache are reused; each other distinct content is embedded once,
    in greedy batches per partition; a failed batch gives rows with an error and no vector, and cached rows are not touched by it."""
    made = chunks.withColumn("embedding_model", F.lit(embedder.model))
    keys = ["content_hash", "embedding_model"] if by_model else ["content_hash"]
    text = embedding_text(F.col("language"), F.col("path"), F.col("symbol_kind"), F.col("symbol_name"), F.col("signature"), F.col("doc_comment"), F.col("chunk_text"))
    version = F.lit(EMBEDDING_VERSION).alias("embedding_version")
    hits, misses = None, made
    if cache is not None:
        known = cache.withColumnRenamed("embedding", "_v")
        if not by_model:
            known = known.select("content_hash", "_v")
        hits = made.join(known, keys).select(*made.columns, version, F.col("_v").alias("embedding"), F.lit(None).cast("string").alias("error"))
        misses = made.join(known.select(*keys), keys, "left_anti")
    rows = misses.withColumn("embedding_version", version).withColumn("_text", text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "embedding array<float>, error string"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = RetryingEmbedder(embedder, max_retries)
        for pdf in parts:
            texts = pdf.pop("_text").tolist()
            sizes = [len(t.encode()) // 4 for t in texts]
            vectors: list = []
            errors: list = []
            while len(vectors) < len(texts):  # a batch at a time: the client may have halved its limit since the last
                at = len(vectors)
                batch = takewhile(lambda b: b == 0, greedy(islice(sizes, at, None), max_tokens, min(client.batch_max, max_items)))
                mine = texts[at : at + max(1, sum(1 for _ in batch))]
                try:
                    vectors += client.embed(mine, DOCUMENT)
                    errors += [None] * len(mine)
                except EmbeddingError as e:
                    vectors += [None] * len(mine)
                    errors += [str(e)] * len(mine)
            yield pdf.assign(embedding=vectors, error=errors)

    embedded = rows.mapInPandas(run, schema)
    return embedded if hits is None else hits.unionByName(embedded)
