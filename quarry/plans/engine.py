"""The engine: index a tree, refresh it, search it; jobs and collections about them."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.identity import chunk_id, content_hash
from quarry.functions.paths import relative_path, sanitize_name
from quarry.functions.text import rfc3339
from quarry.operators import refresh
from quarry.operators.chunking import chunk_files
from quarry.operators.embedding import Embedder, HashEmbedder, HttpEmbedder, RetryingEmbedder, embed_chunks, embedding_cache
from quarry.operators.jobs import Job, JobCancelled, JobRegistry
from quarry.operators.search import SearchRequest, search, to_json
from quarry.operators.store import ChunkStore
from quarry.plans.commands import MODELS
from quarry.plans.config import Config
from quarry.schema import STORED
from quarry.sources.repo_files import listed_files, repo_files


@dataclass
class IngestOptions:
    include: list[str] | None = None
    exclude: list[str] | None = None
    languages: list[str] | None = None
    files: list[str] | None = None


class IndexError_(Exception):
    """A path that can't be indexed."""


#: Names of models, those of the model command among them, and the protocol that each speaks.
EMBEDDERS = {"hash": "hash", "local": "simple", "ollama": "simple", "remote": "batch", "gemini": "batch"}


def embedder_of(config: Config) -> Embedder:
    """The model of a name of EMBEDDERS."""
    kind = EMBEDDERS.get(config.active_embedder)
    if kind is None:
        raise ValueError(f"no embedder {config.active_embedder!r}: it is one of {', '.join(EMBEDDERS)}")
    if kind == "hash":
        return HashEmbedder(config.embedding_dimensions)
    if not config.embedding_url:
        raise ValueError(f"embedder {config.active_embedder!r} needs an embedding_url")
    return HttpEmbedder(config.embedding_url, config.embedding_model, config.api_key, config.embedding_dimensions, kind, 16 if kind == "simple" else 50, 300.0 if kind == "simple" else 120.0)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.config = spark, config or Config.from_env()
        self.embedder = embedder or embedder_of(self.config)
        self.store = ChunkStore(spark, self.config.store_path, self.config.collection_prefix)
        self.registry = JobRegistry(spark)
        self.pending_delete: str | None = None
        self.sleep = time.sleep

    def repo_name(self, path: str) -> str:
        return self.spark.range(1).select(sanitize_name(F.lit(path))).first()[0] or "unknown"

    def _files(self, root: str, options: IngestOptions) -> DataFrame:
        found = listed_files(self.spark, options.files) if options.files is not None else repo_files(self.spark, root, options.include, options.exclude)
        return found.withColumn("path", relative_path(F.col("path"), str(Path(root).resolve())))

    def start_index(self, root: str, options: IngestOptions | None = None) -> tuple[Job, InheritableThread]:
        """Index in the background; the job and the thread that runs it."""
        if not root or not Path(root).exists():
            raise IndexError_(f"no such path: {root!r}")
        job = Job(str(uuid.uuid4()), root, self.repo_name(root))
        self.registry.register(job)

        def run() -> None:
            try:
                self.index(root, options, job)
            except Exception:  # the job has it among its errors
                pass

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        return job, thread

    def index(self, root: str, options: IngestOptions | None = None, job: Job | None = None, only: DataFrame | None = None) -> Job:
        """Index a tree into its repository's collection, or of it the paths of only: one chain from files to stored rows, whose only action besides the
        counts is the store's."""
        if not root or not Path(root).exists():
            raise IndexError_(f"no such path: {root!r}")
        options, repo = options or IngestOptions(), self.repo_name(root)
        job = job or Job(str(uuid.uuid4()), root, repo)
        self.registry.register(job)
        self.spark.sparkContext.addJobTag(job.job_id)
        try:
            files = self._files(root, options)
            self._ingest(files if only is None else files.join(only.select("path"), "path", "left_semi"), repo, options, job)
        except JobCancelled:
            pass
        except Exception as e:
            job.add_error(f"{type(e).__name__}: {e}")
            if job.cancelled:
                job.set_stage("cancelled")
            else:
                job.set_stage("failed")
                raise
        finally:
            self.spark.sparkContext.removeJobTag(job.job_id)
        return job

    def _ingest(self, files: DataFrame, repo: str, options: IngestOptions, job: Job) -> None:
        self.store.ensure_collection(repo)
        job.advance("discovering")
        job.advance("parsing")
        chunks = chunk_files(files, repo, options.languages, self.config.hash_algorithm).persist()
        try:
            seen = files.agg(F.count(F.lit(1))).first()[0]
            stats = chunks.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull()), F.count_distinct("path")).first()
            job.counters |= {"discovered": seen, "parsed": seen - stats[1], "chunked": stats[0], "skipped": seen - stats[2]}
            self._note_errors(job, chunks)
            job.advance("embedding")
            cache = embedding_cache(self.store.chunks(repo), self.config.cache_key == "model", chunks.select("content_hash"))
            made = embed_chunks(chunks.where("error is null").drop("error"), self.embedder, cache, self.config.cache_key == "model", self.config.embed_batch_max_tokens, self.config.embed_batch_max_items, self.config.max_retries).persist()
            embedded = made.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
            job.counters |= {"embedded": embedded[0], "failed": stats[1] + embedded[1]}
            self._note_errors(job, made)
            job.advance("indexing")
            key = chunk_id("repo", "path", "symbol_path", "byte_start", "byte_end", "content_hash", self.config.id_namespace)
            names = [c.split()[0] for c in STORED.split(", ")]
            rows = made.where("error is null").withColumn("chunk_id", key).withColumn("indexed_at", rfc3339(F.current_timestamp())).select(*names)
            self._upsert(repo, rows, job, embedded[0])
            made.unpersist()
        finally:
            chunks.unpersist()
        job.advance("completed")

    @staticmethod
    def _note_errors(job: Job, rows: DataFrame) -> None:
        """The errors of rows go to the job, one partition at a time in the driver."""
        for r in rows.where("error is not null").select("path", "error").toLocalIterator():
            job.add_error(f"{r.path}: {r.error}")

    def _upsert(self, repo: str, rows: DataFrame, job: Job, n: int, wait: float = 1.0) -> None:
        """Put rows into the store, again after a failure; when retries are used up, they count as failed."""
        for attempt in range(self.config.max_retries + 1):
            try:
                self.store.upsert(repo, rows)
                job.counters["indexed"] = n
                return
            except Exception as e:
                if job.cancelled:
                    raise
                job.add_error(f"put, attempt {attempt + 1}: {type(e).__name__}: {e}"[:500])
                if attempt == self.config.max_retries:
                    job.counters["failed"] += n
                    raise
                self.sleep(min(wait * 2**attempt, 60.0))

    def refresh(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> dict[str, int]:
        """Bring a repository's collection up to date: rows of changed and deleted files go, changed and new files are read anew."""
        repo = self.repo_name(root)
        files = self._files(root, IngestOptions(include, exclude))
        hashed = content_hash(F.col("content"), self.config.hash_algorithm).alias("hash")  # contents end where they are read
        states = refresh.compare(files.select("path", "mtime", "size", hashed), refresh.file_metadata(self.store.chunks(repo)), None, include, exclude).persist()
        try:
            states.count()  # as things were before the store changes
            counted = refresh.counts(states).first().asDict()
            self.store.delete_paths(repo, refresh.stale(states))
            if counted["added"] or counted["updated"]:
                self.index(root, IngestOptions(include, exclude), only=refresh.changed(states))
        finally:
            states.unpersist()
        return counted

    def search(self, request: SearchRequest) -> DataFrame:
        repo = request.repo or "unknown"
        request = replace(request, path_match=request.path_match or self.config.path_match)
        vector = RetryingEmbedder(self.embedder, 3).embed_query(request.query)
        return search(self.store.chunks(repo), vector, request)

    def search_json(self, request: SearchRequest) -> str:
        """The response as JSON; an error is one too."""
        import json

        try:
            return to_json(self.search(request), self.embedder.model)
        except Exception as e:
            return json.dumps({"error": str(e)}, indent=2)

    def switch_embedder(self, embedder: Embedder) -> bool:
        """Use another model from now on; whether jobs still run with the one before."""
        self.embedder = embedder
        return self.registry.any_active()

    def use_model(self, name: str | None = None) -> str:
        """Switch to a model by its name, without one to the other of MODELS; the name."""
        if name is None:
            name = MODELS[(MODELS.index(self.config.active_embedder) + 1) % len(MODELS)] if self.config.active_embedder in MODELS else MODELS[0]
        config = replace(self.config, active_embedder=name)
        self.switch_embedder(embedder_of(config))
        self.config = config
        return name

    def request_delete(self, name: str) -> str | None:
        """First phase: note the collection that a name means; None if there is none."""
        self.pending_delete = self.store.resolve(name)
        return self.pending_delete

    def confirm_delete(self) -> bool:
        """Second phase: cancel the repository's jobs and drop the collection."""
        name, self.pending_delete = self.pending_delete, None
        if name is None:
            return False
        self.registry.cancel_repo(name.removeprefix(self.config.collection_prefix))
        return self.store.drop_collection(name)

    def cancel_delete(self) -> None:
        self.pending_delete = None
