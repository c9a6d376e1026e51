"""Indexing jobs: lifecycle, counters, errors, cancellation and retention, as a driver object and as queries over a table of events."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTERS = ("discovered", "parsed", "chunked", "embedded", "indexed", "failed", "skipped")
STAGES = ("queued", "discovering", "parsing", "embedding", "indexing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
ERRORS_SHOWN = 10


def is_active(stage: Column) -> Column:
    return ~stage.isin(*TERMINAL)


def job_counters(events: DataFrame, job: str = "job_id", kind: str = "kind", kinds: tuple[str, ...] = COUNTERS) -> DataFrame:
    """One row per job with a count per kind of event."""
    return events.groupBy(job).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def recent_errors(events: DataFrame, job: str, error: Column, text: Column, order: list[Column], most: int = ERRORS_SHOWN) -> DataFrame:
    """Per job its last errors, newest first; a job keeps at most so many rows after the window, so the list is bounded."""
    newest = Window.partitionBy(job).orderBy(*order)
    kept = events.where(error).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    return kept.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("text")))), lambda x: x["text"]).alias("recent_errors"))


def retained(jobs: DataFrame, most: int, job: str = "job_id") -> DataFrame:
    """Active jobs and the newest of the others."""
    active = jobs.where(is_active(F.col("stage")))
    newest = jobs.where(~is_active(F.col("stage"))).orderBy(F.desc("started_at"), F.desc(job)).limit(most)
    return active.unionByName(newest)


class JobCancelled(Exception):
    """A job that was cancelled between two of its actions."""


@dataclass
class Job:
    job_id: str
    repo_root: str
    repo_name: str
    started_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    stage: str = "queued"
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    errors: list[str] = field(default_factory=list)
    cancelled: bool = False

    def set_stage(self, stage: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"no job stage {stage!r}")
        self.stage = stage

    def advance(self, stage: str) -> None:
        """Go on to a stage; a cancelled job stays cancelled."""
        if self.cancelled:
            self.set_stage("cancelled")
            raise JobCancelled(self.job_id)
        self.set_stage(stage)

    def add_error(self, message: str) -> None:
        self.errors.append(message)

    @property
    def active(self) -> bool:
        return self.stage not in TERMINAL

    def line(self) -> str:
        """One line for people: name, stage and how far it is."""
        c = self.counters
        return f"{self.repo_name} [{self.stage.capitalize()}] - D:{c['discovered']} P:{c['parsed']} E:{c['embedded']} I:{c['indexed']}"

    def status(self) -> dict:
        return {"job_id": self.job_id, "repo_root": self.repo_root, "repo_name": self.repo_name, "started_at": self.started_at, "stage": self.stage, "counters": dict(self.counters), "recent_errors": self.errors[::-1][:ERRORS_SHOWN]}


class JobRegistry:
    """The jobs of a driver process. Cancelling a job cancels the Spark jobs that carry its id as a tag."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def register(self, job: Job) -> None:
        with self.lock:
            self.jobs[job.job_id] = job

    def status(self, job_id: str) -> dict | None:
        job = self.jobs.get(job_id)
        return job and job.status()

    def cancel(self, job_id: str) -> bool:
        """Whether there is such a job; an active one ends as cancelled."""
        job = self.jobs.get(job_id)
        if job is None:
            return False
        job.cancelled = True
        if job.active:
            job.set_stage("cancelled")
            if self.spark is not None:
                self.spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def cancel_repo(self, repo_name: str) -> list[str]:
        """Cancel the active jobs of a repository; their ids."""
        ids = [j.job_id for j in self.list() if j.active and j.repo_name == repo_name]
        for i in ids:
            self.cancel(i)
        return ids

    def list(self) -> list[Job]:
        return sorted(self.jobs.values(), key=lambda j: (j.started_at, j.job_id))

    def any_active(self) -> bool:
        return any(j.active for j in self.jobs.values())

    def cleanup(self, most: int) -> int:
        """Drop the oldest ended jobs beyond so many; how many went."""
        with self.lock:
            ended = [j for j in self.list() if not j.active]
            gone = ended[: max(0, len(ended) - most)]
            for j in gone:
                del self.jobs[j.job_id]
        return len(gone)
