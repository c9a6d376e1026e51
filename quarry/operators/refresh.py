"""Incremental refresh: what of a repository was added, updated, deleted or stayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import matches_globs

ADDED, UPDATED, DELETED, UNCHANGED, OUT_OF_SCOPE = "added", "updated", "deleted", "unchanged", "out_of_scope"


def file_metadata(chunks: DataFrame) -> DataFrame:
    """Of a store's chunks one row per path: file_mtime, file_size and file_hash as last indexed."""
    latest = F.max_by(F.struct("file_mtime", "file_size", "file_hash"), F.struct("indexed_at", "chunk_id"))
    return chunks.groupBy("path").agg(latest.alias("m")).select("path", "m.file_mtime", "m.file_size", "m.file_hash")


def compare(current: DataFrame, indexed: DataFrame, hashed: Column | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path and state of current files (path, mtime, size and, for hashed, what it takes) against indexed ones (file_metadata).

    Equal metadata are confirmed by hash, computed for those rows alone; a file that can't be read (hash null) counts as updated. Indexed files that
    are gone count as deleted if the globs would list them.
    """
    hashed = F.col("hash") if hashed is None else hashed
    now = current.withColumnRenamed("path", "_path")
    both = now.join(indexed, F.col("_path") == F.col("path"), "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("file_mtime")) & F.col("size").eqNullSafe(F.col("file_size"))
    state = (
        F.when(F.col("path").isNull(), ADDED)
        .when(F.col("_path").isNull(), F.when(matches_globs(F.col("path"), include, exclude), DELETED).otherwise(OUT_OF_SCOPE))
        .when(~same, UPDATED)
        .when(F.coalesce(hashed != F.col("file_hash"), F.lit(True)), UPDATED)
        .otherwise(UNCHANGED)
    )
    return both.select(F.coalesce("_path", "path").alias("path"), state.alias("state"))


def counts(states: DataFrame) -> DataFrame:
    """One row: added, updated, deleted, unchanged."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in (ADDED, UPDATED, DELETED, UNCHANGED)])


def changed(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin(ADDED, UPDATED)).select("path")


def stale(states: DataFrame) -> DataFrame:
    """Paths whose rows leave the store before changed ones are read anew."""
    return states.where(F.col("state").isin(UPDATED, DELETED)).select("path")


def deleted_files(indexed: DataFrame, current: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return indexed.join(current.select("path"), "path", "left_anti").where(matches_globs(F.col("path"), include, exclude)).select("path")


def new_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    return current.join(indexed.select("path"), "path", "left_anti").select("path")
