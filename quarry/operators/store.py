"""The chunk store: Parquet, partitioned by collection and a bucket of the path, with upsert and delete by key.

A write builds the new rows of the buckets it touches in a staging folder and then puts them in place, so that what is read is never what is
overwritten, and buckets it does not touch are neither read nor written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.paths import COLLECTION_PREFIX
from quarry.schema import STORED

BUCKETS = 64


def merge(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with new put in: rows of new replace those with equal keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_wins(new: DataFrame, key: str = "chunk_id", order: str = "indexed_at") -> DataFrame:
    """One row for each key of a batch: the last by order."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return new.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def unit(vector: str):
    """The vector at unit length, as stores for cosine similarity keep it; a zero or missing one as it is."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("path"), "path", "left_anti")


class ChunkStore:
    """Collections of chunks below a folder. Paths may be of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str, prefix: str = COLLECTION_PREFIX, buckets: int = BUCKETS):
        self.spark, self.base, self.prefix, self.buckets = spark, base.rstrip("/"), prefix, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def collection(self, repo: str) -> str:
        return self.prefix + repo

    def ensure_collection(self, repo: str) -> str:
        """Make the collection of a repository if it is missing; its name."""
        name = self.collection(repo)
        fs, p = self._fs(f"{self.base}/collection={name}")
        fs.mkdirs(p)
        return name

    def list_collections(self) -> list[str]:
        if not self._exists(self.base):
            return []
        fs, p = self._fs(self.base)
        names = [s.getPath().getName().partition("collection=")[2] for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(self.prefix))

    def resolve(self, name: str) -> str | None:
        return next((c for c in self.list_collections() if c in (name, self.prefix + name)), None)

    def drop_collection(self, name: str) -> bool:
        """Drop a collection by its full name; whether there was one."""
        fs, p = self._fs(f"{self.base}/collection={name}")
        return bool(fs.delete(p, True))

    def chunks(self, repo: str) -> DataFrame:
        """The rows of a repository's collection; only its folder is read."""
        path = f"{self.base}/collection={self.collection(repo)}"
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{STORED}, bucket int")
        return self.spark.read.schema(f"{STORED}, bucket int").option("basePath", path).parquet(path)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _replace(self, repo: str, rows: DataFrame, touched: list[int]) -> None:
        """Put rows in the place of the touched buckets; at most self.buckets numbers reach the driver."""
        target = f"{self.base}/collection={self.ensure_collection(repo)}"
        staging = f"{self.base}/_staging/{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(staging)
        fs, _ = self._fs(self.base)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for b in touched:
            old, new = path(f"{target}/bucket={b}"), path(f"{staging}/bucket={b}")
            # the old bucket only steps aside until the new one is in place: a driver that is lost in between loses no row
            if fs.exists(old):
                fs.mkdirs(path(f"{staging}/old"))
                fs.rename(old, path(f"{staging}/old/bucket={b}"))
            if fs.exists(new):
                fs.rename(new, old)
        fs.delete(path(staging), True)

    def upsert(self, repo: str, rows: DataFrame) -> None:
        """Put rows (STORED) in; rows with stored keys replace them, and of equal keys in the batch the last wins."""
        new = last_wins(rows).withColumn("embedding", unit("embedding")).withColumn("bucket", self._bucket())
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        if touched:
            old = self.chunks(repo).where(F.col("bucket").isin(touched))
            self._replace(repo, merge(old, new), touched)

    def delete_paths(self, repo: str, paths: DataFrame) -> None:
        """Delete the rows of paths, all in one job."""
        gone = paths.select("path").distinct().withColumn("bucket", self._bucket())
        touched = [r[0] for r in gone.select("bucket").distinct().collect()]
        if touched:
            self._replace(repo, without_paths(self.chunks(repo).where(F.col("bucket").isin(touched)), gone), touched)
