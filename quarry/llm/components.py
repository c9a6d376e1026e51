"""Connected components by alternating large and small stars, each round written to the shared folder; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Of edges (u > v): large, every node sends its larger neighbours to the least it knows; small, every node its smaller neighbours and itself."""
    ways = edges.union(edges.select("v", "u")) if large else edges
    ways = ways.toDF("u", "v")
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = ways.join(least, F.col("u") == F.col("_u"))
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("_u", "m"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) of longs a row (u, v) for every node u that isn't the least of its component, which is v. Loops and doubled edges are allowed."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = cut(_star(_star(edges, True), False), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
