"""Filtered cosine nearest neighbours with a lexical rerank, for one request or a table of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quarry.functions.text import query_terms

DEFAULT_LIMIT, MOST_CANDIDATES = 10, 100
#: Queries that are multiplied with a block of chunks at once.
QUERY_BLOCK = 2048
#: Fixed values of the rerank: an equal symbol name, a name that contains the query, path words, documentation words, the language asked for.
EXACT, CONTAINED, PATH_WORDS, DOC_WORDS, LANGUAGE = 0.15, 0.08, 0.05, 0.03, 0.02


@dataclass
class SearchRequest:
    query: str
    language: str | None = None
    path_prefix: str | None = None
    symbol_kind: str | None = None
    repo: str | None = None
    limit: int | None = None
    path_match: str | None = None

    @property
    def wanted(self) -> int:
        return DEFAULT_LIMIT if self.limit is None else self.limit


def overfetch(limit: int) -> int:
    """Candidates that are reranked for so many results."""
    return min(3 * limit, MOST_CANDIDATES)


def search_filter(request: SearchRequest) -> Column:
    """The conditions that a request states, all of which must hold."""
    kept = F.lit(True)
    if request.language is not None:
        kept &= F.col("language") == request.language.lower()
    if request.path_prefix is not None:
        kept &= F.col("path") == request.path_prefix if request.path_match == "exact" else F.startswith("path", F.lit(request.path_prefix))
    if request.symbol_kind is not None:
        kept &= F.col("symbol_kind") == request.symbol_kind.lower()
    if request.repo is not None:
        kept &= F.col("repo") == request.repo
    return kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is missing, zero or not finite."""
    score = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.nanvl(F.coalesce(score, F.lit(0.0)), F.lit(0.0))


def boost(query: Column, name: Column, path: Column, doc: Column, language: Column | None = None, asked: Column | None = None) -> Column:
    """What the rerank adds to a candidate's score."""
    lowered, terms = F.lower(query), query_terms(query)

    def ratio(text: Column) -> Column:
        return F.size(F.filter(terms, lambda w: F.contains(F.lower(text), w))) / F.greatest(F.size(terms), F.lit(1))

    by_name = F.when(F.lower(name) == lowered, EXACT).when(F.contains(F.lower(name), lowered), CONTAINED).otherwise(0.0)
    total = by_name + F.coalesce(ratio(path) * PATH_WORDS, F.lit(0.0)) + F.when(doc.isNotNull(), ratio(doc) * DOC_WORDS).otherwise(0.0)
    if asked is not None:
        total = total + F.when(F.lower(language) == F.lower(asked), LANGUAGE).otherwise(0.0)
    return total


def candidates(chunks: DataFrame, vector: list[float], request: SearchRequest) -> DataFrame:
    """The nearest chunks that satisfy the request, at most overfetch of its limit, with score; filters come before the scan's scores."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.where(search_filter(request)).withColumn("score", cosine(F.col("embedding"), query))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(overfetch(request.wanted))


def search(chunks: DataFrame, vector: list[float], request: SearchRequest) -> DataFrame:
    """Results of a request, best first: score (float) and a chunk's columns, with total_candidates, the number of candidates reranked."""
    found = candidates(chunks, vector, request)
    asked = None if request.language is None else F.lit(request.language)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    ranked = found.withColumn("total_candidates", F.count(F.lit(1)).over(Window.partitionBy())).withColumn(
        "adjusted", F.col("score") + boost(F.lit(request.query), F.coalesce("symbol_name", F.lit("")), F.coalesce("symbol_path", F.lit("")), F.col("doc_comment"), F.col("language"), asked)
    )
    best = ranked.orderBy(F.desc("adjusted"), F.desc("score"), "chunk_id").limit(request.wanted)
    kept = [text(c) for c in ("repo", "path", "language", "symbol_name", "symbol_kind", "symbol_path")] + [number(c) for c in ("line_start", "line_end")]
    return best.select(F.col("adjusted").cast("float").alias("score"), *kept, "signature", "doc_comment", F.coalesce("chunk_text", F.lit("")).alias("snippet"), "total_candidates")


def _unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of unit length in double precision; 0 where one is missing, zero, not finite or of another length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dim)
    x = np.zeros((len(column), dim))
    if len(fit):
        x[fit] = pc.list_flatten(column.take(pa.array(fit))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x[~np.isfinite(x).all(axis=1)] = 0
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms > 0, norms, 1)[:, None]


def batch_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each query (query_id, vector) the k nearest chunks: query_id, rank, chunk_id, score. The queries are a stated set, taken in blocks of QUERY_BLOCK;
    a block of chunks is multiplied with a block of queries, and only the best k of each query leave it."""
    types = {f.name: f.dataType.simpleString() for f in [*queries.select("query_id").schema, *chunks.select("chunk_id").schema]}
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double"
    asked = [(r.query_id, r.vector) for r in queries.select("query_id", "vector").toLocalIterator()]
    parts = []
    for i in range(0, max(len(asked), 1), QUERY_BLOCK):
        block = asked[i : i + QUERY_BLOCK]
        ids = [q for q, _ in block]
        dim = max((len(v) for _, v in block if v is not None), default=1)
        unit = _unit_rows(pa.array([v for _, v in block], pa.list_(pa.float64())), dim)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, unit=unit, dim=dim) -> Iterator[pa.RecordBatch]:
            for b in batches:
                top = min(k, b.num_rows)
                if not top or not ids:
                    continue
                score = np.round(unit @ _unit_rows(b.column(1), dim).T, 12)
                # every row as good as the k-th stays, so that ties are broken by id and not by place
                least = np.partition(score, -top, axis=1)[:, -top]
                q, c = np.nonzero(score >= least[:, None])
                yield pa.record_batch([pa.array([ids[x] for x in q.tolist()], run_types[0]), b.column(0).take(pa.array(c)), pa.array(score[q, c])], names=["query_id", "chunk_id", "score"])

        run_types = [to_arrow_type(queries.schema["query_id"].dataType)]
        parts.append(chunks.select("chunk_id", "embedding").mapInArrow(run, schema))
    scored = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def to_json(results: DataFrame, model: str) -> str:
    """The response as indented JSON; the rows are at most a request's limit."""
    rows = [r.asDict() for r in results.collect()]
    total = rows[0]["total_candidates"] if rows else 0
    return json.dumps({"results": [{k: v for k, v in r.items() if k != "total_candidates"} for r in rows], "total_candidates": total, "embedding_model": model}, indent=2, ensure_ascii=False)
