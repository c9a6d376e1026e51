"""The registered queries of the training-data operators: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, near_duplicates, secret_scan, sentence_pieces, token_counts, token_files, toxicity, tree_weighting, vector_index, warc_archives

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


ORACLES["op2_secret_scan"] = secret_scan.ORACLE


@query
def op3_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_weighting.score(table(spark, sf_dir, "documents"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"))


@query
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"]).select("doc_id", "n_tokens", "ids_crc32", "round_trip")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = decontamination.ORACLE


@query
def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archives.read_archives(warc_archives.write_archives(table(spark, sf_dir, "pages")))


ORACLES["op7_warc_archives"] = warc_archives.ORACLE


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ["doc_id"], text="text", rule="majority")
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.array_join("section_tokens", ",").alias("section_tokens"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_documents(manifest)
