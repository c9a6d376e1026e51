import pytest
from compare import connect, same
from conftest import SF

import __spark_entry__
from quarry import queries
from quarry.operators.chunking import chunk_files


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_chunks_and_blake3_take_whole_texts(spark):
    docs = spark.createDataFrame([(i, "A sentence of words. " * 1500, "s") for i in range(15)], "doc_id long, text string, source string")
    files = queries._source_files(docs)
    assert all(r.content.count("A sentence of words.") == 1500 for r in files.collect())
    rows = chunk_files(files, "repo").collect()
    assert not [r for r in rows if r.error] and {r.path.rpartition(".")[2] for r in rows} == {"py", "rs", "ts", "tsx", "go"}
    assert {"function_part", "module", "impl_header", "class_header"} <= {r.symbol_kind for r in rows} and any(r.symbol_path.endswith("__part1__") for r in rows)
    assert queries.content_hash_blake3(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
