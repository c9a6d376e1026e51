import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import identity, paths, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("include", "exclude", "path", "matched"),
    [
        (["src/**/*.rs"], None, "src/main.rs", True),
        (["src/**/*.rs"], None, "src\\main.rs", True),
        (["src/**/*.rs"], None, "app/main.py", False),
        (["src/**/*.rs"], ["src/generated/*.rs"], "src/generated/types.rs", False),
        (None, None, "any/path.rs", True),
        ([], None, "a", False),
        (["["], None, "a", False),
        (["a**"], None, "ab", False),
        (["*.[!r]s"], None, "x/y.ts", True),
        (["*.[!r]s"], None, "x/y.rs", False),
        (["?/**"], None, "a/b/c", True),
    ],
)
def test_globs(spark, include, exclude, path, matched):
    assert one(spark, paths.matches_globs(F.col("p"), include, exclude), p=path) is matched
    assert paths.path_matches(path, include, exclude) is matched


@pytest.mark.parametrize(("path", "language"), [("a.rs", "rust"), ("a.py", "python"), ("a.pyi", "python"), ("a.ts", "typescript"), ("a.mts", "typescript"), ("a.tsx", "tsx"), ("d/a.go", "go"), ("readme.md", None), ("Makefile", None), (".rs", None), ("a.RS", None)])
def test_language(spark, path, language):
    assert one(spark, paths.detect_language(F.col("p")), p=path) == language
    assert paths.language_of(path) == language


def test_binary_and_skipped(spark):
    assert one(spark, paths.is_binary(F.col("p")), p="image.PNG") and not one(spark, paths.is_binary(F.col("p")), p="code.rs")
    assert one(spark, paths.in_skipped_directory(F.col("p")), p="a/target/x.rs") and not one(spark, paths.in_skipped_directory(F.col("p")), p="a/Target/target")


@pytest.mark.parametrize(("path", "name"), [("/home/user/my-project", "my_project"), ("C:\\Users\\dev\\MyApp", "myapp"), ("some.repo.name", "some_repo_name"), ("/a/__x__/", "x"), ("/", "unknown")])
def test_sanitize(spark, path, name):
    assert one(spark, paths.sanitize_name(F.col("p")), p=path) == name


def test_identifiers(spark):
    made = one(spark, identity.chunk_id("r", "p", "s", "a", "b", "h"), r="r", p="p", s="s", a=1, b=2, h="x")
    assert made == str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), "r:p:s:1:2:x"))
    assert one(spark, identity.content_hash(F.col("t")), t="é") == hashlib.sha256("é".encode()).hexdigest()


def test_blake3_vectors():
    assert identity.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert identity.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({identity.blake3_hex(bytes(n)) for n in (0, 1, 64, 65, 1024, 1025, 2048, 3073, 5000)}) == 9


def test_template_and_terms(spark):
    made = text.embedding_text(F.lit("rust"), F.lit("a.rs"), F.lit("function"), F.lit("f"), F.lit(None), F.lit("d"), F.lit("x"))
    assert one(spark, made, a=1) == "Language: rust\nFile: a.rs\nfunction f\nDocumentation: d\n\nx"
    assert one(spark, text.query_terms(F.col("q")), q="  A b  A ") == ["a", "b", "a"]
    assert one(spark, text.is_blank(F.col("q")), q=" 　\n") is True
