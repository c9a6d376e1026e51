"""Chunk rows that need no syntax: the row of a whole file and the slices of an oversized text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import file_stem
from quarry.functions.text import is_blank

#: Bytes above which a definition is split, and lines of a slice.
SPLIT_BYTES, SLICE_LINES = 16_384, 200


def lines_of(text: Column) -> Column:
    """The lines of a text; a last line break ends a line and begins none."""
    return F.split(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n")


def line_parts(df: DataFrame, text: str = "text", size: int = SLICE_LINES) -> DataFrame:
    """df's other columns with part (from 0), n_lines and part_text: its text in slices of so many lines."""
    lines = lines_of(F.col(text))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / size).cast("int")), lambda i: F.slice(F.col("_lines"), i * size + 1, size))
    cut = df.withColumn("_lines", lines).select(*[c for c in df.columns if c != text], F.posexplode(slices).alias("part", "_slice"))
    return cut.select(*[c for c in df.columns if c != text], "part", F.size("_slice").alias("n_lines"), F.array_join("_slice", "\n").alias("part_text"))


def module_rows(files: DataFrame) -> DataFrame:
    """Of files (path, content) that aren't blank the row of the whole file."""
    rows = files.where(~is_blank(F.col("content")))
    n = F.size(lines_of(F.col("content")))
    stem = file_stem(F.col("path"))
    return rows.select(
        "path", stem.alias("symbol_name"), F.lit("module").alias("symbol_kind"), stem.alias("symbol_path"), F.lit(1).alias("line_start"), n.alias("line_end"), F.lit(0).alias("byte_start"), F.octet_length("content").alias("byte_end")
    )
