"""Text templates and query terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def is_blank(text: Column) -> Column:
    return trim_unicode(text) == ""


def query_terms(query: Column) -> Column:
    """The words of a query, in lower case; doubled words stay."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != "")


def embedding_text(language: Column, path: Column, kind: Column, name: Column, signature: Column, doc: Column, text: Column) -> Column:
    """What is embedded of a chunk: a head, whose signature and documentation may be missing, a blank line and the text."""
    label = lambda word, c: F.when(c.isNotNull(), F.concat(F.lit(word), c))
    return F.concat_ws("\n", F.concat(F.lit("Language: "), language), F.concat(F.lit("File: "), path), F.concat_ws(" ", kind, name), label("Signature: ", signature), label("Documentation: ", doc), F.lit(""), text)


def multimodal_text(text: Column, mime_type: Column) -> Column:
    """What a model without images gets instead of one."""
    return F.when(text.isNotNull(), F.format_string("[Image: %s] %s", mime_type, text)).otherwise(F.format_string("[Uncaptioned Image: %s]", mime_type))


def multimodal_parts(text: Column, mime_type: Column, data_base64: Column) -> Column:
    """An input as parts: the text, if there is one, then the data, if there are any."""
    part = lambda t, m, d: F.struct(t.cast("string").alias("text"), m.cast("string").alias("mime_type"), d.cast("string").alias("data"))
    none = F.lit(None)
    return F.array_compact(F.array(F.when(text.isNotNull(), part(text, none, none)), F.when(data_base64.isNotNull(), part(none, mime_type, data_base64))))


def job_line(name: Column, stage: Column, discovered: Column, chunked: Column, embedded: Column, indexed: Column) -> Column:
    return F.format_string("%s [%s] - D:%d P:%d E:%d I:%d", name, F.initcap(stage), discovered, chunked, embedded, indexed)


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
