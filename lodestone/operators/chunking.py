"""Sections cut into chunks; the other columns go along, and chunks keep their parent's id."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_chunks(df: DataFrame, content: str = "content", delimiter: str = ". ", prefix: str = "") -> DataFrame:
    """One row for each part between delimiters, with ``chunk_no``; empty parts stay; null content has no chunk."""
    parts = F.posexplode(F.split(F.col(content), re.escape(delimiter)))
    out = df.select(*[c for c in df.columns if c != content], parts.alias("chunk_no", content))
    return out.withColumn(content, F.concat(F.lit(prefix), F.col(content))) if prefix else out


def fixed_chunks(df: DataFrame, content: str = "content", length: int = 50, stride: int = 40, prefix: str = "", ellipsis: str = "") -> DataFrame:
    """Windows of ``length`` words, ``min(stride, length)`` apart, with ``chunk_no``.

    The last chunk ends with the last word. The words of prefix and ellipses come off the length; a
    budget of no words raises. Null, empty and blank content is one empty chunk.
    """
    budget = length - len(prefix.split()) - 2 * len(ellipsis.split())
    if budget <= 0:
        raise ValueError(f"no words are left of {length} for content")
    step = min(stride, budget)
    words = F.filter(F.split(F.coalesce(F.col(content), F.lit("")), r"\s+"), lambda w: w != "")
    d = df.withColumn("_w", words)
    n = F.greatest(F.lit(0), F.ceil((F.size("_w") - budget) / F.lit(float(step)))).cast("int")
    d = d.withColumn("_n", n).select(*[c for c in df.columns if c != content], "_w", "_n", F.explode(F.sequence(F.lit(0), n)).alias("chunk_no"))
    text = F.array_join(F.slice("_w", F.col("chunk_no") * step + 1, budget), " ")
    head = F.when(F.col("chunk_no") > 0, F.lit(ellipsis)).otherwise(F.lit(""))
    tail = F.when(F.col("chunk_no") < F.col("_n"), F.lit(ellipsis)).otherwise(F.lit(""))
    return d.withColumn(content, F.concat(F.lit(prefix), head, text, tail)).drop("_w", "_n")
