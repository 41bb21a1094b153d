"""Forms of a text that several operators compare."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


def bare(c: Column) -> Column:
    """Lower case, with everything but letters and digits taken out; null is blank."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def word_text(c: Column) -> Column:
    """The words of a text in lower case with one space between them; null has none."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def digest(*cols: Column) -> Column:
    """128 bits over the whole of all columns; null and empty differ."""
    return F.unhex(F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "true"})))


def bare_text(s: str | None) -> str:
    return "".join(WORD.findall((s or "").lower()))


def words(s: str | None) -> list[str]:
    return WORD.findall((s or "").lower())


def bounded_sample(df: DataFrame, text: str, most: int) -> list[str]:
    """About ``most`` texts, at most, chosen by their hash: the same for any partitioning.

    The share is set from the number of rows, so that tasks send only chosen rows.
    """
    n = df.count()
    if not n:
        return []
    share = min(1.0, 0.95 * most / n)
    limit = int(share * 2**31) if share < 1 else 2**31
    chosen = df.filter(F.pmod(F.xxhash64(text), F.lit(2**31)) < limit).select(text)
    return sorted(r[0] for r in chosen.take(most))
