"""Pairs of the members of groups, without a task that holds a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet each other within one join key.
BLOCK = 256


def _blocked(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Members of groups of two or more, with their block and their group's number of blocks.

    The counts are joined back by an equi-join, so that adaptive execution may split a hot key.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    return members.join(sizes, key).select(
        key, ident, blocks.alias("_nb"), F.pmod(F.xxhash64(ident), blocks).cast("int").alias("_b")
    )


def pairs_within(members: DataFrame, key: str, ident: str, extra: Column | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs ``(id_a, id_b)``, ``id_a < id_b``, of the distinct members of each group.

    ``members`` has one row per (key, ident); repeated rows are dropped, and null keys or ids
    are in no group. A group of n members is cut into ceil(n / block) blocks by a hash of
    the id, and the join key is (group, block, other block): every pair meets under exactly
    one key, and no key gathers more than about ``block`` members of either side, whatever
    the group's size. ``extra`` is a condition on the columns a_*, b_* of both sides.
    """
    base = members.filter(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(key, ident).distinct()
    both = _blocked(base, key, ident, block)
    a = both.select(key, F.col(ident).alias("_x"), F.col("_b").alias("_p"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_q"))
    b = both.select(key, F.col(ident).alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_p"), F.col("_b").alias("_q"))
    joined = a.join(b, [key, "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col("_x") < F.col("_y")))
    if extra is not None:
        joined = joined.filter(extra)
    return joined.select(
        key, F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")
    )
