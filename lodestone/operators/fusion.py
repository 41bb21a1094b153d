"""Fusion of several engines' hits, and shards.

Hits are long: ``(qid, engine, row_idx, score[, label])``. A section that an engine missed
contributes 0 to the merged score, the same as that engine's worst hit after ``min_subtract``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import LinkError
from lodestone.functions.scoring import clamp_impossible, min_subtract
from lodestone.operators.lexical import top

#: Engine whose hits are labels only.
LOOKUP = "lookup"


def fan_in(engines: Mapping[str, DataFrame]) -> DataFrame:
    """Hits of every engine in one table with an ``engine`` column."""
    parts = [df.select("qid", F.lit(e).alias("engine"), "row_idx", clamp_impossible(F.col("score").cast("double")).alias("score")) for e, df in engines.items()]
    if not parts:
        raise LinkError("no engine to merge")
    return reduce(DataFrame.unionByName, parts)


def normalised(hits: DataFrame, offset: float = 0.0) -> DataFrame:
    return hits.withColumn("score", min_subtract(F.col("score"), "qid", "engine", offset=offset))


def merge(hits: DataFrame, weights: Mapping[str, float] | DataFrame | None = None, engines: Sequence[str] = (), normalise: bool = True) -> DataFrame:
    """``(qid, row_idx, score, <engine>..., label)``: weighted sum over the engines.

    A weight not given is 1; a weight of 0 keeps the engine's raw scores. ``engines`` names the raw
    score columns; they are null where the engine missed the section. label is 1 for a
    lookup hit, else null; the scores of lookup are 0. ``weights`` may be a table
    ``(qid, engine, weight)`` for weights by query.
    """
    raw = F.col("score")
    n = hits.withColumn("raw", raw).withColumn("score", F.when(F.col("engine") == LOOKUP, F.lit(0.0)).otherwise(min_subtract(raw, "qid", "engine") if normalise else raw))
    if isinstance(weights, DataFrame):
        n = n.join(weights, ["qid", "engine"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        w = F.lit(1.0)
        for e, x in (weights or {}).items():
            w = F.when(F.col("engine") == e, F.lit(float(x))).otherwise(w)
        n = n.withColumn("weight", w)
    columns = [F.max(F.when(F.col("engine") == e, F.col("raw"))).alias(e) for e in engines if e != LOOKUP]
    return n.groupBy("qid", "row_idx").agg(
        F.sum(F.col("weight") * F.coalesce(F.when(F.abs(F.col("score")) < float("inf"), F.col("score")), F.lit(0.0))).alias("score"), *columns, F.max(F.when(F.col("engine") == LOOKUP, F.lit(1))).alias("label")
    )


def offsets(sizes: DataFrame) -> DataFrame:
    """``(shard, n, offset)`` of ``(shard, n)``: number of rows of the shards before, in the shards' order."""
    # One row a shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))


def globalised(hits: DataFrame, shard_offsets: DataFrame) -> DataFrame:
    """Hits of shards with the row numbers of the concatenated sections."""
    return hits.join(F.broadcast(shard_offsets.select("shard", "offset")), "shard").withColumn("row_idx", F.col("row_idx") + F.col("offset")).drop("offset")


def check_shards(queries: DataFrame, sections: DataFrame) -> None:
    """Raises if a query names a shard that has no section."""
    missing = [r[0] for r in queries.select("shard").distinct().join(sections.select("shard").distinct(), "shard", "left_anti").limit(5).collect()]
    if missing:
        raise LinkError(f"shards without sections: {missing}")


def hybrid(engines: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """Engines' hits to the merged ranking in one plan; an engine with a negative weight is left out."""
    on = {e: df for e, df in engines.items() if (weights or {}).get(e, 1.0) >= 0}
    return top(merge(fan_in(on), weights, list(on)), top_k)
