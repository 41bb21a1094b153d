"""Ranking metrics over long candidate lists ``(qid, row_idx, score, relevance)``.

Candidates without a score (null, NaN or infinite) are dropped before ranking; undefined values are
null. By default nDCG's ideal is that of the truncated list, precision divides by the
candidates found, and recall by the positives among the candidates; ``strict`` divides
precision by k, and takes ideal and recall over the whole list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import finite


def ranked(df: DataFrame) -> DataFrame:
    """Adds rank, the ideal rank and the log-probabilities that the divergence compares."""
    q = Window.partitionBy("qid")
    rel = F.coalesce(F.col("relevance").cast("double"), F.lit(0.0))
    df = df.filter(finite(F.col("score"))).withColumn("relevance", rel).withColumn("score", F.col("score").cast("double"))
    return df.withColumn("rank", F.row_number().over(q.orderBy(F.round("score", 9).desc(), "row_idx"))).withColumn("n_positive", F.count_if(F.col("relevance") > 0).over(q))


def _inside(k: int | None) -> Column:
    return F.lit(True) if k is None else F.col("rank") <= k


def mrr(k):
    return F.coalesce(F.lit(1.0) / F.min(F.when(_inside(k) & (F.col("relevance") > 0), F.col("rank"))), F.lit(0.0))


def hitrate(k):
    return F.max(F.when(_inside(k) & (F.col("relevance") > 0), 1.0).otherwise(0.0))


def precision(k, strict=False):
    n = F.lit(float(k)) if strict and k else F.count_if(_inside(k)).cast("double")
    return F.try_divide(F.count_if(_inside(k) & (F.col("relevance") > 0)).cast("double"), n)


def recall(k):
    return F.try_divide(F.count_if(_inside(k) & (F.col("relevance") > 0)).cast("double"), F.max("n_positive").cast("double"))


def minimum(k):
    return F.min(F.when(_inside(k), F.col("score")))


def maximum(k):
    return F.max(F.when(_inside(k), F.col("score")))


METRICS: dict[str, Callable[[int | None], Column]] = {"mrr": mrr, "hitrate": hitrate, "precision": precision, "recall": recall, "min": minimum, "max": maximum}
#: Metrics that need another pass of windows over the truncated list.
WINDOWED = ("ndcg", "kldiv", "entropy", "entropy_raw")


def parse(name: str) -> tuple[str, int | None]:
    """``ndcg_10`` is nDCG of the first ten."""
    m = re.fullmatch(r"([a-z_]+?)(?:_(\d+))?", name)
    if not m or m.group(1) not in (*METRICS, *WINDOWED):
        raise ValueError(f"unknown metric {name}; known: {sorted([*METRICS, *WINDOWED])}")
    return m.group(1), int(m.group(2)) if m.group(2) else None


def windowed(df: DataFrame, name: str, k: int | None, strict: bool = False) -> DataFrame:
    """``(qid, value)`` of a metric that compares whole lists."""
    q = Window.partitionBy("qid")
    cut = df if k is None else df.filter(F.col("rank") <= k)
    if name == "ndcg":
        whole = df if strict else cut
        ideal = whole.withColumn("ir", F.row_number().over(q.orderBy(F.col("relevance").desc(), "rank")))
        ideal = ideal if k is None else ideal.filter(F.col("ir") <= k)
        gain = lambda r: F.sum(F.col("relevance") / F.log2(F.col(r) + 1.0))
        both = cut.groupBy("qid").agg(gain("rank").alias("dcg")).join(ideal.groupBy("qid").agg(gain("ir").alias("best")), "qid")
        return both.select("qid", F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)).alias("value"))
    m = F.max("score").over(q)
    lp = F.col("score") - m - F.ln(F.sum(F.exp(F.col("score") - m)).over(q))
    if name == "entropy":
        return cut.withColumn("lp", lp).groupBy("qid").agg((-F.sum(F.exp("lp") * F.col("lp"))).alias("value"))
    if name == "entropy_raw":
        return cut.withColumn("lp", lp).groupBy("qid").agg((-F.sum(F.exp("score") * F.col("lp"))).alias("value"))
    rel = F.when(F.col("relevance") > 0, F.col("relevance"))
    rm = F.max(rel).over(q)
    ld = rel - rm - F.ln(F.sum(F.exp(rel - rm)).over(q))
    d = cut.withColumn("lp", lp).withColumn("ld", ld)
    return d.groupBy("qid").agg(F.sum(F.exp("ld") * (F.col("ld") - F.col("lp"))).alias("value"))


def per_query(df: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    """``(qid, <name>...)``: the metrics of each query; the plain ones in one aggregation."""
    r = ranked(df)
    plain = [n for n in names if parse(n)[0] in METRICS]
    out = r.groupBy("qid").agg(*[(precision(parse(n)[1], strict) if parse(n)[0] == "precision" else METRICS[parse(n)[0]](parse(n)[1])).alias(n) for n in plain]) if plain else r.select("qid").distinct()
    for n in names:
        base, k = parse(n)
        if base in WINDOWED:
            out = out.join(windowed(r, base, k, strict).withColumnRenamed("value", n), "qid", "left")
    return out.select("qid", *names)


def summary(df: DataFrame, names: Sequence[str], score_columns: Sequence[str] = ("score",), strict: bool = False) -> DataFrame:
    """``(score_key, metric, value, n_queries)``: means over the queries for each score column; undefined values are left out."""
    # One pass: a list for each query and score column.
    scores = F.explode(F.array(*[F.struct(F.lit(c).alias("score_key"), F.col(c).cast("double").alias("score")) for c in score_columns])).alias("s")
    long = df.select("qid", "row_idx", "relevance", scores).select(F.struct(F.col("s.score_key").alias("score_key"), "qid").alias("qid"), "row_idx", "s.score", "relevance")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    each = per_query(long, names, strict).select(F.col("qid.score_key").alias("score_key"), pairs)
    return each.groupBy("score_key", F.col("m.metric").alias("metric")).agg(F.avg("m.value").alias("value"), F.count("m.value").alias("n_queries"))
