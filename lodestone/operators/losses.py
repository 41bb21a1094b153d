"""Values of retrieval losses over ``(qid, row_idx, score, relevance[, sparse, dense])``; no gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import finite, log_softmax


def prepared(df: DataFrame) -> DataFrame:
    """Scored candidates with log-probabilities and binary targets."""
    df = df.filter(finite(F.col("score"))).withColumn("target", F.when(F.coalesce(F.col("relevance"), F.lit(0)) > 0, 1.0).otherwise(0.0))
    return df.withColumn("log_p", log_softmax(F.col("score").cast("double"), "qid"))


def _retrieval() -> Column:
    positives = F.sum("target")
    n = F.when(positives > 0, positives).otherwise(F.count(F.lit(1)).cast("double"))
    return F.sum((F.exp("log_p") - F.col("target")) * F.col("log_p")) / n


def _guidance(reference: str | None) -> Column:
    ref = F.col(reference).cast("double") if reference else F.lit(0.0)
    e = F.when(finite(ref), F.col("log_p") - ref)
    return F.avg(F.when(F.abs(e) < 1, e * e / 2).otherwise(F.abs(e) - 0.5))


def _self_supervision() -> Column:
    return -F.max(F.when(F.col("target") > 0, F.col("log_p")))


def _score_decay() -> Column:
    s = F.col("score").cast("double")
    return F.avg(s * s)


def _one(df: DataFrame, loss: Column) -> DataFrame:
    return prepared(df).groupBy("qid").agg(loss.alias("loss"))


def retrieval(df: DataFrame) -> DataFrame:
    """``(qid, loss)``: sum of (p - y) log p over the number of positives, or of candidates where there is none."""
    return _one(df, _retrieval())


def guidance(df: DataFrame, reference: str | None = "sparse") -> DataFrame:
    """``(qid, loss)``: mean Huber distance of the log-probability from a reference score, or from 0."""
    return _one(df, _guidance(reference))


def self_supervision(df: DataFrame) -> DataFrame:
    """``(qid, loss)``: cross-entropy against the best of the query's own positives; null without any."""
    return _one(df, _self_supervision())


def score_decay(df: DataFrame) -> DataFrame:
    """``(qid, loss)``: mean square of the scores."""
    return df.filter(finite(F.col("score"))).groupBy("qid").agg(_score_decay().alias("loss"))


def divergence(df: DataFrame, against: str) -> DataFrame:
    """``(qid, loss)``: sum of q (log q - log p) with q by another score over the candidates that have both."""
    d = df.filter(finite(F.col("score")) & finite(F.col(against)))
    d = d.withColumn("lp", log_softmax(F.col("score").cast("double"), "qid")).withColumn("lq", log_softmax(F.col(against).cast("double"), "qid"))
    return d.groupBy("qid").agg(F.sum(F.exp("lq") * (F.col("lq") - F.col("lp"))).alias("loss"))


def combined(df: DataFrame, weights: dict[str, float], reference: str | None = "sparse") -> DataFrame:
    """``(qid, loss)``: weighted sum, in one aggregation, of the losses named retrieval, guidance, self_supervision and score_decay."""
    known = {"retrieval": _retrieval, "guidance": lambda: _guidance(reference), "self_supervision": _self_supervision, "score_decay": _score_decay}
    total: Column = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.coalesce(known[name](), F.lit(0.0))
    # Queries without a scored candidate keep a row, with the loss 0.
    every = df.groupBy("qid").agg(F.lit(0.0).alias("none"))
    return every.join(_one(df, total), "qid", "left").select("qid", F.coalesce("loss", "none").alias("loss"))


def marginal_likelihood(df: DataFrame, log_likelihood: str = "logp_x_z") -> DataFrame:
    """``(qid, loss)``: minus the log of the sum over candidates of p(z | q) p(x | z)."""
    d = prepared(df).withColumn("j", F.col("log_p") + F.col(log_likelihood))
    m = F.max("j").over(Window.partitionBy("qid"))
    return d.withColumn("m", m).groupBy("qid").agg((-(F.first("m") + F.ln(F.sum(F.exp(F.col("j") - F.col("m")))))).alias("loss"))
