"""Sampling of candidates and rows, with weights. Noise is a hash of (seed, query, section): a sample can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import finite, log_softmax, log_sum_exp


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number in (0, 1) by the md5 of the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def _keyed(df: DataFrame, by: list[str], temperature: float, seed: int | str, support: int | None) -> DataFrame:
    if support is not None:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "row_idx"))
        df = df.withColumn("_s", rank).filter(F.col("_s") <= support).drop("_s")
    scaled = F.col("score") / F.lit(float(temperature)) if temperature > 0 else F.col("score")
    df = df.filter(finite(F.col("score"))).withColumn("log_p", log_softmax(scaled, *by)).withColumn("lse", log_sum_exp(F.col("score"), *by))
    noise = F.ln(-F.ln(uniform(seed, "qid", "row_idx"))) if temperature > 0 else F.lit(0.0)
    return df.withColumn("_key", F.col("log_p") - noise)


def _weighted(df: DataFrame, by: list[str], quota: Column, noisy: bool) -> DataFrame:
    """Rows whose key is among the first ``quota``, with their log weights against the next key."""
    w = Window.partitionBy(*by)
    df = df.withColumn("_rk", F.row_number().over(w.orderBy(F.col("_key").desc(), "row_idx"))).withColumn("_q", quota)
    tau = F.max(F.when(F.col("_rk") == F.col("_q") + 1, F.col("_key"))).over(w)
    df = df.withColumn("_tau", tau).filter(F.col("_rk") <= F.col("_q"))
    if noisy:
        inclusion = -F.expm1(-F.exp(F.col("log_p") - F.col("_tau")))
        weight = F.when(F.col("_tau").isNull(), F.col("log_p")).otherwise(F.col("log_p") - F.ln(inclusion))
    else:
        weight = F.col("log_p")
    return df.withColumn("log_weight", weight)


def priority_sample(df: DataFrame, k: int, temperature: float = 1.0, seed: int | str = 0, support: int | None = None) -> DataFrame:
    """``k`` of the candidates ``(qid, row_idx, score)`` of each query without replacement, with ``log_weight``.

    The key is the log-probability less the log of exponential noise; the weight corrects for the
    threshold, the (k+1)-th key. Temperature divides the scores; 0 is the deterministic top k.
    ``support`` keeps the best that many before. Candidates without a finite score are left out.
    """
    keyed = _keyed(df, ["qid"], temperature, seed, support)
    return _weighted(keyed, ["qid"], F.lit(k), temperature > 0).drop("_key", "_rk", "_q", "_tau")


def labeled_priority_sample(df: DataFrame, k_total: int, k_positive: int, temperature: float = 1.0, seed: int | str = 0, support: int | None = None, normalise: bool = True) -> DataFrame:
    """Samples positives and negatives of ``(qid, row_idx, score, label)`` apart.

    Up to ``k_positive`` positives (more if negatives are short), negatives fill up to
    ``k_total``. With ``normalise`` the weights of each label are a distribution.
    ``lse`` is that of the raw scores of the label; ``max_sampling_id`` the number of negatives
    that score at least as high as the worst that was sampled.
    """
    df = df.withColumn("positive", F.coalesce(F.col("label") > 0, F.lit(False)))
    if support is not None:
        support = max(support, k_total)
    keyed = _keyed(df, ["qid", "positive"], temperature, seed, support)
    q = Window.partitionBy("qid")
    keyed = keyed.withColumn("_pos", F.count_if("positive").over(q)).withColumn("_neg", F.count_if(~F.col("positive")).over(q))
    n_pos = F.least(F.col("_pos"), F.greatest(F.lit(k_positive), F.lit(k_total) - F.col("_neg")))
    quota = F.when(F.col("positive"), n_pos).otherwise(F.lit(k_total) - n_pos)
    out = _weighted(keyed, ["qid", "positive"], quota, temperature > 0)
    if normalise:
        out = out.withColumn("log_weight", log_softmax(F.col("log_weight"), "qid", "positive"))
    worst = out.filter("not positive").groupBy("qid").agg(F.min("score").alias("_worst"))
    above = keyed.filter("not positive").join(worst, "qid").filter("score >= _worst").groupBy("qid").agg(F.count(F.lit(1)).alias("max_sampling_id"))
    return out.drop("_key", "_rk", "_q", "_tau", "_pos", "_neg").join(above, "qid", "left")


def lookup_weights(df: DataFrame, feature: str, weights: dict[str, float], default: float = 0.0) -> DataFrame:
    """Row weights by the value of a feature."""
    w = F.lit(float(default))
    for k, v in weights.items():
        w = F.when(F.col(feature) == k, F.lit(float(v))).otherwise(w)
    return df.withColumn("weight", w)


def inverse_frequency_weights(df: DataFrame, feature: str) -> DataFrame:
    """Row weights 1 / number of rows with the value; the counts are joined back, so a frequent value isn't gathered. Null is a value."""
    counts = df.groupBy(F.col(feature).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, F.col(feature).eqNullSafe(F.col("_f"))).withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_f", "_n")


def product_weights(df: DataFrame, *columns: str) -> DataFrame:
    w = F.lit(1.0)
    for c in columns:
        w = w * F.col(c)
    return df.withColumn("weight", w)


def sampler(df: DataFrame, spec: dict | list) -> DataFrame:
    """Weights by a description: ``{mode: lookup|inverse_frequency, key, weights, default}``, or a list as their product."""
    if isinstance(spec, list):
        names = []
        for i, s in enumerate(spec):
            df = sampler(df, s).withColumnRenamed("weight", f"_w{i}")
            names.append(f"_w{i}")
        return product_weights(df, *names).drop(*names)
    mode = spec.get("mode")
    if mode == "lookup":
        if "weights" not in spec:
            raise ValueError("mode lookup needs a table of weights")
        return lookup_weights(df, spec["key"], spec["weights"], spec.get("default", 0.0))
    if mode == "inverse_frequency":
        return inverse_frequency_weights(df, spec["key"])
    raise ValueError(f"unknown sampler mode {mode}")


def draw(df: DataFrame, n: int, ident: str, seed: int | str = 0) -> DataFrame:
    """``n`` rows by weight without replacement: the largest keys ln(u) / weight; a weight of 0 is never drawn."""
    key = F.ln(uniform(seed, ident)) / F.col("weight")
    return df.filter("weight > 0").orderBy(key.desc(), ident).limit(n)


def subset(df: DataFrame, n: int, ident: str, seed: int | str = 0) -> DataFrame:
    """The ``n`` rows with the smallest hashes: a subset that doesn't depend on the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(ident).cast("string"))), ident).limit(n)


def in_batch_negatives(samples: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Every query of a batch with every section sampled in it; ``(qid, row_idx, score, label)``.

    A batch is of bounded size by its maker. A section that a query hadn't sampled has a null score and label 0.
    """
    sections = samples.select(batch, "row_idx").distinct()
    queries = samples.select(batch, "qid").distinct()
    pairs = queries.join(sections, batch)
    return pairs.join(samples.select(batch, "qid", "row_idx", "score", "label"), [batch, "qid", "row_idx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
