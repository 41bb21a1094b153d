"""Training rows: search, merge, sample and fetch for a whole set of queries, in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import fusion, sampling
from lodestone.operators.harmonise import best_answer


def with_relevance(merged: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds relevance by (qid, row_idx) from ``gold``; 0 where it has none."""
    return merged.join(gold.select("qid", "row_idx", "relevance"), ["qid", "row_idx"], "left").withColumn("relevance", F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)))


def samples(engines: Mapping[str, DataFrame], gold: DataFrame, weights: Mapping[str, float] | None = None, n_sections: int = 10, max_positives: int = 3, do_sample: bool = False, seed: int = 0, support: int | None = None) -> DataFrame:
    """Sampled sections of each query: merged score, raw scores, label by lookup, relevance by gold, and weights."""
    merged = fusion.hybrid(engines, weights)
    picked = sampling.labeled_priority_sample(merged, n_sections, max_positives, 1.0 if do_sample else 0.0, seed, support)
    return with_relevance(picked.withColumn("label", F.col("positive").cast("int")), gold)


def batch_rows(queries: DataFrame, sampled: DataFrame, sections: DataFrame, columns: tuple[str, ...] = ("section_id", "content")) -> DataFrame:
    """One row for each query: its best answer and its sections, best first; texts are joined after the sampling."""
    full = sampled.join(sections.select("row_idx", *columns), "row_idx")
    fields = ["row_idx", "score", "label", "relevance", "log_weight", *columns]
    packed = full.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("_o"), *fields))).alias("sections"))
    packed = packed.select("qid", F.transform("sections", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("sections"))
    answer = best_answer(F.col("answers"), F.col("answer_scores")) if "answers" in queries.columns else F.lit("")
    return queries.withColumn("answer", answer).join(packed, "qid")
