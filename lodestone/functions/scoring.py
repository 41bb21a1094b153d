"""Scores of candidate lists: normalisation, softmax, schedules."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def clamp_impossible(c: Column, limit: float = 3e12) -> Column:
    """Scores from ``limit`` on are no scores: null."""
    return F.when(c < F.lit(limit), c)


def min_subtract(score: Column, *by: str, offset: float = 0.0) -> Column:
    """Subtracts the least finite score of the group; NaN, infinite and null scores pass as they are."""
    low = F.min(F.when(finite(score), score)).over(Window.partitionBy(*by))
    return F.when(finite(score), score - low + F.lit(float(offset))).otherwise(score)


def log_softmax(score: Column, *by: str) -> Column:
    """Log-softmax over the group; NaN and null count as absent (null), as does -inf."""
    w = Window.partitionBy(*by)
    s = F.when(finite(score), score)
    shifted = s - F.max(s).over(w)
    return shifted - F.ln(F.sum(F.exp(shifted)).over(w))


def log_sum_exp(score: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    s = F.when(finite(score), score)
    high = F.max(s).over(w)
    return high + F.ln(F.sum(F.exp(s - high)).over(w))


def max_or_zero(score: Column, *by: str) -> Column:
    return F.coalesce(F.max(F.when(finite(score), score)).over(Window.partitionBy(*by)), F.lit(0.0))


def fill_below_min(score: Column, *by: str, offset: float = -1.0) -> Column:
    """NaN and null become the group's least score plus ``offset``; a group without scores gets ``offset``."""
    s = F.when(~F.isnan(score), score)
    return F.coalesce(s, F.coalesce(F.min(s).over(Window.partitionBy(*by)), F.lit(0.0)) + F.lit(float(offset)))


def schedule(kind: str, step: Column, value: float, start: float = 0.0, period: float = 1.0, offset: float = 0.0) -> Column:
    """A parameter by step: constant, linear, step or exponential.

    linear goes from start to value over [offset, offset + period]; step switches at period;
    exponential is start + (value - start) * (1 - exp(-(step - offset) / period)), from offset on.
    """
    t = step.cast("double")
    if kind == "constant":
        return F.lit(float(value))
    if kind == "step":
        return F.when(t < period, F.lit(float(start))).otherwise(F.lit(float(value)))
    x = F.greatest(F.lit(0.0), (t - offset) / F.lit(float(period)))
    if kind == "linear":
        return F.lit(float(start)) + F.lit(float(value - start)) * F.least(F.lit(1.0), x)
    if kind == "exponential":
        return F.lit(float(start)) + F.lit(float(value - start)) * (1 - F.exp(-x))
    raise ValueError(f"unknown schedule {kind}; known: constant, linear, step, exponential")


def auto_centroids(n: Column, threads: int = 1) -> Column:
    """Number of cells for n vectors: the power of two at n / 128, at least the threads."""
    return F.greatest(F.lit(threads).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(n / F.lit(128.0)))).cast("long"))
