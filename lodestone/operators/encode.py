"""Encoders: text to vectors, pooling, norms, and vectors kept by fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.sources.readers import cached, invalid_vectors

Encoder = Callable[[list[str]], np.ndarray]


def hashed_bag(df: DataFrame, text: str, dim: int = 64, ident: str = "row_idx") -> DataFrame:
    """``(ident, vector)``: unit vectors of signed word hashes, all in the JVM. Texts without words have the zero vector."""
    t = df.select(ident, F.explode_outer(tokens(F.col(text))).alias("t")).select(ident, F.xxhash64("t").alias("h"), F.col("t").isNotNull().alias("has"))
    sign = F.when(F.pmod(F.shiftright("h", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    slots = t.groupBy(ident, F.pmod("h", F.lit(dim)).cast("int").alias("i")).agg(F.sum(F.when(F.col("has"), sign).otherwise(0.0)).alias("x"))
    maps = slots.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))  # at most dim entries
    raw = maps.select(ident, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))
    return raw.select(ident, normalised(F.col("v")).alias("vector"))


def encode(df: DataFrame, text: str, make: Callable[[], Encoder], ident: str = "row_idx", batch: int = 512) -> DataFrame:
    """``(ident, vector)`` by any encoder, which is made once for each task and fed batches."""
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for p in frames:
            for i in range(0, len(p), batch):
                part = p.iloc[i : i + batch]
                v = np.asarray(f(part[text].fillna("").tolist()), dtype=np.float32)
                yield pd.DataFrame({ident: part[ident].to_numpy(), "vector": list(v)})

    return df.select(ident, text).mapInPandas(run, f"{ident} {kind}, vector array<float>")


def cached_vectors(df: DataFrame, folder: str, key: Mapping[str, object], text: str, make: Callable[[], Encoder], ident: str = "row_idx") -> DataFrame:
    """Vectors by key: valid ones are read, else they are computed anew."""
    return cached(df.sparkSession, folder, key, lambda: encode(df, text, make, ident), lambda v: invalid_vectors(v.select("vector")).isEmpty())


def normalised(v: Column, kind: str = "l2") -> Column:
    """A vector over its l1 or l2 norm; the zero vector stays."""
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    n = F.sqrt(add(lambda x: x * x)) if kind == "l2" else add(F.abs)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def activated(v: Column, kind: str) -> Column:
    f = {
        "relu": lambda x: F.greatest(x, F.lit(0.0)), "tanh": F.tanh, "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
        "gelu": lambda x: 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x))),
    }[kind]
    return F.transform(v, lambda x: f(x.cast("double")))


def scaled(v: Column, log_scaler: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(float(np.exp(0.5 * log_scaler))))


def pooled(df: DataFrame, by: str, kind: str = "mean", mask: str | None = None, order: str = "row_idx") -> DataFrame:
    """``(by, vector)`` over rows ``(by, row_idx, vector)``: mean of unmasked rows, the first (cls), or the one with the largest norm."""
    d = df.filter(mask) if mask else df
    if kind == "mean":
        flat = d.select(by, F.posexplode("vector").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    if kind == "cls":
        return d.groupBy(by).agg(F.min_by("vector", order).alias("vector"))
    if kind == "max_norm":
        n = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return d.groupBy(by).agg(F.min_by("vector", F.struct(-F.round(n, 9), F.col(order))).alias("vector"))
    raise ValueError(f"unknown pooling {kind}")
