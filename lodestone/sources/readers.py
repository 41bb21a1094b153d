"""Sources and sinks: tables, JSON lines, tab-separated files, vector stores and caches by fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import LinkError

Loader = Callable[..., DataFrame]
SPLIT_ALIASES = {"val": "validation", "valid": "validation", "dev": "validation"}


def load(spark: SparkSession, source: str | Loader, subset: str | None = None, split: str | None = None, **options) -> DataFrame:
    """A table by path, or what a callable ``(subset=, split=, **options)`` gives; errors of a callable name it."""
    if callable(source):
        try:
            got = source(subset=subset, split=split, **options)
        except Exception as e:
            raise RuntimeError(f"loader {getattr(source, '__name__', source)} failed for subset={subset}, split={split}") from e
        if not isinstance(got, DataFrame):
            raise TypeError(f"a loader must give a DataFrame, not {type(got).__name__}")
        if got.isStreaming:
            raise TypeError("streaming sources are not supported")
        return got
    df = spark.read.options(**options).parquet(source if subset is None else f"{source}/{subset}")
    return select_split(df, split)


def load_subsets(spark: SparkSession, source: str | Loader, subsets: Sequence[str] | None = None, split: str | None = None) -> DataFrame:
    """Each subset, or the whole, one after the other."""
    return concat([load(spark, source, s, split) for s in subsets or [None]])


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise LinkError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_name(split: str | None) -> str | None:
    """``val`` is ``validation``; null and ``all`` mean every split."""
    return None if split in (None, "all") else SPLIT_ALIASES.get(split, split)


def select_split(df: DataFrame, split: str | None) -> DataFrame:
    """Rows of a split, with the filter pushed to the scan; an unknown split raises with those there are."""
    split = split_name(split)
    if split is None:
        return df
    if "split" not in df.columns:
        raise LinkError(f"the table has no splits, {split} was asked for")
    there = df.filter(F.col("split") == split)
    if there.isEmpty():
        raise LinkError(f"no split {split}; there are {sorted(r[0] for r in df.select('split').distinct().limit(50).collect() if r[0])}")
    return there


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; what the schema doesn't name isn't parsed."""
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Tab-separated with a header; missing columns raise."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    if missing := set(names) - set(df.columns):
        raise LinkError(f"columns {sorted(missing)} are missing in {path}; there are {df.columns}")
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


# --- vectors ---------------------------------------------------------------------------------

MODES = ("read_or_write", "x", "r", "a")


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at the path whose write was committed; an aborted one is none."""
    return exists(spark, f"{path}/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_vectors(spark: SparkSession, path: str, make: Callable[[], DataFrame], mode: str = "read_or_write") -> DataFrame:
    """A store of ``(row_idx, vector)``: read it, else make it; x fails if it is there, r and a if it isn't; a appends.

    A store is there if its write was committed; what an aborted one left is overwritten.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {MODES}")
    there = committed(spark, path)
    if mode == "x" and there:
        raise FileExistsError(path)
    if mode in ("r", "a") and not there:
        raise FileNotFoundError(path)
    if mode == "a":
        make().write.mode("append").parquet(path)
    elif not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def put_vectors(spark: SparkSession, path: str, rows: DataFrame, dtype: str = "float") -> DataFrame:
    """Writes ``rows(row_idx, vector)`` at their numbers: a row of a number that the store has takes its place.

    The store is rewritten beside and then swapped, so that a failed write leaves the old one. Of
    repeated numbers in ``rows`` one stands; the vectors are kept as ``dtype``, which a later open reads back.
    """
    new = rows.select("row_idx", F.col("vector").cast(f"array<{dtype}>").alias("vector")).dropDuplicates(["row_idx"])
    if committed(spark, path):
        old = spark.read.parquet(path)
        new = old.join(new.select("row_idx"), "row_idx", "left_anti").select("row_idx", F.col("vector").cast(f"array<{dtype}>").alias("vector")).unionByName(new)
    new.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(f"{path}.new"), hadoop(path))
    return spark.read.parquet(path)


def rows_between(df: DataFrame, start: int, stop: int, index: str = "row_idx") -> DataFrame:
    """Rows start to stop - 1, by a filter that prunes row groups; a stop past the end is the end."""
    return df.filter((F.col(index) >= start) & (F.col(index) < stop))


def invalid_vectors(df: DataFrame) -> DataFrame:
    """Rows whose vector is null, has a null or NaN, or is all zero: of all rows, not of a sample."""
    v = F.col("vector")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x)) | F.forall(v, lambda x: x == 0)
    return df.filter(bad)


def vector_shape(df: DataFrame) -> int:
    """The one length of all vectors; different lengths raise."""
    r = df.filter("vector is not null").agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if r["a"] != r["b"]:
        raise LinkError(f"vectors of {r['a']} to {r['b']} elements")
    return r["a"]


def with_vectors(sections: DataFrame, vectors: DataFrame, shard: str) -> DataFrame:
    """Sections with a constant shard and their vectors by row; a section without one has null."""
    return sections.withColumn("shard", F.lit(shard)).join(vectors.select("row_idx", "vector"), "row_idx", "left")


# --- fingerprints and caches -----------------------------------------------------------------


def fingerprint(config: Mapping[str, object], without: Sequence[str] = ("host", "port", "proto_port", "persistent")) -> str:
    """sha256 of what affects a result: the sorted JSON of a configuration, less its addresses."""
    kept = {k: v for k, v in config.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()


def row_hashes(df: DataFrame) -> DataFrame:
    """``(n_rows, hash)``: independent of the rows' order and partitioning; by the first 8 hex digits of each row's md5."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("hash"))


def source_key(spark: SparkSession, path: str) -> str:
    """What state a file or folder is in: the sha256 of its files' names, lengths and times."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = fs.listFiles(fs.resolvePath(p), True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: Mapping[str, object], make: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] = lambda df: True) -> DataFrame:
    """The table that a key names: read if there and valid, else made, written and read."""
    path = f"{folder}/{fingerprint(key)}"
    if committed(spark, path):
        df = spark.read.parquet(path)
        if valid(df):
            return df
    make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def cache_scope(spark: SparkSession, folder: str, persist: bool = False, fresh: bool = False) -> Iterator[str]:
    """A folder that is removed at the end unless it is to persist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fresh:
        fs.delete(p, True)
    fs.mkdirs(p)
    try:
        yield folder
    finally:
        if not persist:
            fs.delete(p, True)


def metric_sink(df: DataFrame, path: str, pattern: str = ".*") -> DataFrame:
    """Appends metrics whose name matches to a table, and gives them."""
    kept = df.filter(F.col("metric").rlike("^(?:" + re.sub(r"^\^", "", pattern) + ")"))
    kept.write.mode("append").parquet(path)
    return kept


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as flat columns named by their paths."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(sep.join((*path, f.name)))

    return df.select(*walk(df.schema, ()))
