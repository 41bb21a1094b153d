"""Problem 4: duplicates hidden by formatting differences.

Byte-identical raw rows are collapsed first, whatever their ids, with their counts, by a map-side
combined aggregation; only the distinct survivors are canonicalised, each once, and carried on
as the 128-bit digest of the full canonical text; the ids, which travel beside as (digest of the raw row,
id, count), are joined to them, and grouped again with the counts summed. Each distinct raw text
is shuffled once, in the first step; no other step carries text. Pairs of ids come from ``pairs_within``, which splits hot groups.

Null columns count as blank, so a row with nothing but blanks has the blank canonical form and
is a copy of other such rows. Repeated rows of one id are one record in the pairs, and count as
copies in ``copies``. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import bare, digest
from lodestone.operators.pairs import pairs_within
from lodestone.session import table

Canon = Callable[[], list[Column]]


def survivors(df: DataFrame, raw: list[str]) -> DataFrame:
    """``(d, raw..., n)``: the distinct raw rows by their bytes, their digest and how often they stand."""
    return df.groupBy(*[F.col(c) for c in raw]).agg(F.count(F.lit(1)).alias("n")).withColumn("d", digest(*[F.col(c) for c in raw]))


def members(df: DataFrame, ident: str, raw: list[str], canon: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(key, id, n)``: the canonical key of each id, and the number of its raw rows.

    ``canon`` makes ``(d, key)`` of the survivors; those that it leaves out belong to no record.
    """
    keys = canon(survivors(df, raw)).select("d", "key")
    ids = df.select(F.col(ident).alias("id"), digest(*[F.col(c) for c in raw]).alias("d")).groupBy("d", "id").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(keys, "d").select("key", "id", "n").groupBy("key", "id").agg(F.sum("n").alias("n"))


def copies(m: DataFrame) -> DataFrame:
    """One row for each canonical record: the id that stands for it, its ids and its rows."""
    return m.groupBy("key").agg(F.min("id").alias("rep_id"), F.count("id").alias("n_ids"), F.sum("n").alias("n_rows"))


def answer_set(c: str) -> Column:
    """The set of bare forms of the answers that aren't blank, in order."""
    forms = F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), bare)
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x != "")))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = table(spark, d, "sections").filter(~F.coalesce("deleted", F.lit(False)))
    q = table(spark, d, "queries")
    r = table(spark, d, "raw_records")
    forms = lambda *cols: lambda x: x.select("d", digest(*cols).alias("key"))
    return {
        "sections": members(s, "id", ["title", "content"], forms(bare(F.col("title")), bare(F.col("content")))),
        "queries": members(q, "id", ["query", "answers"], forms(bare(F.col("query")), answer_set("answers"))),
        "raw_records": members(r, "raw_id", ["payload"], _parsed),
    }


def _parsed(x: DataFrame) -> DataFrame:
    """Payloads that are JSON objects with a query."""
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    p = x.select("d", F.from_json("payload", "query string, answers array<string>, _bad string", options).alias("p")).filter("p is not null and p._bad is null and p.query is not null")
    return p.select("d", digest(bare(F.col("p.query")), answer_set("p.answers")).alias("key"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids of one table whose records are the same but for formatting."""
    every = None
    for name, m in _tables(spark, d).items():
        part = m.select(F.concat(F.encode(F.lit(name + ":"), "utf-8"), "key").alias("key"), "id", F.lit(name).alias("rec_table"))
        every = part if every is None else every.unionByName(part)
    p = pairs_within(every, "key", "id")
    name = F.substring_index(F.decode(F.substring("key", 1, 12), "iso-8859-1"), ":", 1)
    # An id that was sent with two texts may share either with another id.
    return p.select(name.alias("rec_table"), "id_a", "id_b").distinct()


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each canonical record with its number of copies, of records that have any."""
    every = None
    for name, m in _tables(spark, d).items():
        part = copies(m).filter("n_rows > 1").select(F.lit(name).alias("rec_table"), "rep_id", "n_ids", "n_rows")
        every = part if every is None else every.unionByName(part)
    return every


QUERIES = {"p4_found": p4_found, "p4_copies": p4_copies}

_BARE = "regexp_replace(lower(coalesce({}, '')), '[^\\pL\\pN]+', '', 'g')"
_ANS = "list_sort(list_distinct(list_filter(list_transform(coalesce({}, []), lambda x: " + _BARE.format("x") + "), lambda y: y <> '')))"
_KEYS = f"""
ok AS (SELECT raw_id, payload::JSON AS p FROM raw_records WHERE json_valid(payload)),
m AS (
  SELECT 'sections' AS rec_table, id, {_BARE.format('title')} AS k1, [{_BARE.format('content')}] AS k2 FROM sections WHERE NOT coalesce(deleted, false)
  UNION ALL SELECT 'queries', id, {_BARE.format('query')}, {_ANS.format('answers')} FROM queries
  UNION ALL SELECT 'raw_records', raw_id, {_BARE.format("(p->>'query')")}, {_ANS.format("(p->'answers')::VARCHAR[]")} FROM ok)
"""
SQL = {
    "p4_found": f"WITH {_KEYS}, u AS (SELECT DISTINCT * FROM m) SELECT DISTINCT a.rec_table, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.rec_table = b.rec_table AND a.k1 = b.k1 AND a.k2 = b.k2 AND a.id < b.id",
    "p4_copies": f"WITH {_KEYS} SELECT rec_table, min(id) AS rep_id, count(DISTINCT id) AS n_ids, count(*) AS n_rows FROM m GROUP BY rec_table, k1, k2 HAVING count(*) > 1",
}
