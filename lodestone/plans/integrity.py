"""Queries of problem 5: orphan references of ``queries`` and ``qrels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.references import Edge, cascade, month, unresolved
from lodestone.session import materialize, table


def references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references ``(ref_table, query_id, section_id, made_at)`` to sections."""
    q = table(spark, d, "queries").select(
        F.lit("queries").alias("ref_table"), F.col("id").alias("query_id"), F.explode("retrieval_ids").alias("section_id"), F.col("created_at").alias("made_at")
    )
    r = table(spark, d, "qrels").select(
        F.lit("qrels").alias("ref_table"), "query_id", F.col("corpus_id").alias("section_id"), F.col("judged_at").alias("made_at")
    )
    return q.unionByName(r).distinct()


def orphan_references(spark: SparkSession, d: str) -> DataFrame:
    """The references that the cascade finds under what they refer to: a section at a moment.

    Sections at the moments that are referred to, each once however often it is, are checked by the as-of join; those
    without a living record are the direct orphans of the foreign-key graph, and the references, their children, are found by the
    cascade's semi-joins.
    """
    refs = references(spark, d).filter("section_id is not null")
    kind = refs.schema["made_at"].dataType
    zoned = kind.simpleString() == "timestamp"  # as a number, since a local time may be ambiguous
    at = (F.unix_micros("made_at") if zoned else F.col("made_at")).cast("string").alias("at")
    refs = refs.withColumn("parent", F.to_json(F.struct("section_id", at))).withColumn("child", F.to_json(F.struct("ref_table", "query_id", "section_id", at)))
    events = table(spark, d, "sections").select("id", "loaded_at", "deleted")
    gone = unresolved(refs.select("section_id", "made_at", "parent").distinct(), events)
    orphans = cascade(gone.select(F.lit("sections").alias("rec_table"), F.col("parent").alias("rec_id")), [Edge("references", "sections", refs.select("child", "parent"))])
    r = F.from_json("rec_id", "ref_table string, query_id string, section_id string, at string").alias("r")
    made = F.timestamp_micros(F.col("r.at").cast("long")) if zoned else F.col("r.at").cast(kind)
    return orphans.filter("rec_table = 'references'").select(r).select("r.ref_table", "r.query_id", "r.section_id", made.alias("made_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(spark, d).select("ref_table", "query_id", "section_id").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved and all references per table and month of the reference."""
    bad = orphan_references(spark, d).groupBy("ref_table", month(F.col("made_at")).alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
    every = references(spark, d).filter(F.col("section_id").isNotNull() & (F.regexp_replace("section_id", r"\s", "") != ""))
    every = every.groupBy("ref_table", month(F.col("made_at")).alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
    return every.join(bad, ["ref_table", "month"], "left").select("ref_table", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))


def p5_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Records orphaned directly and by inheritance, per table, kind and month of the record.

    A query with an unresolved retrieval id is a direct orphan, a judgement with an
    unresolved corpus id too; a judgement of an orphaned query inherits.
    """
    bad = materialize(p5_found(spark, d), "refs")
    key = F.concat_ws("\u0001", "query_id", "section_id")
    direct = bad.select("ref_table", F.when(F.col("ref_table") == "queries", F.col("query_id")).otherwise(key).alias("rec_id")).withColumnRenamed("ref_table", "rec_table")
    qrels = table(spark, d, "qrels").select("query_id", F.col("corpus_id").alias("section_id"), "judged_at")
    edges = [Edge("qrels", "queries", qrels.select(key.alias("child"), F.col("query_id").alias("parent")).distinct())]
    orphans = cascade(direct, edges)
    made = qrels.groupBy(key.alias("rec_id")).agg(F.min("judged_at").alias("at")).withColumn("rec_table", F.lit("qrels"))
    made = made.unionByName(table(spark, d, "queries").groupBy(F.col("id").alias("rec_id")).agg(F.min("created_at").alias("at")).withColumn("rec_table", F.lit("queries")))
    return orphans.join(made, ["rec_table", "rec_id"]).groupBy("rec_table", month(F.col("at")).alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_records"))


def p5_depths(spark: SparkSession, d: str) -> DataFrame:
    """Records by their distance from a section that is missing or deleted in the end: sections, what refers to them, and judgements of such queries."""
    last = table(spark, d, "sections").filter("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", F.coalesce("deleted", F.lit(False)).alias("gone"))).alias("e"))
    q = table(spark, d, "queries").select(F.col("id").alias("child"), F.explode("retrieval_ids").alias("parent")).filter(F.regexp_replace("parent", r"\s", "") != "").distinct()
    r = table(spark, d, "qrels").select("query_id", "corpus_id").distinct()
    key = F.to_json(F.struct("query_id", "corpus_id"))
    judged = r.filter(F.regexp_replace("corpus_id", r"\s", "") != "").select(key.alias("child"), F.col("corpus_id").alias("parent"))
    asked = q.select("parent").unionByName(judged.select("parent")).distinct()
    dead = asked.join(last.filter("not e.gone").select(F.col("id").alias("parent")), "parent", "left_anti")
    edges = [Edge("queries", "sections", q), Edge("qrels", "sections", judged), Edge("qrels", "queries", r.select(key.alias("child"), F.col("query_id").alias("parent")))]
    return cascade(dead.select(F.lit("sections").alias("rec_table"), F.col("parent").alias("rec_id")), edges).groupBy("rec_table", "depth").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_cascade": p5_cascade, "p5_depths": p5_depths}

_REFS = """
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'queries' AS ref_table, id AS query_id, unnest(retrieval_ids) AS section_id, created_at AS made_at FROM queries
    UNION ALL SELECT 'qrels', query_id, corpus_id, judged_at FROM qrels)
  WHERE section_id IS NOT NULL AND regexp_replace(section_id, '\\s', '', 'g') <> ''),
ev AS (SELECT id, loaded_at, bool_or(coalesce(deleted, false)) AS gone FROM sections GROUP BY ALL),
bad AS (
  SELECT r.* FROM refs r ASOF LEFT JOIN ev e ON r.section_id = e.id AND r.made_at >= e.loaded_at
  WHERE coalesce(e.gone, true))
"""

SQL = {
    "p5_found": f"WITH {_REFS} SELECT DISTINCT ref_table, query_id, section_id FROM bad",
    "p5_report": f"""WITH {_REFS}
      SELECT r.ref_table, strftime(r.made_at, '%Y-%m') AS month, count(*) AS n_refs, count(b.ref_table) AS n_orphans
      FROM refs r LEFT JOIN bad b USING (ref_table, query_id, section_id, made_at) GROUP BY 1, 2""",
    "p5_cascade": f"""WITH {_REFS},
      j AS (SELECT query_id, corpus_id, min(judged_at) AS at_ FROM qrels GROUP BY 1, 2),
      dq AS (SELECT DISTINCT query_id FROM bad WHERE ref_table = 'queries'),
      dj AS (SELECT DISTINCT query_id, section_id FROM bad WHERE ref_table = 'qrels'),
      orphans AS (
        SELECT 'queries' AS rec_table, 'direct' AS kind, q.at_ FROM dq JOIN (SELECT id, min(created_at) AS at_ FROM queries GROUP BY 1) q ON q.id = dq.query_id
        UNION ALL SELECT 'qrels', CASE WHEN dj.query_id IS NOT NULL THEN 'direct' ELSE 'inherited' END, j.at_
        FROM j LEFT JOIN dj ON dj.query_id = j.query_id AND dj.section_id = j.corpus_id
        LEFT JOIN dq ON dq.query_id = j.query_id WHERE dj.query_id IS NOT NULL OR dq.query_id IS NOT NULL)
      SELECT rec_table, strftime(at_, '%Y-%m') AS month, kind, count(*) AS n_records FROM orphans GROUP BY 1, 2, 3""",
    "p5_depths": """WITH q AS (SELECT DISTINCT id, sid FROM (SELECT id, unnest(retrieval_ids) AS sid FROM queries) WHERE regexp_replace(sid, '\\s', '', 'g') <> ''),
      r AS (SELECT DISTINCT query_id, corpus_id FROM qrels), j AS (SELECT * FROM r WHERE regexp_replace(corpus_id, '\\s', '', 'g') <> ''),
      l AS (SELECT id, arg_max(coalesce(deleted, false), (loaded_at, coalesce(deleted, false))) AS gone FROM sections GROUP BY 1),
      dead AS (SELECT DISTINCT sid FROM (SELECT sid FROM q UNION ALL SELECT corpus_id FROM j) WHERE sid NOT IN (SELECT id FROM l WHERE NOT gone AND id IS NOT NULL)),
      dq AS (SELECT DISTINCT id FROM q WHERE sid IN (SELECT sid FROM dead)), dj AS (SELECT * FROM j WHERE corpus_id IN (SELECT sid FROM dead)),
      ij AS (SELECT * FROM r WHERE query_id IN (SELECT id FROM dq) EXCEPT SELECT * FROM dj)
      SELECT 'sections' AS rec_table, 0 AS depth, count(*) AS n_records FROM dead UNION ALL SELECT 'queries', 1, count(*) FROM dq UNION ALL SELECT 'qrels', 1, count(*) FROM dj UNION ALL SELECT 'qrels', 2, count(*) FROM ij""",
}
