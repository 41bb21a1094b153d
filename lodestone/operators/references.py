"""References to records that do not exist: point-in-time check and fixpoint cascade."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize


def unresolved(refs: DataFrame, events: DataFrame, key: str = "section_id", at: str = "made_at", period: str = "day") -> DataFrame:
    """The rows of ``refs`` whose key has no living record at their moment.

    ``refs`` has ``key`` and ``at``; ``events`` has ``id``, ``loaded_at`` and ``deleted``. A
    reference resolves if the last event of exactly this id that is not after ``at`` exists
    and isn't a deletion. A null ``deleted`` means not deleted; of events of one id at one
    moment a deletion counts as the last. A reference with a null ``at`` has no moment and
    doesn't resolve; one with a null or blank key is no reference and is left out.

    An as-of join on (id, period): rows meet per id *and* day, so that a hot id is spread over
    many keys, and the state that a day inherits comes from a table with one row per id and
    day, made with map-side aggregation.
    """
    bucket = lambda c: F.date_trunc(period, F.col(c))
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    refs = refs.filter(F.col(key).isNotNull() & (F.trim(F.regexp_replace(F.col(key), r"\s", "")) != ""))
    # Repeated events of one id at one moment are one event; deletions win.
    ev = (
        events.filter(F.col("id").isNotNull() & F.col("loaded_at").isNotNull())
        .groupBy(F.col("id").alias("_k"), F.col("loaded_at").alias("_t"))
        .agg(F.max(gone).alias("_gone"))
        .withColumn("_d", bucket("_t"))
    )
    cols = [F.col(c) for c in refs.columns]
    rf = refs.select(F.col(key).alias("_k"), F.col(at).alias("_t"), bucket(at).alias("_d"), F.struct(*cols).alias("_row"))
    both = ev.select("_k", "_t", "_d", "_gone", F.lit(0).alias("_kind"), F.lit(None).cast(rf.schema["_row"].dataType).alias("_row")).unionByName(
        rf.select("_k", "_t", "_d", F.lit(None).cast("boolean").alias("_gone"), F.lit(1).alias("_kind"), "_row")
    )
    # One row per id and day: the state at the day's end; null where the day has references only.
    days = both.groupBy("_k", "_d").agg(F.max_by("_gone", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_k", "_d", F.last("_end", ignorenulls=True).over(before).alias("_was")).filter(F.col("_was").isNotNull())
    within = Window.partitionBy("_k", "_d").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    state = both.withColumn("_now", F.last("_gone", ignorenulls=True).over(within)).filter("_kind = 1")
    joined = state.join(carried, (state["_k"] == carried["_k"]) & state["_d"].eqNullSafe(carried["_d"]), "left")
    seen = F.coalesce(state["_now"], carried["_was"])
    return joined.filter(seen.isNull() | seen | state["_t"].isNull()).select("_row.*")


@dataclass(frozen=True)
class Edge:
    """Foreign key: ``refs`` has columns ``child`` (id in table ``source``) and ``parent`` (id in table ``target``)."""

    source: str
    target: str
    refs: DataFrame


def cascade(direct: DataFrame, edges: Sequence[Edge], most: int = 50) -> DataFrame:
    """Fixpoint of orphanhood down the foreign-key graph.

    ``direct`` has ``(rec_table, rec_id)`` of records with an unresolvable reference. A record
    that refers to an orphaned record is an inherited orphan, and so on. Each round
    semi-joins every edge with the records found in the round before only (semi-naive), and
    ends when a round finds nothing new; as a record is new once, cycles end too. Returns
    ``(rec_table, rec_id, kind, depth)`` with kind ``direct`` or ``inherited``; null ids are
    never orphans.
    """
    found = direct.filter("rec_table is not null and rec_id is not null").select("rec_table", "rec_id").distinct().withColumn("depth", F.lit(0))
    found = materialize(found, "orphans")
    new = found
    for depth in range(1, most + 1):
        steps = []
        for e in edges:
            hit = new.filter(F.col("rec_table") == e.target).select(F.col("rec_id").alias("parent"))
            steps.append(e.refs.join(hit, "parent", "left_semi").select(F.lit(e.source).alias("rec_table"), F.col("child").alias("rec_id")))
        if not steps:
            break
        step = steps[0]
        for s in steps[1:]:
            step = step.unionByName(s)
        step = step.filter("rec_id is not null").distinct().join(found, ["rec_table", "rec_id"], "left_anti").withColumn("depth", F.lit(depth))
        new = materialize(step, "orphans")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    else:
        raise RuntimeError(f"no fixpoint within {most} rounds: the foreign-key chain is longer")
    kind = F.when(F.col("depth") == 0, "direct").otherwise("inherited")
    return found.select("rec_table", "rec_id", kind.alias("kind"), "depth")


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
