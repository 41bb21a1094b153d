"""Heterogeneous question sets to the canonical tables: adapters chosen by the schema, each one ``select``.

A query is ``id, query, answers, answer_scores, retrieval_ids, retrieval_scores, subset_ids``; a
section ``id, content, title, subset_id``. An adapter matches on column names and types, so that
a set that can't be handled fails when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import NoAdapterError
from lodestone.functions.text import section_hash

# Names under which sets carry a field, in the order of preference; behind them, names that are known besides.
ALIASES: dict[str, tuple[str, ...]] = {
    "query_id": ("id", "uid", "question_id", "query_id", "qid", "_id", "example_id"),
    "section_id": ("_id", "id", "uid", "section_id", "context_id", "passage_id", "document.idx", "doc_id", "pid", "document_id"),
    "query": ("text", "query", "question", "prompt", "input", "inputs"),
    "content": ("text", "passage", "context", "section", "content", "article", "document.text", "body", "contents"),
    "title": ("title", "heading", "header", "document.title", "titles", "name"),
    "contexts": ("contexts", "context", "passages", "passage", "sections", "section", "contents", "content", "articles", "article"),
    "titles": ("titles", "title", "heading", "header", "document.title"),
    "answers": ("answer", "answers", "response", "labels", "aliases"),
    "answer_scores": ("answer_scores", "scores"),
    "choices": ("choices", "options", "candidates", "endings"),
    "choice": ("answer", "answer_idx", "answer_index", "label", "correct", "cop"),
    "inputs": ("inputs", "prompt", "question", "query", "input", "source"),
    "targets": ("targets", "answer", "response", "completion", "target", "output"),
}
QUERY_COLUMNS = ("id", "query", "answers", "answer_scores", "retrieval_ids", "retrieval_scores", "subset_ids")
STRINGS, DOUBLES = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())


def resolve(df: DataFrame, field: str) -> str | None:
    """The first alias of a field that is a column; names with dots are names, not paths."""
    return next((a for a in ALIASES[field] if a in df.columns), None)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _listed(df: DataFrame, name: str) -> Column:
    """A string as a list of one; a list as it is; a struct by its text or aliases."""
    kind = _type(df, name)
    if isinstance(kind, T.ArrayType):
        return _c(name)
    if isinstance(kind, T.StructType):
        inner = next(n for n in ("text", "aliases") if n in kind.names)
        return _c(name).getField(inner)
    return F.when(_c(name).isNotNull(), F.array(_c(name).cast("string")))


def _none(kind: T.DataType) -> Column:
    return F.array().cast(kind)


def _query(df: DataFrame, ident: Column, query: Column, answers: Column, scores: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    a = F.coalesce(answers.cast(STRINGS), _none(STRINGS))
    r = F.coalesce(_c("retrieval_ids").cast(STRINGS), _none(STRINGS)) if "retrieval_ids" in df.columns else _none(STRINGS)
    rs = _c("retrieval_scores").cast(DOUBLES) if "retrieval_scores" in df.columns else F.lit(None).cast(DOUBLES)
    s = F.coalesce(_c("subset_ids").cast(STRINGS), _none(STRINGS)) if "subset_ids" in df.columns else _none(STRINGS)
    ones = lambda x: F.transform(x, lambda _: F.lit(1.0))
    return df.select(
        ident.cast("string").alias("id"), query.alias("query"), a.alias("answers"), (F.coalesce(scores.cast(DOUBLES), ones(a)) if scores is not None else ones(a)).alias("answer_scores"),
        r.alias("retrieval_ids"), F.coalesce(rs, ones(r)).alias("retrieval_scores"), s.alias("subset_ids"), *extra,
    )


def _ident(df: DataFrame, field: str, *fallback: Column) -> Column:
    """The id; where a set has none, the md5 of what the record says, the same on every run."""
    name = resolve(df, field)
    made = F.md5(F.concat_ws("\u0001", *fallback))
    return F.coalesce(_c(name).cast("string"), made) if name else made


@dataclass(frozen=True)
class Adapter:
    name: str
    output: str
    matches: Callable[[DataFrame], bool]
    project: Callable[[DataFrame], DataFrame]


def _is(df: DataFrame, field: str, *kinds: type) -> bool:
    name = resolve(df, field)
    return name is not None and isinstance(_type(df, name), kinds)


def _one_hot(df: DataFrame) -> tuple[Column, Column]:
    choices, choice = resolve(df, "choices"), resolve(df, "choice")
    at = F.ascii(F.upper(F.trim(_c(choice)))) - F.lit(65) if isinstance(_type(df, choice), T.StringType) else _c(choice).cast("int")
    return _c(choices), F.transform(_c(choices), lambda x, i: F.when(i == at, 1.0).otherwise(0.0))


def _choices(df: DataFrame) -> bool:
    return _is(df, "query", T.StringType) and _is(df, "choices", T.ArrayType) and resolve(df, "choice") is not None and not isinstance(_type(df, resolve(df, "choice")), (T.ArrayType, T.StructType))


def _contexts(df: DataFrame) -> list[Column]:
    name, title = resolve(df, "contexts"), resolve(df, "titles")
    contexts = F.coalesce(_listed(df, name), _none(STRINGS))
    titles = F.coalesce(_listed(df, title), _none(STRINGS)) if title else F.lit(None).cast(STRINGS)
    return [contexts.alias("contexts"), titles.alias("titles")]


def _with_context(df: DataFrame) -> bool:
    return resolve(df, "contexts") is not None


def _mc(df: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    choices, scores = _one_hot(df)
    q = _c(resolve(df, "query"))
    return _query(df, _ident(df, "query_id", q, F.to_json(choices)), q, choices, scores, extra)


def _extractive(df: DataFrame) -> bool:
    return _is(df, "query", T.StringType) and _is(df, "answers", T.StructType)


def _answered(df: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    q = _c(resolve(df, "query"))
    name = resolve(df, "answers")
    answers = _listed(df, name) if name else _none(STRINGS)
    scores = resolve(df, "answer_scores")
    return _query(df, _ident(df, "query_id", q), q, answers, _c(scores) if scores else None, extra)


def _pages(df: DataFrame) -> bool:
    return "entity_pages" in df.columns and isinstance(_type(df, "entity_pages"), T.StructType)


def _t2t(df: DataFrame) -> bool:
    return _is(df, "inputs", T.StringType) and _is(df, "targets", T.StringType)


def _text_to_text(df: DataFrame) -> DataFrame:
    q, t = _c(resolve(df, "inputs")), _c(resolve(df, "targets"))
    ident = _c("pair_id") if "pair_id" in df.columns else _ident(df, "query_id", q, t)
    return _query(df, ident, q, F.array(t))


def _identity_query(df: DataFrame) -> bool:
    return set(QUERY_COLUMNS) <= set(df.columns)


def _renamed(df: DataFrame) -> DataFrame:
    names = {resolve(df, f): o for f, o in (("section_id", "id"), ("content", "content"), ("title", "title")) if resolve(df, f)}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k != v and v not in df.columns})


def _missing_section(df: DataFrame) -> DataFrame:
    content, title = _c(resolve(df, "content")), resolve(df, "title")
    return df.select(_ident(df, "section_id", content).alias("id"), content.alias("content"), (_c(title) if title else F.lit(None).cast("string")).alias("title"))


ADAPTERS: tuple[Adapter, ...] = (
    # with contexts, tried first
    Adapter("identity", "contexts", lambda d: _identity_query(d) and _is(d, "contexts", T.ArrayType) and "contexts" in d.columns, lambda d: d),
    Adapter("pages", "contexts", lambda d: _pages(d) and _is(d, "query", T.StringType), lambda d: _answered(d, [F.col("entity_pages.wiki_context").alias("contexts"), F.col("entity_pages.title").alias("titles")])),
    Adapter("choices", "contexts", lambda d: _choices(d) and _with_context(d), lambda d: _mc(d, _contexts(d))),
    Adapter("extractive", "contexts", lambda d: _extractive(d) and _with_context(d), lambda d: _answered(d, _contexts(d))),
    # queries
    Adapter("identity", "queries", _identity_query, lambda d: d),
    Adapter("choices", "queries", _choices, _mc),
    Adapter("extractive", "queries", _extractive, _answered),
    Adapter("text_to_text", "queries", _t2t, _text_to_text),
    Adapter("missing_fields", "queries", lambda d: _is(d, "query", T.StringType), _answered),
    # sections
    Adapter("identity", "sections", lambda d: {"id", "content", "title"} <= set(d.columns), lambda d: d),
    Adapter("rename", "sections", lambda d: resolve(d, "section_id") is not None and resolve(d, "content") is not None, _renamed),
    Adapter("missing_fields", "sections", lambda d: resolve(d, "content") is not None, _missing_section),
)


def find_adapter(df: DataFrame, output: str) -> Adapter | None:
    return next((a for a in ADAPTERS if a.output == output and a.matches(df)), None)


def harmonise(df: DataFrame, output: str) -> DataFrame:
    """``df`` as ``queries`` or ``sections``: by an adapter with contexts, whose two sides are split, or a direct one."""
    if output not in ("queries", "sections"):
        raise ValueError(f"unknown output {output}")
    direct = find_adapter(df, output)
    if direct is not None and direct.name == "identity":
        return direct.project(df)
    a = find_adapter(df, "contexts")
    if a is not None:
        queries, sections = isolate(a.project(df))
        return queries if output == "queries" else sections
    if direct is None:
        raise NoAdapterError(f"no adapter makes {output} of columns {df.columns}")
    return direct.project(df)


def _hashed(df: DataFrame) -> Column:
    titles = F.coalesce(F.col("titles"), _none(STRINGS))
    pairs = F.arrays_zip(F.coalesce("contexts", _none(STRINGS)).alias("c"), titles.alias("t"))
    return F.transform(F.filter(pairs, lambda p: p["c"].isNotNull()), lambda p: F.struct(section_hash(p["c"], p["t"]).alias("id"), p["c"].alias("content"), p["t"].alias("title")))


def isolate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with contexts as queries, whose ``subset_ids`` name their sections, and the distinct sections."""
    d = df.withColumn("_s", _hashed(df))
    queries = d.withColumn("subset_ids", F.transform("_s", lambda s: s["id"])).drop("_s", "contexts", "titles")
    sections = d.select(F.explode("_s").alias("s")).select("s.id", "s.content", "s.title").groupBy("id").agg(F.first("content").alias("content"), F.first("title").alias("title"))
    return queries, sections.select("id", "content", "title", F.col("id").alias("subset_id"))


def reattached(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """Contexts and titles back to the queries, in the order of ``subset_ids``."""
    flat = queries.select("id", F.posexplode("subset_ids").alias("pos", "subset_id"))
    joined = flat.join(sections.select("subset_id", "content", "title"), "subset_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "title"))).alias("s"))
    return joined.select("id", F.transform("s", lambda s: s["content"]).alias("contexts"), F.transform("s", lambda s: s["title"]).alias("titles"))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; a null key raises."""
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null in {key}")).cast(df.schema[key].dataType)).otherwise(F.col(key))
    # The first by an aggregation with map-side combination: no window gathers a hot key.
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.withColumn(key, checked).groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in df.columns])


def checked_queries(df: DataFrame) -> DataFrame:
    """Raises, when rows are computed, where parallel lists differ in length."""
    same = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.size(a) == F.size(b))
    ok = same("answers", "answer_scores") & same("retrieval_ids", "retrieval_scores")
    return df.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("lists of different length in query "), "id")).cast("string")))


def best_answer(answers: Column, scores: Column) -> Column:
    """The answer with the highest score, the first of equals; empty where there is none."""
    top = F.array_position(scores, F.array_max(scores))
    found = F.try_element_at(answers, F.when(F.array_max(scores).isNull(), F.lit(1)).otherwise(top).cast("int"))
    return F.coalesce(F.when(F.size(answers) > 0, found), F.lit(""))


def relevance(queries: DataFrame) -> DataFrame:
    """``(qid, section_id, relevance)`` of the retrieval lists; of a repeated id the last counts."""
    z = queries.select(F.col("id").alias("qid"), F.posexplode(F.arrays_zip("retrieval_ids", "retrieval_scores")).alias("pos", "z")).filter("z.retrieval_ids is not null")
    return z.groupBy("qid", F.col("z.retrieval_ids").alias("section_id")).agg(F.max_by("z.retrieval_scores", "pos").alias("relevance"))


def positives(qrels: DataFrame) -> DataFrame:
    """``(query_id, retrieval_ids, retrieval_scores)`` of judgements with a positive grade.

    Of a pair judged more than once with a positive grade the first judgement counts; equal
    moments by the grade. Lists are in the order of judgement, then id.
    """
    first = qrels.filter("score > 0").groupBy("query_id", "corpus_id").agg(F.min(F.struct("judged_at", "score")).alias("f"))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("f.judged_at", "corpus_id", "f.score"))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda x: x["corpus_id"]).alias("retrieval_ids"), F.transform("l", lambda x: x["score"].cast("double")).alias("retrieval_scores"))


class QrelsSet:
    """Queries, qrels and corpus in one folder: ``queries.jsonl``, ``corpus.jsonl``, ``qrels/<split>.tsv``."""

    def __init__(self, spark, path: str) -> None:
        from lodestone.sources.readers import read_json_lines, read_tsv

        self.queries = read_json_lines(spark, f"{path}/queries.jsonl", "_id string, text string")
        self.corpus = read_json_lines(spark, f"{path}/corpus.jsonl", "_id string, title string, text string")
        self._tsv = lambda split: read_tsv(spark, f"{path}/qrels/{split or '*'}.tsv", {"query-id": "query_id", "corpus-id": "corpus_id", "score": "score"})

    def qrels(self, split: str | None) -> DataFrame:
        """The judgements of a split, of all splits where it is null."""
        return self._tsv(split).withColumn("score", F.col("score").cast("int")).withColumn("judged_at", F.lit(None).cast("timestamp"))

    def load_queries(self, split: str) -> DataFrame:
        """Queries with a positive judgement, with their gold ids."""
        got = self.queries.join(positives(self.qrels(split)), self.queries["_id"] == F.col("query_id"))
        return _query(got, F.col("_id"), F.col("text"), _none(STRINGS))

    def load_sections(self) -> DataFrame:
        return self.corpus.select(F.col("_id").alias("id"), F.col("text").alias("content"), "title", F.lit(None).cast("string").alias("subset_id"))


def numbered(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """Dense numbers from 0 in the order of a unique column, without gathering the rows in one task.

    Rows are range-partitioned and sorted; the sizes of the partitions, one number each, give the
    offsets. An existing column of the name raises.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    from lodestone.session import materialize

    parts = materialize(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn("_r", rank).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_p", "_r", "_o")
