"""Harmonisation, chunking, text functions, row weights and stores over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import CollateConfig
from lodestone.functions import scoring, text
from lodestone.operators import chunking, encode, harmonise, sampling
from lodestone.plans.retrieval import r6, vectors
from lodestone.sources import readers
from lodestone.session import table


def live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").filter(~F.coalesce("deleted", F.lit(False)))


# --- scans -----------------------------------------------------------------------------------


def load_split(spark, d):
    return readers.load(spark, f"{d}/queries.parquet", split="val").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


def concat_subsets(spark, d):
    def loader(subset=None, split=None):
        return table(spark, d, "documents").filter(F.lower(F.substring("lang", 1, 2)) == subset)

    return readers.load_subsets(spark, loader, ["de", "fr", "es"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def row_numbers(spark, d):
    return harmonise.numbered(table(spark, d, "documents").select("doc_id"), "doc_id")


def vector_slice(spark, d):
    v = readers.rows_between(vectors(spark, d), 100, 200)
    return v.select("row_idx", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def vector_zip(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"))
    return readers.with_vectors(s, vectors(spark, d), "main").select("row_idx", "shard", F.col("vector").isNotNull().alias("has_vector"))


def vector_validation(spark, d):
    v = vectors(spark, d).select("row_idx", F.when(F.col("row_idx") % 7 == 0, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).when(F.col("row_idx") % 11 == 0, F.lit(None)).otherwise(F.col("vector")).alias("vector"))
    return readers.invalid_vectors(v).select("row_idx")


def dataset_fingerprint(spark, d):
    s = table(spark, d, "qrels").select("query_id", "corpus_id")
    text_ = F.concat_ws("|", "corpus_id", "query_id")
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text_), 1, 8), 16, 10).cast("long")).alias("hash"))


def subset_sample(spark, d):
    """The sampling operator itself: a fixed number of documents by hash."""
    return sampling.subset(table(spark, d, "documents").select("doc_id"), 100, "doc_id", 0)


def shuffled_order(spark, d):
    q = table(spark, d, "documents").select("doc_id")
    return q.select("doc_id", F.md5(F.concat(F.lit("0"), F.col("doc_id").cast("string"))).alias("sort_key"))


# --- harmonisation ---------------------------------------------------------------------------


def t2t_pairs(spark, d):
    q = harmonise.harmonise(table(spark, d, "text_pairs"), "queries")
    return q.select("id", "query", F.size("answers").alias("n_answers"), F.element_at("answers", 1).alias("answer"), F.element_at("answer_scores", 1).alias("score"), F.size("retrieval_ids").alias("n_ids"))


def missing_fields_queries(spark, d):
    q = table(spark, d, "queries").select("id", F.col("query").alias("question"), F.col("answers").alias("labels"))
    return harmonise.harmonise(q, "queries").select("id", "query", "answers", "answer_scores", "retrieval_ids", "subset_ids")


def identity_queries(spark, d):
    return harmonise.harmonise(table(spark, d, "queries").select(*harmonise.QUERY_COLUMNS), "queries").select("id", "query", "answers", "answer_scores")


def rename_sections(spark, d):
    s = live(spark, d).select(F.col("id").alias("_id"), F.col("content").alias("text"), F.col("title").alias("header"), "lang")
    return harmonise.harmonise(s, "sections").select("id", "content", "title", "lang")


def missing_fields_sections(spark, d):
    return harmonise.harmonise(live(spark, d).select(F.col("content").alias("body"), F.col("title").alias("heading")), "sections")


def _exam(spark, d):
    q = table(spark, d, "queries").filter("size(answers) > 1 and answer_scores is not null")
    at = F.array_position("answer_scores", F.array_max("answer_scores")) - 1
    return q.select("id", F.col("query").alias("question"), F.col("answers").alias("options"), at.cast("int").alias("at"))


def mcqa_onehot(spark, d):
    return harmonise.harmonise(_exam(spark, d).withColumnRenamed("at", "answer"), "queries").select("id", "query", "answers", "answer_scores")


def mcqa_letter(spark, d):
    return harmonise.harmonise(_exam(spark, d).withColumn("answer", F.char(F.col("at") + 65)).drop("at"), "queries").select("id", "query", "answers", "answer_scores")


def nested_answers(spark, d):
    q = table(spark, d, "queries").select("id", F.col("query").alias("question"), F.struct(F.col("answers").alias("text"), F.lit(0).alias("start")).alias("answers"))
    return harmonise.harmonise(q, "queries").select("id", "query", "answers", "answer_scores")


def _extractive(spark, d):
    """Each judgement's query with its section as the context."""
    s = live(spark, d).groupBy("id").agg(F.min_by(F.struct("content", "title"), F.struct("loaded_at", "content")).alias("s")).select(F.col("id").alias("corpus_id"), "s.content", "s.title")
    r = table(spark, d, "qrels").select("query_id", "corpus_id").distinct()
    return r.join(s, "corpus_id").select(F.concat_ws("/", "query_id", "corpus_id").alias("id"), F.col("query_id").alias("question"), F.struct(F.array("query_id").alias("text")).alias("answers"), F.col("content").alias("context"), "title")


def isolate_sections(spark, d):
    return harmonise.harmonise(_extractive(spark, d), "sections").select("id", "content", F.coalesce("title", F.lit("")).alias("title"), "subset_id")


def isolate_queries(spark, d):
    return harmonise.harmonise(_extractive(spark, d), "queries").select("id", "query", "answers", "subset_ids")


def reattach_contexts(spark, d):
    q, s = harmonise.isolate(harmonise.find_adapter(x := _extractive(spark, d), "contexts").project(x))
    return harmonise.reattached(q, s).select("id", F.element_at("contexts", 1).alias("content"))


def dedup_keep_first(spark, d):
    return harmonise.keep_first(table(spark, d, "documents").filter("text is not null").select("text", "doc_id", "source"), "text", "doc_id").select("doc_id", "source")


def best_answer(spark, d):
    return table(spark, d, "queries").select("id", "loaded_at", harmonise.best_answer(F.col("answers"), F.col("answer_scores")).alias("answer"))


def relevance_join(spark, d):
    q = table(spark, d, "queries").groupBy("id").agg(F.min_by(F.struct("retrieval_ids", "retrieval_scores"), "loaded_at").alias("r")).select("id", "r.*")
    return harmonise.relevance(q)


def qrels_filter(spark, d):
    p = harmonise.positives(table(spark, d, "qrels"))
    return p.select("query_id", "retrieval_ids", "retrieval_scores")


def missing_links(spark, d):
    """Subsets that queries name and the table of subsets lacks."""
    named = table(spark, d, "queries").select(F.explode("subset_ids").alias("subset_id")).filter("subset_id is not null").groupBy("subset_id").agg(F.count(F.lit(1)).alias("n"))
    return named.join(table(spark, d, "subsets").select("subset_id"), "subset_id", "left_anti")


# --- chunks and text -------------------------------------------------------------------------


def sentence_sections(spark, d):
    return chunking.sentence_chunks(live(spark, d).select("id", "loaded_at", "content")).select("id", "loaded_at", "chunk_no", "content")


def fixed_length_sections(spark, d):
    return chunking.fixed_chunks(live(spark, d).select("id", "loaded_at", "content"), length=50, stride=40).select("id", "loaded_at", "chunk_no", "content")


def render_template(spark, d):
    s = live(spark, d)
    return s.select("id", "loaded_at", text.render(CollateConfig().section_template, s.columns).alias("body"))


def section_hashes(spark, d):
    return live(spark, d).select("id", "loaded_at", text.section_hash(F.col("content"), F.col("title")).alias("hash"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_words"), F.size(text.tokens(F.col("text"), text.STOP_WORDS["en"])).alias("n_kept"))


def highlighted(spark, d):
    return live(spark, d).filter("lang = 'en'").select("id", "loaded_at", text.highlight(F.col("content"), ["the", "museum", "harbour"]).alias("body"))


def text_formats(spark, d):
    t = table(spark, d, "documents")
    known = F.lower(F.substring("lang", 1, 2))
    lang = F.when(known.isin(*text.LANGUAGES), known)
    return t.select("doc_id", text.language_name(lang).alias("language"), text.human_number(F.col("n_chars")).alias("size"), text.camel_to_snake(F.concat(F.lit("DocOf"), F.initcap(F.col("source")))).alias("snake"))


# --- weights, schedules, aggregates ----------------------------------------------------------


def lookup_weights(spark, d):
    w = sampling.sampler(table(spark, d, "events").select("event_id", "event_type"), {"mode": "lookup", "key": "event_type", "weights": {"click": 2.0, "view": 0.5}, "default": 1.0})
    return w.select("event_id", "weight")


def inverse_frequency_weights(spark, d):
    return sampling.sampler(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), {"mode": "inverse_frequency", "key": "o_orderpriority"}).select("o_orderkey", F.round("weight", 12).alias("weight"))


def product_weights(spark, d):
    spec = [{"mode": "inverse_frequency", "key": "o_orderpriority"}, {"mode": "lookup", "key": "o_orderstatus", "weights": {"F": 2.0}, "default": 1.0}]
    return sampling.sampler(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), spec).select("o_orderkey", F.round("weight", 12).alias("weight"))


def schedule_values(spark, d):
    s = table(spark, d, "documents").select("doc_id")
    t = F.col("doc_id")
    return s.select("doc_id", *[r6c(scoring.schedule(k, t, 2.0, 1.0, 300.0, 50.0), k) for k in ("constant", "linear", "step", "exponential")])


def r6c(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def finite_means(spark, d):
    """Means that leave NaN out, with partial and final aggregation."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_type", v.alias("v")).groupBy("event_type").agg(F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 6).alias("mean"), F.count(F.when(~F.isnan("v"), 1)).alias("n"))


def fill_scores(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, d, "events").select("event_id", "user_id", v.alias("v"))
    # The least value is an aggregate joined back: a user's events aren't gathered.
    low = e.groupBy("user_id").agg(F.min(F.when(~F.isnan("v"), F.col("v"))).alias("low"))
    out = e.join(low, "user_id").withColumn("filled", F.when(F.isnan("v") | F.col("v").isNull(), F.coalesce("low", F.lit(0.0)) - 1.0).otherwise(F.col("v")))
    return out.select("event_id", F.round("filled", 6).alias("filled"))


def auto_cells(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_returnflag", scoring.auto_centroids(F.col("n"), 4).alias("cells"))


def pool_mean(spark, d):
    p = encode.pooled(vectors(spark, d), "cell", "mean")
    return p.select("cell", F.posexplode("vector").alias("i", "x")).select("cell", "i", r6("x"))


def best_of_pool(spark, d):
    v = vectors(spark, d).select("row_idx", "cell", F.transform("vector", lambda x: x.cast("double") * (1 + F.col("row_idx") % 5)).alias("vector"))
    return encode.pooled(v, "cell", "max_norm").select("cell", r6c(F.element_at("vector", 1), "first"))


def pool_cls(spark, d):
    return encode.pooled(vectors(spark, d), "cell", "cls").select("cell", r6c(F.element_at("vector", 1).cast("double"), "first"))


def activations(spark, d):
    v = vectors(spark, d)
    cols = [r6c(F.element_at(encode.activated(F.col("vector"), k), 1), k) for k in ("relu", "tanh", "sigmoid", "gelu")]
    return v.select("row_idx", *cols, r6c(F.element_at(encode.normalised(F.col("vector"), "l1"), 1), "l1"))


def hashed_vectors(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return encode.hashed_bag(s, "text", 32).select("row_idx", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def flat_config(spark, d):
    b = table(spark, d, "budgets").select(F.struct("budget_id", F.struct("tokenizer", F.struct("max_tokens").alias("limit")).alias("body")).alias("config"))
    return readers.flatten(b, "__")


def ranked_display(spark, d):
    """Judgements by relevance, then by id, with missing grades one below the least."""
    r = table(spark, d, "qrels")
    low = r.agg(F.min("score").alias("low"))
    return r.crossJoin(F.broadcast(low)).select("query_id", "corpus_id", "judged_at", F.coalesce(F.col("score"), F.col("low") - 1).alias("shown"))


QUERIES = {
    k: globals()[k]
    for k in "load_split concat_subsets row_numbers vector_slice vector_zip vector_validation dataset_fingerprint subset_sample shuffled_order t2t_pairs missing_fields_queries identity_queries rename_sections missing_fields_sections mcqa_onehot mcqa_letter nested_answers isolate_sections isolate_queries reattach_contexts dedup_keep_first best_answer relevance_join qrels_filter missing_links sentence_sections fixed_length_sections render_template section_hashes word_counts highlighted text_formats lookup_weights inverse_frequency_weights product_weights schedule_values finite_means fill_scores auto_cells pool_mean best_of_pool pool_cls activations hashed_vectors flat_config ranked_display".split()
}

_LIVE = "(SELECT * FROM sections WHERE NOT coalesce(deleted, false))"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w <> '')"
_ONES = "list_transform({}, lambda x: 1.0::DOUBLE)"
_EXAM = "(SELECT id, query, answers, list_position(answer_scores, list_max(answer_scores)) AS p FROM queries WHERE len(answers) > 1 AND answer_scores IS NOT NULL)"
_ONEHOT = f"SELECT id, query, answers, list_transform(answers, lambda x, i: CASE WHEN i = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS answer_scores FROM {_EXAM}"
_EXT = f"""x AS (SELECT id, arg_min({{'c': content, 't': title}}, (loaded_at, content)) AS s FROM {_LIVE} GROUP BY 1),
ext AS (SELECT DISTINCT r.query_id || '/' || r.corpus_id AS id, r.query_id AS query, x.s.c AS c, x.s.t AS t FROM qrels r JOIN x ON x.id = r.corpus_id)"""
_H = "md5({c} || coalesce({t}, '')) || '-' || length({c})"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS["en"]) + "]"
_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LANGUAGES.items()) + "}"
_FLAT_V = "(SELECT vec_id AS row_idx, label AS cell, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
SQL = {
    "load_split": "SELECT source_name, count(*) AS n FROM queries WHERE split = 'validation' GROUP BY 1",
    "concat_subsets": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE lower(substr(lang, 1, 2)) IN ('de', 'fr', 'es') GROUP BY 1",
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents",
    "vector_slice": f"SELECT row_idx, round(sum(x), 5) AS total FROM {_FLAT_V} WHERE row_idx >= 100 AND row_idx < 200 GROUP BY 1",
    "vector_zip": "SELECT doc_id AS row_idx, 'main' AS shard, vec_id IS NOT NULL AS has_vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "vector_validation": "SELECT vec_id AS row_idx FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0",
    "dataset_fingerprint": "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(corpus_id || '|' || query_id), 1, 8))::BIGINT)::BIGINT AS hash FROM qrels",
    "subset_sample": "SELECT doc_id FROM documents ORDER BY md5('0' || doc_id::VARCHAR), doc_id LIMIT 100",
    "shuffled_order": "SELECT doc_id, md5('0' || doc_id::VARCHAR) AS sort_key FROM documents",
    "t2t_pairs": "SELECT pair_id AS id, inputs AS query, 1 AS n_answers, targets AS answer, 1.0::DOUBLE AS score, 0 AS n_ids FROM text_pairs",
    "missing_fields_queries": f"SELECT id, query, coalesce(answers, []) AS answers, {_ONES.format('coalesce(answers, [])')} AS answer_scores, []::VARCHAR[] AS retrieval_ids, []::VARCHAR[] AS subset_ids FROM queries",
    "identity_queries": "SELECT id, query, answers, answer_scores FROM queries",
    "rename_sections": f"SELECT id, content, title, lang FROM {_LIVE}",
    "missing_fields_sections": f"SELECT md5(content) AS id, content, title FROM {_LIVE}",
    "mcqa_onehot": _ONEHOT, "mcqa_letter": _ONEHOT,
    "nested_answers": f"SELECT id, query, coalesce(answers, []) AS answers, {_ONES.format('coalesce(answers, [])')} AS answer_scores FROM queries",
    "isolate_sections": f"WITH {_EXT} SELECT {_H.format(c='c', t='t')} AS id, min(c) AS content, min(coalesce(t, '')) AS title, {_H.format(c='c', t='t')} AS subset_id FROM ext WHERE c IS NOT NULL GROUP BY 1",
    "isolate_queries": f"WITH {_EXT} SELECT id, query, [query] AS answers, CASE WHEN c IS NULL THEN [] ELSE [{_H.format(c='c', t='t')}] END AS subset_ids FROM ext",
    "reattach_contexts": f"WITH {_EXT} SELECT id, c AS content FROM ext WHERE c IS NOT NULL",
    "dedup_keep_first": "SELECT doc_id, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "best_answer": "SELECT id, loaded_at, coalesce(answers[coalesce(list_position(answer_scores, list_max(answer_scores)), 1)], '') AS answer FROM queries",
    "relevance_join": """WITH f AS (SELECT id, arg_min(retrieval_ids, loaded_at) AS i, arg_min(retrieval_scores, loaded_at) AS s FROM queries WHERE retrieval_ids IS NOT NULL GROUP BY 1),
        u AS (SELECT id, unnest(i) AS sid, unnest(s) AS rel, generate_subscripts(i, 1) AS p FROM f) SELECT id AS qid, sid AS section_id, arg_max(rel, p) AS relevance FROM u WHERE sid IS NOT NULL GROUP BY 1, 2""",
    "qrels_filter": """WITH f AS (SELECT query_id, corpus_id, min((judged_at, score)) AS m FROM qrels WHERE score > 0 GROUP BY 1, 2)
        SELECT query_id, list(corpus_id ORDER BY m[1], corpus_id) AS retrieval_ids, list(m[2]::DOUBLE ORDER BY m[1], corpus_id) AS retrieval_scores FROM f GROUP BY 1""",
    "missing_links": "SELECT u.s AS subset_id, count(*) AS n FROM queries, unnest(subset_ids) AS u(s) WHERE u.s IS NOT NULL AND u.s NOT IN (SELECT subset_id FROM subsets) GROUP BY 1",
    "sentence_sections": f"SELECT id, loaded_at, (generate_subscripts(p, 1) - 1)::INT AS chunk_no, unnest(p) AS content FROM (SELECT id, loaded_at, string_split(content, '. ') AS p FROM {_LIVE} WHERE content IS NOT NULL)",
    "fixed_length_sections": f"""WITH w AS (SELECT id, loaded_at, list_filter(regexp_split_to_array(coalesce(content, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {_LIVE}), n AS (SELECT *, greatest(0, ceil((len(w) - 50) / 40.0::DOUBLE))::INT AS n FROM w),
        c AS (SELECT id, loaded_at, w, unnest(range(0, n + 1))::INT AS chunk_no FROM n) SELECT id, loaded_at, chunk_no, coalesce(array_to_string(list_slice(w, chunk_no * 40 + 1, chunk_no * 40 + 50), ' '), '') AS content FROM c""",
    "render_template": f"SELECT id, loaded_at, CASE WHEN coalesce(title, '') <> '' THEN title || ': ' ELSE '' END || coalesce(content, '') AS body FROM {_LIVE}",
    "section_hashes": f"SELECT id, loaded_at, {_H.format(c=chr(99) + 'ontent', t='title')} AS hash FROM {_LIVE}",
    "word_counts": f"SELECT doc_id, len({_WORDS})::INT AS n_words, len(list_filter({_WORDS}, lambda w: NOT list_contains({_STOP}, w)))::INT AS n_kept FROM documents",
    "highlighted": f"SELECT id, loaded_at, regexp_replace(content, '(?i)\\b(museum|harbour)\\b', '[\\1]', 'g') AS body FROM {_LIVE} WHERE lang = 'en'",
    "text_formats": f"""SELECT doc_id, {_NAMES}[lower(substr(lang, 1, 2))] AS language, CASE WHEN n_chars >= 1000000 THEN printf('%.1fM', round(n_chars / 1000000.0::DOUBLE, 1)) WHEN n_chars >= 1000 THEN printf('%.1fK', round(n_chars / 1000.0::DOUBLE, 1)) ELSE printf('%.1f', n_chars::DOUBLE) END AS size,
        'doc_of_' || lower(source) AS snake FROM documents""",
    "lookup_weights": "SELECT event_id, CASE event_type WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM events",
    "inverse_frequency_weights": "SELECT o_orderkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority), 12) AS weight FROM orders",
    "product_weights": "SELECT o_orderkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority) * CASE WHEN o_orderstatus = 'F' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 12) AS weight FROM orders",
    "schedule_values": "SELECT doc_id, 2.0::DOUBLE AS constant, round(1.0::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (doc_id - 50) / 300.0::DOUBLE)), 6) AS linear, CASE WHEN doc_id < 300 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS step, round(1.0::DOUBLE + (1 - exp(-greatest(0.0::DOUBLE, (doc_id - 50) / 300.0::DOUBLE))), 6) AS exponential FROM documents",
    "finite_means": "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "fill_scores": "SELECT event_id, round(CASE WHEN event_id % 10 = 0 OR value IS NULL THEN coalesce(min(CASE WHEN event_id % 10 <> 0 THEN value END) OVER (PARTITION BY user_id), 0) - 1 ELSE value END, 6) AS filled FROM events",
    "auto_cells": "SELECT l_returnflag, greatest(4, pow(2, ceil(log2(count(*) / 128.0::DOUBLE)))::BIGINT) AS cells FROM lineitem GROUP BY 1",
    "pool_mean": f"SELECT cell, i::INT AS i, round(avg(x), 6) + 0.0::DOUBLE AS x FROM {_FLAT_V} GROUP BY 1, 2",
    "best_of_pool": "SELECT cell, round(arg_min(f, (-n, r)), 6) + 0.0::DOUBLE AS first FROM (SELECT label AS cell, vec_id AS r, embedding[1]::DOUBLE * (1 + vec_id % 5) AS f, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * (1 + vec_id % 5)) * (x::DOUBLE * (1 + vec_id % 5)))), 9) AS n FROM embeddings) GROUP BY 1",
    "pool_cls": "SELECT label AS cell, round(arg_min(embedding[1]::DOUBLE, vec_id), 6) + 0.0::DOUBLE AS first FROM embeddings GROUP BY 1",
    "activations": "SELECT vec_id AS row_idx, round(greatest(x, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS relu, round(tanh(x), 6) + 0.0::DOUBLE AS tanh, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(0.5::DOUBLE * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x))), 6) + 0.0::DOUBLE AS gelu, round(x / s, 6) + 0.0::DOUBLE AS l1 FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, list_sum(list_transform(embedding, lambda e: abs(e::DOUBLE))) AS s FROM embeddings)",
    "hashed_vectors": f"SELECT doc_id AS row_idx, CASE WHEN len({_WORDS}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "flat_config": "SELECT budget_id AS config__budget_id, tokenizer AS config__body__tokenizer, max_tokens AS config__body__limit__max_tokens FROM budgets",
    "ranked_display": "SELECT query_id, corpus_id, judged_at, coalesce(score, (SELECT min(score) FROM qrels) - 1) AS shown FROM qrels",
}
