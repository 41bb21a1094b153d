"""Search, fusion, sampling, metrics and losses over ``documents`` and ``embeddings``, with their SQL.

The stated query set is every document, and every vector, whose id is divisible by 50, against all.
Sections are the documents (``doc_id`` as row number, ``lang`` as shard, ``subset_id``), and their
vectors the embeddings of the same id. Relevance is 2 for a document of equal text, else 1 for one of
the same subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import assemble, dense, fusion, losses, metrics, sampling
from lodestone.operators.lexical import LexicalIndex, top
from lodestone.session import materialize, shared_dir, table
from lodestone.sources import readers

EVERY = 50
WEIGHTS = {"sparse": 0.1, "dense": 1.0}
DEPTH = 30


def r6(c: str):
    """Rounded, with -0 as 0."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def sections(spark: SparkSession, d: str) -> DataFrame:
    shard = F.lower(F.substring(F.coalesce("lang", F.lit("und")), 1, 2))
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("section_id"), F.col("text").alias("body"), shard.alias("shard"), "subset_id")


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d).filter(F.col("row_idx") % EVERY == 0)
    subsets = F.when(F.col("subset_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("subset_id"))
    return s.select(F.col("row_idx").alias("qid"), F.col("body").alias("text"), subsets.alias("subset_ids"), "shard", "subset_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector"), F.col("label").alias("cell"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter(F.col("row_idx") % EVERY == 0).select(F.col("row_idx").alias("qid"), "vector", F.col("cell"))


def index(spark, d):
    """The lexical index of the documents, built once for the state that the files are in."""
    source = readers.source_key(spark, f"{d}/documents.parquet")
    return LexicalIndex.build(sections(spark, d), folder=f"{shared_dir(spark)}/indexes", key={"source": source, "body": "text"})


def sparse_hits(spark, d, k=DEPTH):
    return index(spark, d).search(text_queries(spark, d).select("qid", "text"), k)


def dense_hits(spark, d, k=DEPTH):
    return dense.search(vector_queries(spark, d), vectors(spark, d), k)


def gold(spark, d, hits):
    """``(qid, row_idx, relevance)`` of the candidates ``hits(qid, row_idx)`` that are relevant: the work follows the candidates."""
    digest = lambda c: F.md5(F.col(c)).alias("digest")
    s = sections(spark, d).select("row_idx", "subset_id", digest("body"))
    q = text_queries(spark, d).select("qid", F.col("subset_id").alias("asked"), digest("text").alias("same"))
    both = hits.select("qid", "row_idx").distinct().join(s, "row_idx").join(q, "qid")
    relevance = F.when(F.col("digest") == F.col("same"), 2).when(F.col("subset_id") == F.col("asked"), 1)
    return both.select("qid", "row_idx", relevance.alias("relevance")).filter("relevance is not null")


def by_id(spark, d):
    """For lookups alone, which read no postings."""
    return LexicalIndex(None, None, sections(spark, d).drop("body"))


def lookups(spark, d):
    q = text_queries(spark, d).select("qid", F.array(F.col("qid").cast("string")).alias("section_ids"))
    return by_id(spark, d).lookup(q)


def engines(spark, d):
    # Judgements and samples read the hits again: the search runs once.
    return {"sparse": materialize(sparse_hits(spark, d), "sparse"), "dense": dense_hits(spark, d), "lookup": lookups(spark, d)}


def merged(spark, d):
    return fusion.merge(fusion.fan_in(engines(spark, d)), WEIGHTS, ["sparse", "dense"])


def judged(spark, d):
    m = merged(spark, d)
    return assemble.with_relevance(m, gold(spark, d, m))


# --- queries ---------------------------------------------------------------------------------


def bm25_topk(spark, d):
    return sparse_hits(spark, d, 10).select("qid", "row_idx", r6("score"))


def bm25_subset_topk(spark, d):
    return index(spark, d).search(text_queries(spark, d).select("qid", "text", "subset_ids"), 10).select("qid", "row_idx", r6("score"))


def bm25_no_match_filter(spark, d):
    q = text_queries(spark, d).select("qid", F.lit("zzzzqq").alias("text"), "subset_ids")
    return index(spark, d).search(q, 10).select("qid", "row_idx", r6("score"))


def gold_lookup(spark, d):
    return lookups(spark, d).select("qid", "row_idx", "score", "label")


def gold_lookup_empty(spark, d):
    q = text_queries(spark, d).select("qid", F.when(F.col("qid") % 100 == 0, F.array().cast("array<string>")).alias("section_ids"))
    return by_id(spark, d).lookup(q).select("qid", "row_idx", "score", "label")


def _dense(metric):
    def query(spark, d):
        q, v = vector_queries(spark, d), vectors(spark, d)
        if metric == "js":
            q, v = (x.withColumn("vector", dense.softmaxed(F.col("vector"))) for x in (q, v))
        return dense.search(q, v, 10, metric).select("qid", "row_idx", r6("score"))

    return query


def dense_filtered_all(spark, d):
    """Hits whose subset equals every subset of the query."""
    s = sections(spark, d).select("row_idx", "subset_id")
    v = vectors(spark, d).join(s, "row_idx")
    q = vector_queries(spark, d).join(s.withColumnRenamed("row_idx", "qid"), "qid").filter("subset_id is not null")
    return dense.search(q, v, 10, shard="subset_id").select("qid", "row_idx", r6("score"))


def shard_offsets(spark, d):
    return fusion.offsets(sections(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("n")))


def sharded_topk(spark, d):
    """Queries meet the vectors of their shard; rows are numbered within a shard and shifted by its offset."""
    s = sections(spark, d).select("row_idx", "shard")
    # Numbers within a shard: counts of the shard's rows before, by blocks of ids, so that a hot shard isn't ranked by one task.
    block = F.expr("row_idx div 256")
    n = s.groupBy("shard", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = n.select("shard", "block", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    local = s.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy("shard", "block").orderBy("row_idx")) - 1).join(before, ["shard", "block"])
    local = local.select("row_idx", "shard", (F.col("r") + F.col("o")).alias("local_idx"))
    v = vectors(spark, d).join(local, "row_idx").select(F.col("local_idx").alias("row_idx"), "vector", "shard")
    q = vector_queries(spark, d).join(s.withColumnRenamed("row_idx", "qid"), "qid")
    hits = dense.search(q, v, 10, shard="shard").join(q.select("qid", "shard"), "qid")
    return fusion.globalised(hits, shard_offsets(spark, d)).select("qid", "shard", "row_idx", r6("score"))


def min_subtract(spark, d):
    return fusion.normalised(fusion.fan_in({"sparse": sparse_hits(spark, d), "dense": dense_hits(spark, d)})).select("qid", "engine", "row_idx", r6("score"))


def weighted_merge(spark, d):
    return merged(spark, d).select("qid", "row_idx", r6("score"))


def merge_raw_scores(spark, d):
    return merged(spark, d).select("qid", "row_idx", r6("sparse"), r6("dense"), "label")


def hybrid_topk(spark, d):
    return fusion.hybrid(engines(spark, d), WEIGHTS, 10).select("qid", "row_idx", r6("score"))


def cell_probe_topk(spark, d):
    v = vectors(spark, d)
    return dense.probe(vector_queries(spark, d), v, dense.centroids(v), 3, 10).select("qid", "row_idx", r6("score"))


def cell_probe_all(spark, d):
    v = vectors(spark, d)
    cells = dense.centroids(v)
    return dense.probe(vector_queries(spark, d), v, cells, 10**6, 10).select("qid", "row_idx", r6("score"))


def kmeans_cells_topk(spark, d):
    v, cells = dense.train_cells(vectors(spark, d).drop("cell"), 8)
    return dense.probe(vector_queries(spark, d), v, cells, 6, 10).select("qid", "row_idx", r6("score"))


def int8_topk(spark, d):
    v, q = vectors(spark, d), vector_queries(spark, d)
    scale = F.lit(0.5)
    coded = lambda x: x.withColumn("vector", dense.quantised(F.col("vector"), scale))
    return dense.search(coded(q), coded(v), 10).select("qid", "row_idx", r6("score"))


def product_quantised_topk(spark, d):
    v = vectors(spark, d).select("row_idx", "vector")
    codes, books = dense.product_codes(v, 16, 8)
    q = vector_queries(spark, d)
    # The rank that codes give a near vector grows with the table, and so does the shortlist.
    shortlist = max(100, -(-v.count() // 100))
    return dense.reranked(q, v, dense.search_codes(q, codes, books, shortlist), 10).select("qid", "row_idx", r6("score"))


def priority_sample(spark, d):
    return sampling.priority_sample(dense_hits(spark, d), 8, 1.0, 7).select("qid", "row_idx", r6("log_p"), r6("log_weight"))


def _labelled(spark, d):
    return judged(spark, d).select("qid", "row_idx", "score", (F.col("relevance") > 0).cast("int").alias("label"))


def labeled_priority_sample(spark, d):
    return sampling.labeled_priority_sample(_labelled(spark, d), 10, 3, 1.0, 7).select("qid", "row_idx", "positive", r6("log_p"), r6("lse"), r6("log_weight"), "max_sampling_id")


def deterministic_sample(spark, d):
    return sampling.labeled_priority_sample(_labelled(spark, d), 10, 3, 0.0).select("qid", "row_idx", "positive", r6("log_weight"), "max_sampling_id")


def truncated_sample(spark, d):
    return sampling.priority_sample(dense_hits(spark, d), 8, 1.0, 7, support=15).select("qid", "row_idx", r6("log_p"), r6("log_weight"))


def in_batch_negatives(spark, d):
    s = sampling.labeled_priority_sample(_labelled(spark, d), 5, 2, 0.0).withColumn("label", F.col("positive").cast("int")).withColumn("batch_id", F.expr("qid div 200"))
    return sampling.in_batch_negatives(s.select("batch_id", "qid", "row_idx", "score", "label")).select("batch_id", "qid", "row_idx", r6("score"), "label")


def batch_sections(spark, d):
    found = engines(spark, d)
    s = assemble.samples(found, gold(spark, d, fusion.fan_in(found)), WEIGHTS, 5, 2)
    rows = assemble.batch_rows(text_queries(spark, d).select("qid"), s, sections(spark, d), ("section_id",))
    return rows.select("qid", F.posexplode("sections").alias("pos", "s")).select("qid", "pos", "s.section_id", (F.round("s.score", 6) + F.lit(0.0)).alias("score"), "s.label", "s.relevance")


NAMES = ("mrr_10", "hitrate_3", "precision_10", "recall_10", "min_10", "max_10", "ndcg_10", "kldiv", "entropy")


def _metric(name):
    def query(spark, d):
        return metrics.per_query(judged(spark, d).select("qid", "row_idx", "score", "relevance"), [name]).select("qid", r6(name))

    return query


def metric_summary(spark, d):
    """Flagship: means of the metrics for the merged, sparse and dense scores of hybrid retrieval."""
    return metrics.summary(judged(spark, d), ["mrr_10", "hitrate_3", "recall_10", "ndcg_10"], ["score", "sparse", "dense"]).select("score_key", "metric", r6("value"), "n_queries")


def _loss(f):
    def query(spark, d):
        return f(judged(spark, d)).select("qid", r6("loss"))

    return query


def marginal_likelihood(spark, d):
    return losses.marginal_likelihood(judged(spark, d).withColumn("logp_x_z", -F.col("row_idx") / F.lit(1000.0))).select("qid", r6("loss"))


def kld_diagnostics(spark, d):
    j = judged(spark, d)
    a = losses.divergence(j, "sparse").withColumnRenamed("loss", "kld_sparse")
    return a.join(losses.divergence(j, "dense").withColumnRenamed("loss", "kld_dense"), "qid", "full").select("qid", r6("kld_sparse"), r6("kld_dense"))


def score_softmax(spark, d):
    h = dense_hits(spark, d)
    return h.select("qid", "row_idx", (F.round(scoring.log_softmax(F.col("score"), "qid"), 6) + F.lit(0.0)).alias("log_p"), F.round(scoring.log_sum_exp(F.col("score"), "qid"), 6).alias("lse"))


QUERIES = {
    "bm25_topk": bm25_topk, "bm25_subset_topk": bm25_subset_topk, "bm25_no_match_filter": bm25_no_match_filter, "gold_lookup": gold_lookup, "gold_lookup_empty": gold_lookup_empty,
    **{f"dense_topk_{n}": _dense(m) for n, m in (("ip", "inner_product"), ("l2", "l2"), ("l1", "l1"), ("linf", "linf"), ("js", "js"))},
    "dense_filtered_all": dense_filtered_all, "shard_offsets": shard_offsets, "sharded_topk": sharded_topk, "min_subtract": min_subtract, "weighted_merge": weighted_merge, "merge_raw_scores": merge_raw_scores,
    "hybrid_topk": hybrid_topk, "cell_probe_topk": cell_probe_topk, "cell_probe_all": cell_probe_all, "kmeans_cells_topk": kmeans_cells_topk, "int8_topk": int8_topk, "product_quantised_topk": product_quantised_topk,
    "priority_sample": priority_sample, "labeled_priority_sample": labeled_priority_sample, "deterministic_sample": deterministic_sample, "truncated_sample": truncated_sample, "in_batch_negatives": in_batch_negatives, "batch_sections": batch_sections,
    **{f"metric_{n}": _metric(n) for n in NAMES}, "metric_summary": metric_summary,
    "loss_retrieval": _loss(losses.retrieval), "loss_guidance": _loss(losses.guidance), "loss_self_supervision": _loss(losses.self_supervision), "loss_score_decay": _loss(losses.score_decay),
    "loss_combined": _loss(lambda j: losses.combined(j, {"retrieval": 1.0, "guidance": 0.5, "self_supervision": 0.25, "score_decay": 0.1})), "loss_marginal_likelihood": marginal_likelihood, "kld_diagnostics": kld_diagnostics, "score_softmax": score_softmax,
}

# --- SQL -------------------------------------------------------------------------------------

_S = """s AS (SELECT doc_id AS row_idx, lower(coalesce(substr(lang, 1, 2), 'un')) AS shard, subset_id, text FROM documents)"""
_LEX = f"""{_S},
tf AS (SELECT row_idx, term, count(*) AS tf FROM (SELECT row_idx, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda t: t <> '')) AS term FROM s) GROUP BY 1, 2),
dl AS (SELECT row_idx, sum(tf)::DOUBLE AS dl FROM tf GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
bm AS (SELECT q.row_idx AS qid, p.row_idx, sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
  FROM tf q JOIN tf p USING (term) JOIN df USING (term) JOIN dl ON dl.row_idx = p.row_idx, st WHERE q.row_idx % {EVERY} = 0 GROUP BY 1, 2)"""


def _top(src: str, k: int, by: str = "qid") -> str:
    return f"(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, row_idx) <= {k})"


_VEC = f"v AS (SELECT vec_id AS row_idx, embedding::DOUBLE[] AS x, label AS cell FROM embeddings), vq AS (SELECT row_idx AS qid, x AS q, cell AS qcell FROM v WHERE row_idx % {EVERY} = 0)"
_DN = f"{_VEC}, dn AS (SELECT qid, row_idx, list_dot_product(q, x) AS score FROM vq, v)"
_GOLD = f"""gold AS (SELECT qid, row_idx, max(rel) AS relevance FROM (
  SELECT q.row_idx AS qid, s.row_idx, 2 AS rel FROM s q JOIN s ON q.text = s.text WHERE q.row_idx % {EVERY} = 0
  UNION ALL SELECT q.row_idx, s.row_idx, 1 FROM s q JOIN s ON q.subset_id = s.subset_id WHERE q.row_idx % {EVERY} = 0) GROUP BY 1, 2)"""
_HITS = f"""{_LEX}, {_DN}, {_GOLD},
h0 AS (SELECT qid, 'sparse' AS engine, row_idx, score FROM {_top('bm', DEPTH)} UNION ALL SELECT qid, 'dense', row_idx, score FROM {_top('dn', DEPTH)}),
h AS (SELECT *, score - min(score) OVER (PARTITION BY qid, engine) AS ns FROM h0),
lk AS (SELECT row_idx AS qid, row_idx FROM s WHERE row_idx % {EVERY} = 0),
al AS (SELECT qid, row_idx, engine, score, ns, NULL::INT AS label FROM h UNION ALL SELECT qid, row_idx, 'lookup', NULL, 0, 1 FROM lk),
m AS (SELECT qid, row_idx, sum(CASE engine WHEN 'sparse' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * ns) AS score, max(CASE WHEN engine = 'sparse' THEN score END) AS sparse, max(CASE WHEN engine = 'dense' THEN score END) AS dense, max(label) AS label FROM al GROUP BY 1, 2),
j AS (SELECT m.*, coalesce(relevance, 0)::DOUBLE AS rel FROM m LEFT JOIN gold USING (qid, row_idx)),
lab AS (SELECT qid, row_idx, score, rel > 0 AS positive FROM j)"""
_RK = """rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_idx) AS rk, count(*) FILTER (rel > 0) OVER (PARTITION BY qid) AS np,
  score - max(score) OVER (PARTITION BY qid) - ln(sum(exp(score)) OVER (PARTITION BY qid)) + max(score) OVER (PARTITION BY qid) AS lp, CASE WHEN rel > 0 THEN rel - ln(sum(CASE WHEN rel > 0 THEN exp(rel) END) OVER (PARTITION BY qid)) END AS ld FROM j)"""
_U = "((('0x' || substr(md5(concat_ws(':', '7', qid, row_idx)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _js(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: 0.5::DOUBLE * (z[1] * ln(z[1] * 2 / (z[1] + z[2])) + z[2] * ln(z[2] * 2 / (z[1] + z[2])))))"


def _dist(expr: str, pre: str = "") -> str:
    return f"WITH {_VEC}{pre}, dn AS (SELECT qid, row_idx, -({expr}) AS score FROM {'sq, sv' if pre else 'vq, v'}) SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}"


_SM = ", sv AS (SELECT row_idx, list_transform(x, lambda e: exp(e) / t) AS x FROM (SELECT row_idx, x, list_sum(list_transform(x, lambda e: exp(e))) AS t FROM v)), sq AS (SELECT row_idx AS qid, x AS q FROM sv WHERE row_idx % 50 = 0)"


def _sample(noise: str, src: str, by: str, quota: str, extra: str = "") -> str:
    """Keys, ranks, threshold and weights over ``src(qid, row_idx, score, ...)``."""
    return f"""lp AS (SELECT *, score - max(score) OVER w - ln(sum(exp(score - mx)) OVER w) AS log_p, mx + ln(sum(exp(score - mx)) OVER w) AS lse FROM (SELECT *, max(score) OVER (PARTITION BY {by}) AS mx FROM {src}) WINDOW w AS (PARTITION BY {by})),
      ky AS (SELECT *, log_p - {noise} AS key{extra} FROM lp),
      kr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY key DESC, row_idx) AS r, {quota} AS q FROM ky),
      kt AS (SELECT *, max(CASE WHEN r = q + 1 THEN key END) OVER (PARTITION BY {by}) AS tau FROM kr),
      pk AS (SELECT *, CASE WHEN tau IS NULL THEN log_p ELSE log_p - ln(1 - exp(-exp(log_p - tau))) END AS lw FROM kt WHERE r <= q)"""


_NOISE = f"ln(-ln({_U}))"
_QUOTA = "CASE WHEN positive THEN least(pos, greatest({kp}, {kt} - neg)) ELSE {kt} - least(pos, greatest({kp}, {kt} - neg)) END"
_COUNTS = ", count(*) FILTER (positive) OVER (PARTITION BY qid) AS pos, count(*) FILTER (NOT positive) OVER (PARTITION BY qid) AS neg"
_WORST = "ws AS (SELECT qid, min(score) AS worst FROM pk WHERE NOT positive GROUP BY 1), ab AS (SELECT lab.qid, count(*) AS max_sampling_id FROM lab JOIN ws USING (qid) WHERE NOT positive AND score >= worst GROUP BY 1)"


def _labelled_sql(noise: str, kt: int, kp: int, weight: str) -> str:
    return f"WITH {_HITS}, {_sample(noise, 'lab', 'qid, positive', _QUOTA.format(kp=kp, kt=kt), _COUNTS)}, lw AS (SELECT *, {weight} AS log_weight FROM pk), {_WORST}"


_NORM = "{x} - ln(sum(exp({x})) OVER (PARTITION BY qid, positive))"
_DCG = "sum(rel / log2(rk + 1))"
SQL = {
    "bm25_topk": f"WITH {_LEX} SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('bm', 10)}",
    "bm25_subset_topk": f"""WITH {_LEX}, f AS (
        SELECT bm.* FROM bm JOIN s ON s.row_idx = bm.qid WHERE s.subset_id IS NULL
        UNION ALL SELECT q.row_idx AS qid, s.row_idx, coalesce(bm.score, 0) FROM s q JOIN s ON q.subset_id = s.subset_id LEFT JOIN bm ON bm.qid = q.row_idx AND bm.row_idx = s.row_idx WHERE q.row_idx % {EVERY} = 0)
        SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('f', 10)}""",
    "bm25_no_match_filter": f"""WITH {_S}, f AS (SELECT q.row_idx AS qid, s.row_idx, 0.0::DOUBLE AS score FROM s q JOIN s ON q.subset_id = s.subset_id WHERE q.row_idx % {EVERY} = 0) SELECT qid, row_idx, score FROM {_top('f', 10)}""",
    "gold_lookup": f"SELECT doc_id AS qid, doc_id AS row_idx, 0.0::DOUBLE AS score, 1 AS label FROM documents WHERE doc_id % {EVERY} = 0",
    "gold_lookup_empty": "SELECT doc_id AS qid, doc_id AS row_idx, 0.0::DOUBLE AS score, 1 AS label FROM documents WHERE false",
    "dense_topk_ip": f"WITH {_DN} SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}",
    "dense_topk_l2": _dist("list_sum(list_transform(list_zip(q, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"),
    "dense_topk_l1": _dist("list_sum(list_transform(list_zip(q, x), lambda z: abs(z[1] - z[2])))"),
    "dense_topk_linf": _dist("list_max(list_transform(list_zip(q, x), lambda z: abs(z[1] - z[2])))"),
    "dense_topk_js": _dist(_js("q", "x"), _SM),
    "dense_filtered_all": f"WITH {_S}, {_VEC}, dn AS (SELECT qid, v.row_idx, list_dot_product(q, x) AS score FROM vq JOIN s a ON a.row_idx = qid JOIN s b ON a.subset_id = b.subset_id JOIN v ON v.row_idx = b.row_idx) SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}",
    "shard_offsets": f"WITH {_S} SELECT shard, n, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT shard, count(*) AS n FROM s GROUP BY 1)",
    "sharded_topk": f"""WITH {_S}, {_VEC}, g AS (SELECT row_idx, shard, row_number() OVER (ORDER BY shard, row_idx) - 1 AS gidx FROM s),
        dn AS (SELECT qid, a.shard, b.gidx AS row_idx, list_dot_product(q, x) AS score FROM vq JOIN g a ON a.row_idx = qid JOIN g b ON a.shard = b.shard JOIN v ON v.row_idx = b.row_idx)
        SELECT qid, shard, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}""",
    "min_subtract": f"WITH {_HITS} SELECT qid, engine, row_idx, round(ns, 6) + 0.0::DOUBLE AS score FROM h",
    "weighted_merge": f"WITH {_HITS} SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM m",
    "merge_raw_scores": f"WITH {_HITS} SELECT qid, row_idx, round(sparse, 6) + 0.0::DOUBLE AS sparse, round(dense, 6) + 0.0::DOUBLE AS dense, label FROM m",
    "hybrid_topk": f"WITH {_HITS} SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('m', 10)}",
    "cell_probe_topk": f"""WITH {_DN}, e AS (SELECT cell, i, avg(y) AS y FROM (SELECT cell, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v) GROUP BY 1, 2), c AS (SELECT cell, list(y ORDER BY i) AS c FROM e GROUP BY 1),
        n AS (SELECT qid, cell FROM (SELECT qid, cell, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(q, c), 9) DESC, cell) AS r FROM vq, c) WHERE r <= 3),
        p AS (SELECT dn.* FROM dn JOIN v USING (row_idx) JOIN n ON n.qid = dn.qid AND n.cell = v.cell) SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('p', 10)}""",
    "cell_probe_all": f"WITH {_DN} SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}",
    "int8_topk": f"""WITH {_VEC}, c AS (SELECT row_idx, list_transform(x, lambda e: greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round(e / 0.5::DOUBLE * 127.0::DOUBLE)))) AS x FROM v), dn AS (SELECT a.row_idx AS qid, b.row_idx, list_dot_product(a.x, b.x) AS score FROM c a, c b WHERE a.row_idx % {EVERY} = 0) SELECT qid, row_idx, round(score, 6) + 0.0::DOUBLE AS score FROM {_top('dn', 10)}""",
    "priority_sample": f"WITH {_DN}, hh AS (SELECT * FROM {_top('dn', DEPTH)}), {_sample(_NOISE, 'hh', 'qid', '8')} SELECT qid, row_idx, round(log_p, 6) + 0.0::DOUBLE AS log_p, round(lw, 6) + 0.0::DOUBLE AS log_weight FROM pk",
    "truncated_sample": f"WITH {_DN}, hh AS (SELECT * FROM {_top('dn', DEPTH)} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_idx) <= 15), {_sample(_NOISE, 'hh', 'qid', '8')} SELECT qid, row_idx, round(log_p, 6) + 0.0::DOUBLE AS log_p, round(lw, 6) + 0.0::DOUBLE AS log_weight FROM pk",
    "labeled_priority_sample": _labelled_sql(_NOISE, 10, 3, _NORM.format(x="lw")) + " SELECT qid, row_idx, positive, round(log_p, 6) + 0.0::DOUBLE AS log_p, round(lse, 6) + 0.0::DOUBLE AS lse, round(log_weight, 6) + 0.0::DOUBLE AS log_weight, max_sampling_id FROM lw LEFT JOIN ab USING (qid)",
    "deterministic_sample": _labelled_sql("0", 10, 3, _NORM.format(x="log_p")) + " SELECT qid, row_idx, positive, round(log_weight, 6) + 0.0::DOUBLE AS log_weight, max_sampling_id FROM lw LEFT JOIN ab USING (qid)",
    "in_batch_negatives": _labelled_sql("0", 5, 2, "log_p") + ", b AS (SELECT qid // 200 AS batch_id, qid, row_idx, score, positive::INT AS label FROM pk) SELECT q.batch_id, q.qid, x.row_idx, round(b.score, 6) + 0.0::DOUBLE AS score, coalesce(b.label, 0) AS label FROM (SELECT DISTINCT batch_id, qid FROM b) q JOIN (SELECT DISTINCT batch_id, row_idx FROM b) x USING (batch_id) LEFT JOIN b ON b.qid = q.qid AND b.row_idx = x.row_idx",
    "batch_sections": f"""WITH {_HITS}, l2 AS (SELECT qid, row_idx, score, coalesce(label > 0, false) AS positive, rel FROM j), {_sample('0', 'l2', 'qid, positive', _QUOTA.format(kp=2, kt=5), _COUNTS)}
        SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_idx) - 1)::INT AS pos, row_idx::VARCHAR AS section_id, round(score, 6) + 0.0::DOUBLE AS score, positive::INT AS label, rel AS relevance FROM pk WHERE qid IN (SELECT row_idx FROM s)""",
    "metric_mrr_10": f"WITH {_HITS}, {_RK} SELECT qid, round(coalesce(1.0::DOUBLE / min(CASE WHEN rk <= 10 AND rel > 0 THEN rk END), 0), 6) + 0.0::DOUBLE AS mrr_10 FROM rk GROUP BY 1",
    "metric_hitrate_3": f"WITH {_HITS}, {_RK} SELECT qid, max(CASE WHEN rk <= 3 AND rel > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hitrate_3 FROM rk GROUP BY 1",
    "metric_precision_10": f"WITH {_HITS}, {_RK} SELECT qid, round(count(*) FILTER (rk <= 10 AND rel > 0)::DOUBLE / count(*) FILTER (rk <= 10), 6) + 0.0::DOUBLE AS precision_10 FROM rk GROUP BY 1",
    "metric_recall_10": f"WITH {_HITS}, {_RK} SELECT qid, round(count(*) FILTER (rk <= 10 AND rel > 0)::DOUBLE / nullif(max(np), 0), 6) + 0.0::DOUBLE AS recall_10 FROM rk GROUP BY 1",
    "metric_min_10": f"WITH {_HITS}, {_RK} SELECT qid, round(min(score) FILTER (rk <= 10), 6) + 0.0::DOUBLE AS min_10 FROM rk GROUP BY 1",
    "metric_max_10": f"WITH {_HITS}, {_RK} SELECT qid, round(max(score) FILTER (rk <= 10), 6) + 0.0::DOUBLE AS max_10 FROM rk GROUP BY 1",
    "metric_ndcg_10": f"WITH {_HITS}, {_RK}, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rk) AS ir FROM rk WHERE rk <= 10) SELECT qid, round(coalesce({_DCG} / nullif(sum(rel / log2(ir + 1)), 0), 0), 6) + 0.0::DOUBLE AS ndcg_10 FROM c GROUP BY 1",
    "metric_kldiv": f"WITH {_HITS}, {_RK} SELECT qid, round(sum(exp(ld) * (ld - lp)), 6) + 0.0::DOUBLE AS kldiv FROM rk GROUP BY 1",
    "metric_entropy": f"WITH {_HITS}, {_RK} SELECT qid, round(-sum(exp(lp) * lp), 6) + 0.0::DOUBLE AS entropy FROM rk GROUP BY 1",
    "metric_summary": f"""WITH {_HITS}, ks AS (SELECT qid, row_idx, rel, unnest(['score', 'sparse', 'dense']) AS k, unnest([score, sparse, dense]) AS sc FROM j),
        rk AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY round(sc, 9) DESC, row_idx) AS rk, count(*) FILTER (rel > 0) OVER (PARTITION BY k, qid) AS np FROM ks WHERE sc IS NOT NULL),
        c AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY rel DESC, rk) AS ir FROM rk WHERE rk <= 10),
        q AS (SELECT k, qid, coalesce(1.0::DOUBLE / min(CASE WHEN rel > 0 THEN rk END), 0) AS mrr_10, max(CASE WHEN rk <= 3 AND rel > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hitrate_3, count(*) FILTER (rel > 0)::DOUBLE / nullif(max(np), 0) AS recall_10, coalesce({_DCG} / nullif(sum(rel / log2(ir + 1)), 0), 0) AS ndcg_10 FROM c GROUP BY 1, 2)
        SELECT k AS score_key, metric, round(avg(value), 6) + 0.0::DOUBLE AS value, count(value) AS n_queries FROM (SELECT k, unnest(['mrr_10', 'hitrate_3', 'recall_10', 'ndcg_10']) AS metric, unnest([mrr_10, hitrate_3, recall_10, ndcg_10]) AS value FROM q) GROUP BY 1, 2""",
    "loss_retrieval": f"WITH {_HITS}, {_RK} SELECT qid, round(sum((exp(lp) - (rel > 0)::INT) * lp) / CASE WHEN max(np) > 0 THEN max(np) ELSE count(*) END, 6) + 0.0::DOUBLE AS loss FROM rk GROUP BY 1",
    "loss_guidance": f"WITH {_HITS}, {_RK}, e AS (SELECT qid, abs(lp - sparse) AS e FROM rk) SELECT qid, round(avg(CASE WHEN e < 1 THEN e * e / 2 ELSE e - 0.5 END), 6) + 0.0::DOUBLE AS loss FROM e GROUP BY 1",
    "loss_self_supervision": f"WITH {_HITS}, {_RK} SELECT qid, round(-max(lp) FILTER (rel > 0), 6) + 0.0::DOUBLE AS loss FROM rk GROUP BY 1",
    "loss_score_decay": f"WITH {_HITS} SELECT qid, round(avg(score * score), 6) + 0.0::DOUBLE AS loss FROM j GROUP BY 1",
    "loss_combined": f"""WITH {_HITS}, {_RK}, e AS (SELECT *, abs(lp - sparse) AS e FROM rk) SELECT qid, round(sum((exp(lp) - (rel > 0)::INT) * lp) / CASE WHEN max(np) > 0 THEN max(np) ELSE count(*) END
        + 0.5::DOUBLE * coalesce(avg(CASE WHEN e < 1 THEN e * e / 2 ELSE e - 0.5 END), 0) + 0.25::DOUBLE * coalesce(-max(lp) FILTER (rel > 0), 0) + 0.1::DOUBLE * avg(score * score), 6) + 0.0::DOUBLE AS loss FROM e GROUP BY 1""",
    "loss_marginal_likelihood": f"WITH {_HITS}, {_RK} SELECT qid, round(-ln(sum(exp(lp - row_idx / 1000.0::DOUBLE))), 6) + 0.0::DOUBLE AS loss FROM rk GROUP BY 1",
    "kld_diagnostics": f"""WITH {_HITS}, x AS (SELECT qid, score, unnest(['sparse', 'dense']) AS e, unnest([sparse, dense]) AS o FROM j), y AS (SELECT *, score - max(score) OVER w AS s1, o - max(o) OVER w AS o1 FROM x WHERE o IS NOT NULL WINDOW w AS (PARTITION BY e, qid)),
        z AS (SELECT *, s1 - ln(sum(exp(s1)) OVER w) AS lp, o1 - ln(sum(exp(o1)) OVER w) AS lq FROM y WINDOW w AS (PARTITION BY e, qid))
        SELECT qid, round(sum(exp(lq) * (lq - lp)) FILTER (e = 'sparse'), 6) + 0.0::DOUBLE AS kld_sparse, round(sum(exp(lq) * (lq - lp)) FILTER (e = 'dense'), 6) + 0.0::DOUBLE AS kld_dense FROM z GROUP BY 1""",
    "score_softmax": f"WITH {_DN}, hh AS (SELECT * FROM {_top('dn', DEPTH)}) SELECT qid, row_idx, round(score - ln(sum(exp(score)) OVER (PARTITION BY qid)), 6) + 0.0::DOUBLE AS log_p, round(ln(sum(exp(score)) OVER (PARTITION BY qid)), 6) + 0.0::DOUBLE AS lse FROM hh",
}
