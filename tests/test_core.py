"""Small fixtures: nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.errors import LinkError, NoAdapterError, TemplateError
from lodestone.functions import scoring, text
from lodestone.operators import chunking, dense, encode, fusion, harmonise, losses, metrics, sampling
from lodestone.operators.lexical import LexicalIndex
from lodestone.operators.pairs import pairs_within
from lodestone.operators.references import Edge, cascade, unresolved
from lodestone.sources import readers

T = lambda day, hour=0: dt.datetime(2024, 1, day, hour)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairs_within_splits_groups(spark):
    ids = [("a", f"i{k:03d}") for k in range(40)] + [("b", "x"), ("b", "y"), ("b", "y"), ("c", "z"), (None, "q"), ("b", None)]
    df = spark.createDataFrame(ids, "key string, id string")
    got = {(r.id_a, r.id_b) for r in pairs_within(df, "key", "id", block=7).collect()}
    want = {(f"i{a:03d}", f"i{b:03d}") for a in range(40) for b in range(a + 1, 40)} | {("x", "y")}
    assert got == want and pairs_within(df, "key", "id", block=7).count() == len(want)
    assert pairs_within(df.limit(0), "key", "id").count() == 0


def test_unresolved_as_of(spark):
    ev = spark.createDataFrame(
        [("a", T(2), False), ("a", T(4), True), ("a", T(6), False), ("b", T(3), None), ("c", T(3), False), ("c", T(3), True), (None, T(1), False)],
        "id string, loaded_at timestamp, deleted boolean",
    )
    refs = [("a", T(1)), ("a", T(2)), ("a", T(3)), ("a", T(4)), ("a", T(5)), ("a", T(7)), ("b", T(3)), ("b", T(2, 23)), ("c", T(4)), ("A", T(7)), (" ", T(7)), (None, T(7)), ("a", None), ("a ", T(7))]
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(refs)], "section_id string, made_at timestamp, loaded_at int")
    got = sorted(r["loaded_at"] for r in unresolved(df, ev).collect())
    assert got == [0, 3, 4, 7, 8, 9, 12, 13]
    assert unresolved(df, ev.limit(0)).count() == 12 and unresolved(df.limit(0), ev).count() == 0


def test_cascade_ends_on_cycles(spark):
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("b", "d"), ("y", "x"), (None, "a")], "child string, parent string")
    direct = spark.createDataFrame([("t", "a"), ("t", None)], "rec_table string, rec_id string")
    got = {r.rec_id: (r.kind, r.depth) for r in cascade(direct, [Edge("t", "t", refs)]).collect()}
    assert got == {"a": ("direct", 0), "b": ("inherited", 1), "c": ("inherited", 2), "d": ("inherited", 3)}


def test_template():
    assert text.template_variables("{{ a }}{% if b %}x{{ c }}{% endif %}") == ["a", "b", "c"]
    for bad in ("{% if a %}x", "x{% endif %}", "{{ a | upper }}", "{% for x in y %}"):
        with pytest.raises(TemplateError):
            text.render(bad)
    with pytest.raises(TemplateError):
        text.render("{{ a }}", ["b"])


def test_render_and_text(spark):
    df = spark.createDataFrame([("t", "c"), (None, "c"), ("", None)], "title string, content string")
    assert [r[0] for r in df.select(text.render("{% if title %}{{ title }}: {% endif %}{{ content }}")).collect()] == ["t: c", "c", ""]
    one = df.limit(1).select(text.highlight(F.lit("The cat, the CAT."), ["cat!", "the"]), text.camel_to_snake(F.lit("EsSearchMaster")), text.human_number(F.lit(1500000)), text.tokens(F.lit("Ça va, l'été"), fold=True)).first()
    assert tuple(one) == ("The [cat], the [CAT].", "es_search_master", "1.5M", ["ca", "va", "l", "ete"])
    with pytest.raises(Exception, match="unknown language"):
        df.select(text.language_name(F.lit("xx"))).collect()


@pytest.mark.parametrize("offset", [0.0, 1.0, -10.0])
def test_min_subtract(spark, offset):
    vals = [3.0, 5.5, float("nan"), float("-inf"), float("inf"), None]
    df = spark.createDataFrame([(1, v) for v in vals] + [(2, float("nan"))], "qid int, s double")
    got = [r[0] for r in df.filter("qid = 1").withColumn("o", scoring.min_subtract(F.col("s"), "qid", offset=offset)).select("o").collect()]
    assert sorted(x for x in got if x is not None and math.isfinite(x)) == [offset, 2.5 + offset] and sum(x is None for x in got) == 1


def test_merge_missing_is_zero(spark):
    a = spark.createDataFrame([(1, 10, 5.0), (1, 11, 3.0)], "qid long, row_idx long, score double")
    b = spark.createDataFrame([(1, 11, 9.0), (1, 12, 4.0), (1, 13, 5e12)], "qid long, row_idx long, score double")
    look = spark.createDataFrame([(1, 12, 0.0)], "qid long, row_idx long, score double")
    m = fusion.merge(fusion.fan_in({"a": a, "b": b, "lookup": look}), {"a": 2.0}, ["a", "b"])
    got = {r.row_idx: (r.score, r.a, r.b, r.label) for r in m.collect()}
    assert got == {10: (4.0, 5.0, None, None), 11: (5.0, 3.0, 9.0, None), 12: (0.0, None, 4.0, 1), 13: (0.0, None, None, None)}
    with pytest.raises(LinkError):
        fusion.fan_in({})


def test_bm25_edges(spark):
    s = spark.createDataFrame([(0, "a", "x", "red fox"), (1, "b", "x", "red red dog"), (2, "c", "y", None), (3, "d", "y", "")], "row_idx long, section_id string, subset_id string, body string")
    q = spark.createDataFrame([(1, "red", []), (2, "red", ["x", "y"]), (3, "zzz", None), (4, None, ["y"]), (5, "red", [None])], "qid long, text string, subset_ids array<string>")
    got = {}
    for r in LexicalIndex.build(s).search(q, 10).collect():
        got.setdefault(r.qid, {})[r.row_idx] = r.score
    assert set(got) == {1, 2, 4, 5} and set(got[1]) == {0, 1} and set(got[2]) == {0, 1, 2, 3} and got[4] == {2: 0.0, 3: 0.0}
    assert LexicalIndex.build(s.limit(0)).search(q, 10).count() == 4 * 0


def test_dense_metrics_agree_with_columns(spark):
    v = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11) / 10 for j in range(4)]) for i in range(30)] + [(99, None)], "row_idx long, vector array<float>")
    q = v.filter("row_idx < 3").withColumnRenamed("row_idx", "qid")
    for m in dense.METRICS:
        d = lambda c: F.transform(c, lambda x: x.cast("double"))
        cross = q.crossJoin(v.filter("vector is not null").withColumnRenamed("vector", "w")).withColumn("score", dense.score_column(m, d("vector"), d("w")))
        from lodestone.operators.lexical import top

        want = {(r.qid, r.row_idx): round(r.score, 6) for r in top(cross.select("qid", "row_idx", "score"), 5).collect()}
        assert {(r.qid, r.row_idx): round(r.score, 6) for r in dense.search(q, v, 5, m).collect()} == want
    assert dense.search(q.limit(0), v, 5).count() == 0
    with pytest.raises(ValueError):
        dense.search(q, v, 5, "cosine")


def test_probing_all_cells_is_exact_and_few_keep_recall(spark):
    import random

    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) + 3 * (i % 5 == j) for j in range(8)]) for i in range(300)], "row_idx long, vector array<double>")
    q = v.filter("row_idx % 50 = 0").withColumnRenamed("row_idx", "qid")
    exact = {(r.qid, r.row_idx) for r in dense.search(q, v, 10).collect()}
    coded, cells = dense.train_cells(v, 6)
    assert {(r.qid, r.row_idx) for r in dense.probe(q, coded, cells, 6, 10).collect()} == exact
    near = {(r.qid, r.row_idx) for r in dense.probe(q, coded, cells, 4, 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_priority_sampling_is_unbiased(spark):
    n, k, trials = 30, 8, 400
    df = spark.range(trials).withColumnRenamed("id", "qid").crossJoin(spark.range(n).withColumnRenamed("id", "row_idx")).withColumn("score", F.sin(F.col("row_idx").cast("double")) * 2)
    s = sampling.priority_sample(df, k, 1.0, 3)
    assert s.groupBy("qid").agg(F.countDistinct("row_idx").alias("c"), F.count(F.lit(1)).alias("n")).filter(f"c <> {k} or n <> {k}").count() == 0
    w = [math.exp(2 * math.sin(i)) for i in range(n)]
    want = sum(x * i for i, x in enumerate(w)) / sum(w)
    got = s.select((F.exp("log_weight") * F.col("row_idx")).alias("x")).agg(F.sum("x")).first()[0] / trials
    assert abs(got - want) < 10 * n / math.sqrt(trials * k) / 3


def test_labelled_quota(spark):
    df = spark.createDataFrame([(1, i, float(i), int(i < 2)) for i in range(10)] + [(2, i, 1.0, 1) for i in range(6)] + [(3, 0, float("nan"), 1), (3, 1, 2.0, 0), (4, 0, None, None)], "qid long, row_idx long, score double, label int")
    got = {}
    for r in sampling.labeled_priority_sample(df, 5, 3, 0.0).collect():
        got.setdefault(r.qid, []).append(r.positive)
    assert sorted(got[1]) == [False] * 3 + [True] * 2 and got[2] == [True] * 5 and got[3] == [False] and 4 not in got


def test_metric_edges(spark):
    df = spark.createDataFrame(
        [(1, 1, 3.0, 1.0), (1, 2, 2.0, 0.0), (1, 3, 1.0, 2.0), (2, 1, 1.0, 0.0), (2, 2, 1.0, None), (3, 1, float("nan"), 1.0), (3, 2, float("inf"), 1.0), (3, 3, None, 1.0)],
        "qid long, row_idx long, score double, relevance double",
    )
    got = {r.qid: r for r in metrics.per_query(df, ["mrr", "hitrate_1", "precision_2", "recall_2", "ndcg", "kldiv"]).collect()}
    assert set(got) == {1, 2}
    assert got[1].mrr == 1.0 and got[1].hitrate_1 == 1.0 and got[1].precision_2 == 0.5 and got[1].recall_2 == 0.5 and 0 < got[1].ndcg < 1
    assert got[2].mrr == 0.0 and got[2].recall_2 is None and got[2].ndcg == 0.0 and got[2].kldiv is None
    with pytest.raises(ValueError):
        metrics.parse("f1_3")


def test_losses_without_positives(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.0, None), (1, 2, 0.0, 0.0, 2.0)], "qid long, row_idx long, score double, relevance double, sparse double")
    assert losses.retrieval(df).count() == 1 and losses.self_supervision(df).first().loss is None and losses.guidance(df).first().loss > 0


def test_adapters(spark):
    mc = spark.createDataFrame([("1", "q", ["a", "b", "c"], "B", "art"), ("2", "r", None, None, None)], "id string, question string, options array<string>, answer string, article string")
    q = {r.id: r for r in harmonise.harmonise(mc, "queries").collect()}
    assert q["1"].answer_scores == [0.0, 1.0, 0.0] and len(q["1"].subset_ids) == 1 and q["2"].answers == [] and q["2"].subset_ids == []
    assert harmonise.harmonise(mc, "sections").count() == 1
    pages = spark.createDataFrame([("7", "q", (["w1", "w2"], ["t1", "t2"]), (["x", "y"],))], "question_id string, question string, entity_pages struct<wiki_context array<string>, title array<string>>, answer struct<aliases array<string>>")
    p = harmonise.harmonise(pages, "queries").first()
    assert p.answers == ["x", "y"] and len(p.subset_ids) == 2
    dotted = spark.createDataFrame([("1", "body")], ["_id", "document.text"])
    assert harmonise.harmonise(dotted, "sections").first().content == "body"
    with pytest.raises(NoAdapterError):
        harmonise.harmonise(spark.range(1), "queries")
    with pytest.raises(Exception, match="null in k"):
        harmonise.keep_first(spark.createDataFrame([(None, 1)], "k string, v int"), "k", "v").collect()
    bad = spark.createDataFrame([("1", ["a"], [1.0, 2.0], None, None)], "id string, answers array<string>, answer_scores array<double>, retrieval_ids array<string>, retrieval_scores array<double>")
    with pytest.raises(Exception, match="different length"):
        harmonise.checked_queries(bad).collect()


def test_chunks(spark):
    df = spark.createDataFrame([("a", " ".join(map(str, range(10)))), ("b", ""), ("c", None), ("d", "x. . y. ")], "id string, content string")
    got = {}
    for r in chunking.fixed_chunks(df, length=4, stride=3).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got["a"] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"] and got["b"] == [""] and got["c"] == [""]
    assert [r.content for r in chunking.sentence_chunks(df).filter("id = 'd'").orderBy("chunk_no").collect()] == ["x", "", "y", ""]
    with pytest.raises(ValueError):
        chunking.fixed_chunks(df, length=2, prefix="two words")


def test_sources(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"t","metadata":{}}\n{"_id":"q2","text":"u"}\n')
    (tmp_path / "corpus.jsonl").write_text('{"_id":"c1","title":"a","text":"b"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\tc1\t1\nq2\tc1\t0\n")
    s = harmonise.QrelsSet(spark, str(tmp_path))
    assert [tuple(r) for r in s.load_queries("test").select("id", "retrieval_ids").collect()] == [("q1", ["c1"])] and s.load_sections().count() == 1
    df = spark.createDataFrame([("a", "train"), ("b", "validation")], "id string, split string")
    assert readers.select_split(df, "val").count() == 1 and readers.select_split(df, "all").count() == 2
    with pytest.raises(LinkError, match="train"):
        readers.select_split(df, "test")
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None)], "row_idx long, vector array<float>")
    path = f"file://{tmp_path}/v"
    with pytest.raises(FileNotFoundError):
        readers.open_vectors(spark, path, lambda: v, "r")
    assert readers.open_vectors(spark, path, lambda: v).count() == 4
    with pytest.raises(FileExistsError):
        readers.open_vectors(spark, path, lambda: v, "x")
    assert readers.open_vectors(spark, path, lambda: v.limit(1), "a").count() == 5
    assert sorted(r.row_idx for r in readers.invalid_vectors(v).collect()) == [1, 2, 3] and readers.vector_shape(v) == 2
    made = []
    for _ in range(2):
        assert readers.cached(spark, f"file://{tmp_path}/c", {"k": 1}, lambda: made.append(1) or v).count() == 4
    assert len(made) == 1
    assert readers.row_hashes(v).first() == readers.row_hashes(v.repartition(3)).first()
    with readers.cache_scope(spark, f"file://{tmp_path}/scope"):
        assert (tmp_path / "scope").exists()
    assert not (tmp_path / "scope").exists()


def test_encoders(spark):
    import numpy as np

    df = spark.createDataFrame([(0, "a b a"), (1, None), (2, "")], "row_idx long, text string")
    got = {r.row_idx: r.vector for r in encode.hashed_bag(df, "text", 8).collect()}
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[1] == got[2] == [0.0] * 8
    e = encode.encode(df, "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.row_idx: r.vector for r in e.collect()} == {0: [5.0, 1.0], 1: [0.0, 1.0], 2: [0.0, 1.0]}


def test_config():
    c = config.HybridConfig().merge({"sparse": {"k1": 2.0}, "dense": None})
    assert c.sparse.k1 == 2.0 and c.sparse.b == 0.75
    assert config.LexicalConfig(port=1).fingerprint == config.LexicalConfig(port=2).fingerprint != config.LexicalConfig(b=0.1).fingerprint
    assert config.expand({"__vars__": {"l": ["a", "b"], "n": [1, 2]}, "name": "{l}-{n}", "x": ["{n}"]})[1] == {"name": "a-2", "x": ["2"]}
    with pytest.raises(LinkError):
        config.linked([config.DatasetConfig("q")], [config.DatasetConfig("a"), config.DatasetConfig("b")])
    assert config.update_steps(4, 10) == [0, 4, 8, 10] and config.period_of(5, [0, 4, 8, 10]) == 1
    assert dense.parse_index_string("OPQ16_64,IVF256,PQ16x8fs")["m"] == 16
    with pytest.raises(ValueError):
        dense.parse_index_string("HNSW32")


def test_numbered(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(57)], "k string, v int").repartition(5)
    assert [(r.k, r.row_idx) for r in harmonise.numbered(df, "k").orderBy("k").collect()] == [(f"k{i:03d}", i) for i in range(57)]
    with pytest.raises(ValueError):
        harmonise.numbered(df.withColumnRenamed("v", "row_idx"), "k")


def test_plans(spark):
    from lodestone.plans import retrieval

    plan = retrieval.bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "WindowGroupLimit" in plan


def test_recall_of_approximate_searches(spark):
    from lodestone.plans import retrieval

    d = "/root/testdata/sf0.01"
    exact = {(r.qid, r.row_idx) for r in retrieval.QUERIES["dense_topk_ip"](spark, d).collect()}
    for name in ("kmeans_cells_topk", "product_quantised_topk", "int8_topk"):
        got = {(r.qid, r.row_idx) for r in retrieval.QUERIES[name](spark, d).collect()}
        assert len(got & exact) >= 0.9 * len(exact), name


def test_recall_of_quantised_search_on_a_larger_table(spark, tmp_path):
    import random

    from lodestone.plans import retrieval

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 10) for i in range(12_000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    for d in (f"file://{tmp_path}", "/root/testdata/sf0.1"):
        exact = {(r.qid, r.row_idx) for r in retrieval.QUERIES["dense_topk_ip"](spark, d).collect()}
        got = {(r.qid, r.row_idx) for r in retrieval.QUERIES["product_quantised_topk"](spark, d).collect()}
        assert len(got & exact) >= 0.9 * len(exact)
