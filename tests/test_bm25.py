"""BM25 by tiles against brute force, and what a search shuffles."""

import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.operators.lexical import LexicalIndex
from tests_common import shuffled


def brute(texts, queries, k, k1=1.2, b=0.75):
    """``{qid: [(row_idx, score)]}`` of ``texts {row_idx: words}``; a query's filter is a set of numbers or None."""
    df = Counter(w for t in texts.values() for w in set(t))
    n, avgdl = len(texts), sum(map(len, texts.values())) / len(texts)
    out = {}
    for qid, (words, among) in queries.items():
        found = []
        for i, t in texts.items():
            tf = Counter(t)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avgdl)) for w, c in Counter(words).items() if w in tf)
            if s > 0 and (among is None or i in among):
                found.append((i, s))
        out[qid] = sorted(found, key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def some(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = {i: rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 25)) for i in range(n)}
    texts[n - 1] = texts[n - 2] = texts[3]  # equal scores
    return texts


@pytest.mark.parametrize("k", [1, 7, None])
@pytest.mark.parametrize("dense", [0, 5, 1000])
def test_tiles_lose_no_hit(monkeypatch, k, dense):
    for name, value in (("QUERIES", 16), ("TEXTS", 32), ("ALONE", 12), ("HELD_TEXTS", 90), ("DENSE", dense)):
        monkeypatch.setattr(bm25, name, value)
    texts = some(1, 300)
    subset = {i: f"s{i % 4}" if i % 5 else None for i in texts}
    queries = {i: (texts[i], None if i % 3 else {j for j in texts if subset[j] in ("s1", "s2")}) for i in range(0, 300, 7)}
    df = Counter(w for t in texts.values() for w in set(t))
    asked = [(i, w, c, df[w]) for i, (words, _) in queries.items() for w, c in Counter(words).items()]
    t = pa.Table.from_arrays([pa.array(c) for c in zip(*asked)], names=["qid", "term", "qtf", "df"])
    bound = [i for i, (_, among) in queries.items() if among is not None]
    wanted = pa.table({"qid": [i for i in bound for _ in range(2)], "subset_id": ["s1", "s2"] * len(bound)})
    avgdl = sum(map(len, texts.values())) / len(texts)
    q = bm25.Queries(t, wanted, pa.table({"qid": bound}), len(texts), avgdl, 1.2, 0.75)
    rows = [(i, len(x), list(Counter(x)), list(Counter(x).values()), [s for s in [subset[i]] if s]) for i, x in texts.items()]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[a : a + 40]), kinds)], names=["row_idx", "dl", "terms", "tfs", "subset_ids"]) for a in range(0, 300, 40)]
    got = {i: [] for i in queries}
    for qid, idx, score in bm25.searched(iter(batches), q, k):
        for a, b, c in zip(qid.to_pylist(), idx.tolist(), score.tolist()):
            got[a].append((b, c))
    want = brute(texts, queries, k)
    assert {i: [x for x, _ in sorted(v, key=lambda x: (-round(x[1], 9), x[0]))] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in want.items()}
    assert all(abs(dict(got[i])[x] - s) < 1e-9 for i, v in want.items() for x, s in v)


def test_search_in_blocks_of_queries_and_texts_of_one_number(spark, monkeypatch):
    from lodestone.operators import lexical

    monkeypatch.setattr(lexical, "BLOCK", 40)
    texts = some(2, 120)
    halves = [(i, None, " ".join(t[a:b])) for i, t in texts.items() for a, b in ((0, 3), (3, None)) if a == 0 or i % 2]
    whole = {i: t if i % 2 else t[:3] for i, t in texts.items()}
    s = spark.createDataFrame(halves, "row_idx long, subset_id string, body string")
    queries = {i: (texts[i], None) for i in range(0, 120, 9)}
    q = spark.createDataFrame([(i, " ".join(t)) for i, (t, _) in queries.items()], "qid long, text string")
    found = LexicalIndex.build(s).search(q, 5).collect()
    got = {i: sorted(((r.row_idx, r.score) for r in found if r.qid == i), key=lambda x: (-round(x[1], 9), x[0])) for i in queries}
    want = brute(whole, queries, 5)
    assert {i: [x for x, _ in v] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in want.items()}


@pytest.mark.parametrize("filtered", [False, True])
def test_search_shuffles_no_pairs(spark, filtered):
    """Each of 90 queries matches each of 600 texts: 54,000 pairs, of which 3 a query and task are sent."""
    s = spark.range(600).select(F.col("id").alias("row_idx"), F.lit("x").alias("subset_id"), F.concat(F.lit("all of them "), F.col("id") % 7).alias("body"))
    q = spark.range(90).select(F.col("id").alias("qid"), F.concat(F.lit("all them "), F.col("id") % 7).alias("text"))
    df = LexicalIndex.build(s).search(q.withColumn("subset_ids", F.array(F.lit("x"))) if filtered else q, 3)
    assert len(df.collect()) == 270
    assert shuffled(df) < 10_000


def test_search_shuffle_follows_the_cores_and_not_the_files(spark):
    """60 files of texts: 90 queries send 3 hits for each of at most 2 tasks a core, not for each file."""
    s = spark.range(0, 600, 1, 60).select(F.col("id").alias("row_idx"), F.concat(F.lit("all of them "), F.col("id") % 7).alias("body"))
    q = spark.range(90).select(F.col("id").alias("qid"), F.concat(F.lit("all them "), F.col("id") % 7).alias("text"))
    index, kept = LexicalIndex.build(s), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a task for each file
    try:
        df = index.search(q, 3)
        assert len(df.collect()) == 270
        assert shuffled(df) <= 2 * spark.sparkContext.defaultParallelism * 270
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept)


def test_equal_texts_have_equal_scores_wherever_they_are_read(spark):
    """Summed in another order the scores of equal texts differ in their last bits, and samples cut such ties by them."""
    rng, words = random.Random(5), [f"w{i}" for i in range(60)]
    same = rng.choices(words, k=90)
    rows = []
    for i in range(12):  # a text of other words before it gives each copy another order of words
        rows += [(2 * i, " ".join(rng.sample(words, rng.randint(20, 50)))), (2 * i + 1, " ".join(same))]
    s = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "row_idx long, body string")
    q = spark.createDataFrame([(0, " ".join(same))], "qid long, text string")
    found = LexicalIndex.build(s).search(q, 12).collect()
    assert {r.row_idx for r in found} == set(range(1, 24, 2))
    assert len({r.score for r in found}) == 1


def test_kept_index_is_written_small(spark, tmp_path):
    """The index is most of a search's disk; as Spark compresses by default it takes 1.7 times as much."""
    s = spark.createDataFrame([(i, " ".join(t)) for i, t in some(3, 40).items()], "row_idx long, body string")
    LexicalIndex.build(s, folder=f"file://{tmp_path}", key={"source": "these"})
    files = list(tmp_path.glob("*/*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files if pq.ParquetFile(f).metadata.num_row_groups]
    assert len({f.parent for f in files}) == 2
    assert groups and {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"ZSTD"}
