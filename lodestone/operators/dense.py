"""Vector search: exact top k by five metrics, cell probing, and quantisation.

Queries of at most ``QUERY_BYTES`` are one broadcast of checked size; more are cut into blocks that
meet blocks of the vectors on the executors, by a join key of both. Either way a task works in tiles of bounded
size, keeps one running best k for each query, and sends it once.
Distances are negated, so that a larger score is always better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import top

METRICS = ("inner_product", "l2", "l1", "linf", "js")
#: Bytes of query vectors in one broadcast.
QUERY_BYTES = 32 << 20
#: Queries, and vectors, of one tile: 32 MB of scores.
TILE = 2048
HITS = "qid long, row_idx long, score double"


def score_column(metric: str, q: Column, v: Column) -> Column:
    """Score of two arrays of doubles as a Column, for joins that are small already."""
    add = lambda f: F.aggregate(F.zip_with(q, v, f), F.lit(0.0), lambda a, x: a + x)
    if metric == "inner_product":
        return add(lambda a, b: a * b)
    if metric == "l2":
        return -add(lambda a, b: (a - b) * (a - b))
    if metric == "l1":
        return -add(lambda a, b: F.abs(a - b))
    if metric == "linf":
        return -F.array_max(F.zip_with(q, v, lambda a, b: F.abs(a - b)))
    if metric == "js":
        kl = lambda a, m: F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))
        return -add(lambda a, b: 0.5 * (kl(a, (a + b) / 2) + kl(b, (a + b) / 2)))
    raise ValueError(f"unknown metric {metric}; known: {METRICS}")


def _scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if metric == "inner_product":
        return q @ v.T
    out = np.empty((len(q), len(v)))
    for i, x in enumerate(q):
        if metric == "js":
            m = (x + v) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.where(x > 0, x * np.log(x / m), 0.0)
                b = np.where(v > 0, v * np.log(v / m), 0.0)
            out[i] = -0.5 * (a + b).sum(axis=1)
        else:
            d = np.abs(v - x)
            out[i] = -_distance(metric, d)
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a vector, and their vectors; NaN and null elements are 0."""
    at = np.flatnonzero(np.asarray(column.is_valid()))
    if not len(at):
        return at, np.zeros((0, 0))
    lists = column.take(pa.array(at))
    width = len(lists[0])
    flat = lists.flatten()
    if len(flat) != width * len(at):
        raise ValueError("vectors of different length")
    return at, np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width), nan=0.0)


class Best:
    """The running best k of a set of queries, in the order that the final rank has: by rounded score, then by number."""

    def __init__(self, q: np.ndarray, k: int, metric: str, shards: np.ndarray | None = None) -> None:
        self.q, self.k, self.metric, self.shards = q, k, metric, shards
        self.score = np.full((len(q), k), -np.inf)
        self.idx = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, idx: np.ndarray, v: np.ndarray, shards: np.ndarray | None = None) -> None:
        for i in range(0, len(self.q), TILE):
            for j in range(0, len(v), TILE):
                self._tile(slice(i, i + TILE), idx[j : j + TILE], v[j : j + TILE], None if shards is None else shards[j : j + TILE])

    def _tile(self, rows: slice, idx: np.ndarray, v: np.ndarray, shards: np.ndarray | None) -> None:
        s = _scores(self.metric, self.q[rows], v)
        if shards is not None:
            s = np.where(self.shards[rows][:, None] == shards[None, :], s, -np.inf)
        s = np.concatenate([self.score[rows], s], axis=1)
        rounded = np.round(s, 9)
        ids = np.concatenate([self.idx[rows], np.broadcast_to(idx, (len(s), len(idx)))], axis=1)
        # All that reach the k-th score, ties too; then in order.
        least = -np.partition(-rounded, self.k - 1, axis=1)[:, self.k - 1]
        who, at = np.nonzero((rounded >= least[:, None]) & np.isfinite(s))
        order = np.lexsort((ids[who, at], -rounded[who, at], who))
        who, at = who[order], at[order]
        place = np.arange(len(who)) - np.searchsorted(who, np.arange(len(s)))[who]
        kept = place < self.k
        who, at, place = who[kept], at[kept], place[kept]
        best, best_ids = np.full((len(s), self.k), -np.inf), np.full((len(s), self.k), np.iinfo(np.int64).max)
        best[who, place], best_ids[who, place] = s[who, at], ids[who, at]
        self.score[rows], self.idx[rows] = best, best_ids

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        keep = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], keep.shape)[keep]), pa.array(self.idx[keep]), pa.array(self.score[keep])], names=["qid", "row_idx", "score"])


def search(queries: DataFrame, vectors: DataFrame, top_k: int = 10, metric: str = "inner_product", shard: str | None = None) -> DataFrame:
    """``(qid, row_idx, score)``: the best ``top_k`` of ``vectors(row_idx, vector)`` for ``queries(qid, vector)``.

    With ``shard`` both sides have that column and a query meets vectors of its shard only. Null
    vectors are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {METRICS}")
    keys = [shard] if shard else []
    q = queries.filter("vector is not null").select("qid", "vector", *keys)
    v = vectors.filter("vector is not null").select("row_idx", "vector", *keys)
    size = q.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("b")).first()["b"]  # one number
    found = _broadcast_search(q, v, top_k, metric, shard) if size <= QUERY_BYTES else _block_search(q, v, top_k, metric, shard, size)
    return top(found, top_k)


def _broadcast_search(q: DataFrame, v: DataFrame, top_k: int, metric: str, shard: str | None) -> DataFrame:
    t = q.toArrow()  # at most QUERY_BYTES
    names = np.array(t.column(2).to_pylist(), dtype=object) if shard else None
    _, matrix = _matrix(t.column(1).combine_chunks()) if t.num_rows else (None, np.zeros((0, 0)))
    shared = v.sparkSession.sparkContext.broadcast((t.column(0).to_numpy().astype(np.int64), matrix, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, m, names = shared.value
        best = Best(m, top_k, metric, names)
        for b in batches:
            if b.num_rows and len(qid):
                _, x = _matrix(b.column(1))
                best.add(b.column(0).to_numpy().astype(np.int64), x, np.array(b.column(2).to_pylist(), dtype=object) if shard else None)
        yield best.rows(qid)

    return v.mapInArrow(run, HITS)


def _block_search(q: DataFrame, v: DataFrame, top_k: int, metric: str, shard: str | None, size: int) -> DataFrame:
    """Blocks of queries meet blocks of vectors, each two in one group of bounded size; the best k of a group are ranked again by all."""
    space = v.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("b")).first()["b"]
    nq, nv = -(-size // QUERY_BYTES), max(1, -(-space // QUERY_BYTES))
    # With shards only equal ones meet, as the blocks' key has the shard.
    keys = [shard] if shard else []
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # A new name for the vector: both sides may come of one table.
    left = q.withColumnRenamed("vector", "asked").withColumn("asked", F.slice("asked", 1, F.size("asked"))).withColumn("qid", F.col("qid").cast("long")).withColumn("p", block("qid", nq)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    right = v.withColumn("row_idx", F.col("row_idx").cast("long")).withColumn("r", block("row_idx", nv)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def of(t: pa.Table, kind) -> pa.Array:
        """The id, the one long, or the vector, the one list: the names of a cogroup's columns may be changed."""
        found = [c for c in t.columns if kind(c.type)]
        if not found:
            raise TypeError(f"no such column in {t.schema}")
        return found[0].combine_chunks()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "row_idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = Best(_matrix(of(a, pa.types.is_list))[1], top_k, metric)
        best.add(of(b, pa.types.is_int64).to_numpy(), _matrix(of(b, pa.types.is_list))[1])
        return pa.Table.from_batches([best.rows(of(a, pa.types.is_int64).to_numpy())])

    group = ["p", "r", *keys]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, HITS)


def softmaxed(v: Column) -> Column:
    """A vector as a distribution, for the js metric."""
    d = F.transform(v, lambda x: F.exp(x.cast("double")))
    return F.transform(d, lambda x: x / F.aggregate(d, F.lit(0.0), lambda a, y: a + y))


def centroids(vectors: DataFrame, cell: str = "cell") -> DataFrame:
    """Mean vector of each cell of ``vectors(cell, vector)``, by position."""
    flat = vectors.select(cell, F.posexplode("vector").alias("i", "x"))
    mean = flat.groupBy(cell, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def probe(queries: DataFrame, vectors: DataFrame, cells: DataFrame, nprobe: int, top_k: int, metric: str = "inner_product") -> DataFrame:
    """Approximate search: only the ``nprobe`` nearest cells of a query are read.

    ``vectors(row_idx, vector, cell)``, ``cells(cell, vector)``. Probing all cells is exact.
    """
    near = search(queries, cells.select(F.col("cell").cast("long").alias("row_idx"), "vector"), nprobe, metric)
    near = near.select("qid", F.col("row_idx").alias("near")).join(queries.select("qid", F.col("vector").alias("q")), "qid")
    # A frequent cell is split by adaptive execution; scores are computed by batch.
    pairs = near.join(vectors.select("row_idx", "vector", F.col("cell").cast("long").alias("near")), "near").filter("vector is not null")
    return top(scored(pairs.select("qid", "row_idx", "q", "vector"), metric), top_k)


def scored(pairs: DataFrame, metric: str = "inner_product") -> DataFrame:
    """``(qid, row_idx, score)`` of ``pairs(qid, row_idx, q, vector)``, row by row in Arrow batches."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {METRICS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, v = _matrix(b.column(2))[1], _matrix(b.column(3))[1]
                if metric == "inner_product":
                    s = np.einsum("ij,ij->i", q, v)
                else:
                    s = np.array([_scores(metric, x[None], y[None])[0, 0] for x, y in zip(q, v)]) if metric == "js" else -_distance(metric, np.abs(q - v))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["qid", "row_idx", "score"])

    return pairs.select(F.col("qid").cast("long"), F.col("row_idx").cast("long"), "q", "vector").mapInArrow(run, HITS)


def _distance(metric: str, d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=1) if metric == "l2" else d.sum(axis=1) if metric == "l1" else d.max(axis=1)


def train_cells(vectors: DataFrame, n_cells: int, sample: int = 100_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(vectors with cell, cells)`` by k-means fitted on at most about ``sample`` vectors; every vector is assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("features", array_to_vector(F.transform("vector", lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))))
    share = min(1.0, sample / max(1, data.count()))
    fit_on = data if share >= 1 else data.filter(F.pmod(F.xxhash64("row_idx"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = KMeans(k=n_cells, seed=seed, predictionCol="cell").fit(fit_on)
    cells = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, vector array<double>")
    return model.transform(data).drop("features"), cells


def int8_scale(vectors: DataFrame, quantile: float = 0.99) -> Column:
    """The clip of scalar quantisation as a literal: the quantile of the absolute elements, by a sketch of bounded size."""
    x = vectors.select(F.explode("vector").alias("x")).agg(F.approx_percentile(F.abs(F.col("x").cast("double")), quantile, 100_000).alias("s")).first()["s"]
    return F.lit(float(x) if x else 1.0)


def quantised(v: Column, scale: Column) -> Column:
    """Elements as integers -127 to 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / scale * 127.0))))


def parse_index_string(s: str) -> dict[str, object]:
    """Parts of an index description such as ``OPQ16_64,IVF256,PQ16x8fs`` or ``IVFauto,Flat``."""
    import re

    m = re.fullmatch(r"(?:(OPQ(?P<opq>\d+)_(?P<opq_dim>\d+)|PCAR(?P<pcar>\d+)),)?(?:IVF(?P<cells>\d+|auto),)?(?:(?P<flat>Flat)|PQ(?P<m>\d+)(?:x(?P<bits>\d+))?(?P<suffix>fsr|fs)?)", s)
    if not m:
        raise ValueError(f"index description {s!r} is not supported")
    return {k: (int(v) if v and v.isdigit() else v) for k, v in m.groupdict().items() if v is not None}


def product_codes(vectors: DataFrame, m: int, bits: int = 4, sample: int = 50_000, seed: int = 0) -> tuple[DataFrame, list[np.ndarray]]:
    """Product quantisation: ``(row_idx, code array<int>)`` and the codebook of each of m subspaces.

    Codebooks are fitted on at most about ``sample`` vectors; every vector is coded.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width = vectors.select(F.size("vector").alias("n")).first()["n"] // m
    share = min(1.0, sample / max(1, vectors.count()))
    fit_on = vectors if share >= 1 else vectors.filter(F.pmod(F.xxhash64("row_idx"), F.lit(1 << 20)) < int(share * (1 << 20)))
    books = []
    for j in range(m):
        part = fit_on.select(array_to_vector(F.transform(F.slice("vector", j * width + 1, width), lambda x: x.cast("double"))).alias("features"))
        books.append(np.array(KMeans(k=2**bits, seed=seed).fit(part).clusterCenters()))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # m * 2^bits * width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = _matrix(b.column(1))
            codes = [(((v[:, j * width : (j + 1) * width][:, None, :] - c[None]) ** 2).sum(axis=2)).argmin(axis=1) for j, c in enumerate(shared.value)] if len(at) else []
            lists = np.stack(codes, axis=1).tolist() if codes else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(lists, pa.list_(pa.int32()))], names=["row_idx", "code"])

    return vectors.select("row_idx", "vector").mapInArrow(run, "row_idx long, code array<int>"), books


def search_codes(queries: DataFrame, codes: DataFrame, books: list[np.ndarray], top_k: int) -> DataFrame:
    """Inner product of queries with coded vectors, by one table of partial products a query."""
    width = books[0].shape[1]
    step = max(1, QUERY_BYTES // (8 * sum(map(len, books))))  # queries whose tables fit in a broadcast
    kept = queries.filter("vector is not null").select("qid", "vector")
    n = kept.count()
    out = None
    for p in range(max(1, -(-n // step))):  # blocks of queries, each of a bounded size
        t = (kept if n <= step else kept.filter(F.pmod(F.xxhash64("qid"), F.lit(-(-n // step))) == p)).toArrow()
        if not t.num_rows:
            continue
        ids, q = t.column(0).to_numpy().astype(np.int64), _matrix(t.column(1).combine_chunks())[1]
        found = _search_codes_block(codes, ids, [q[:, j * width : (j + 1) * width] @ c.T for j, c in enumerate(books)], top_k)
        out = found if out is None else out.unionByName(found)
    return top(out, top_k) if out is not None else codes.sparkSession.createDataFrame([], HITS)


def _search_codes_block(codes: DataFrame, ids: np.ndarray, tables: list[np.ndarray], top_k: int) -> DataFrame:
    shared = codes.sparkSession.sparkContext.broadcast((ids, tables))  # at most QUERY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, parts = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            code = np.array(b.column(1).to_pylist(), dtype=np.int64)
            idx = b.column(0).to_numpy()
            s = sum(t[:, code[:, j]] for j, t in enumerate(parts))
            order = np.lexsort((np.broadcast_to(idx, s.shape), -np.round(s, 9)), axis=1)[:, :top_k]
            flat = np.take_along_axis(s, order, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])), pa.array(idx[order].reshape(-1)), pa.array(flat.reshape(-1))], names=["qid", "row_idx", "score"])

    return codes.mapInArrow(run, "qid long, row_idx long, score double")


def reranked(queries: DataFrame, vectors: DataFrame, hits: DataFrame, top_k: int, metric: str = "inner_product") -> DataFrame:
    """The best ``top_k`` of approximate hits by their exact scores."""
    both = hits.select("qid", "row_idx").join(vectors.select("row_idx", "vector"), "row_idx").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    return top(scored(both.filter("q is not null and vector is not null").select("qid", "row_idx", "q", "vector"), metric), top_k)
