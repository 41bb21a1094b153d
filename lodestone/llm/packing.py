"""Problem 7: filling containers of fixed capacity with items that aren't divided.

Method: the sizes' histogram (at most ``capacity`` + 1 numbers, whatever the table's size) is
gathered. Shallow combinations of at most three sizes that fill a window are enumerated on
``WINDOW`` units, non-negative least squares solves how often each is repeated so that the
histogram is met, and the repeats are rounded. What is left is packed greedily, largest size
first, with repeats. The plan so made has a number of patterns that the capacity bounds; the
items are numbered within their size by a distributed count and take their places from the
plan. No row is gathered, and no size, however frequent, is ranked by one task.

An item larger than the capacity is divided into full containers and a rest, and only the
rest shares a container. Items of size 0 (null and empty texts) are placed in container 0.
Equal texts of other ids are items of their own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import encoding
from lodestone.session import materialize, table

#: Units into which a capacity is divided for the combinations.
WINDOW = 128
#: Parts of the solved repeats that are tried.
PARTS = (1.0, 0.75, 0.5, 0.25, 0.1, 0.05)
#: Items of a size that one task numbers, about.
NUMBERED = 200_000


class PieceCounter(dict):
    """Number of tokens by a sentencepiece model; fragments are encoded once each.

    A space that follows anything else is a certain cut, as no piece has a word mark after
    another character; the model itself puts the mark before each fragment.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        assert not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        self.cut = re.compile("(?<=[^ ▁]) ")

    def __missing__(self, fragment: str) -> int:
        n = len(self.model.encode(fragment)) if fragment else 1
        if len(self) < encoding.KEPT:
            self[fragment] = n
        return n

    def counts(self, texts: list[str]) -> Iterator[int]:
        for t in texts:
            yield sum(map(self.__getitem__, self.cut.split(t))) if t else 0


_LOADED: dict[str, object] = {}


def counter(name: str):
    """The counter of a public tokenizer, made once per worker process."""
    if name not in _LOADED:
        path = f"{encoding.TOKENIZERS}/{name}"
        known = {"byte_bpe_50k": lambda: encoding.loaded(path + ".tiktoken"), "piece_bpe_32k": lambda: PieceCounter(path + ".model")}
        if name not in known:
            raise ValueError(f"no counter for the tokenizer {name}; known: {sorted(known)}")
        _LOADED[name] = known[name]()
    return _LOADED[name]


def token_sizes(df: DataFrame, ident: str, text: str, tokenizers: list[str]) -> DataFrame:
    """``(ident, <tokenizer> long, ...)``: the size of each text by each tokenizer; null has 0."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [pa.array(list(counter(n).counts(texts)), pa.int64()) for n in tokenizers]
            yield pa.RecordBatch.from_arrays([b.column(0), *sizes], names=[ident, *tokenizers])

    return df.select(ident, text).mapInArrow(run, ", ".join([f"`{ident}` {kind}", *(f"`{n}` long" for n in tokenizers)]))


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """``x >= 0`` that minimises ``|a x - b|``, by active sets on the normal equations."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    w = rhs.copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0.0)))
    for _ in range(most or 3 * a.shape[0]):
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), rhs[at])
            if (s > 0).all():
                break
            old = x[at]
            neg = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(neg, old / np.where(neg, old - s, 1.0), np.inf))
            x[at] = old + min(max(step, 0.0), 1.0) * (s - old)
            active[at[neg & (x[at] <= 1e-12)]] = False
            x[~active] = 0.0
            if not active.any():
                break
        at = np.flatnonzero(active)
        if len(at):
            x[at] = s[: len(at)] if len(s) == len(at) else x[at]
        w = rhs - gram @ x
    return x


@dataclass
class Plan:
    """Where the items of each size go.

    A segment ``(size, start, end, base, skip, per)`` says that the items of ``size`` with
    numbers start <= r < end are in container ``base + (skip + r - start) // per``.
    """

    containers: int = 0
    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def _combinations(units: int) -> list[tuple[int, ...]]:
    """All of one to three sizes, in falling order, that together are ``units``."""
    out: list[tuple[int, ...]] = [(units,)]
    for a in range(units - 1, 0, -1):
        rest = units - a
        if rest <= a:
            out.append((a, rest))
        out += [(a, b, rest - b) for b in range(min(a, rest - 1), 0, -1) if rest - b <= b]
    return out


def plan(histogram: np.ndarray, capacity: int, window: int = WINDOW) -> Plan:
    """Containers for ``histogram[s]`` items of size s, 0 <= s <= capacity.

    The repeats are solved for once, and used in full or in part, so that more is left for the greedy filling of
    the space that sizes rounded up to units waste: whichever takes the fewest containers.
    """
    units = min(window, capacity)
    unit_of = np.minimum(-(-np.arange(capacity + 1) * units // capacity), units)
    counts = np.bincount(unit_of[1:], weights=histogram[1:], minlength=units + 1)[1:]
    combos = [c for c in _combinations(units) if all(counts[q - 1] for q in c)]
    repeats = np.zeros(len(combos))
    if combos:
        a = np.zeros((units, len(combos)))
        for j, c in enumerate(combos):
            for q in c:
                a[q - 1, j] += 1
        repeats = nnls(a, counts)
    return min((_plan(histogram, capacity, unit_of, combos, part * repeats) for part in PARTS), key=lambda p: p.containers)


def _plan(histogram: np.ndarray, capacity: int, unit_of: np.ndarray, combos: list, repeats: np.ndarray) -> Plan:
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, dtype=np.int64)
    out = Plan()

    def take(size: int, n: int, base: int, skip: int, per: int) -> None:
        out.segments.append((size, int(taken[size]), int(taken[size]) + n, base, skip, per))
        taken[size] += n
        left[size] -= n

    if left[0]:
        take(0, int(left[0]), 0, 0, 1 << 62)
    if combos:
        x = np.floor(repeats + 1e-6).astype(np.int64)
        sizes = [[s for s in range(capacity, 0, -1) if unit_of[s] == q] for q in range(int(unit_of[-1]) + 1)]
        for j in np.argsort(-x, kind="stable"):
            c = combos[j]
            need = {q: c.count(q) for q in c}
            times = min([int(x[j]), *(int(sum(left[s] for s in sizes[q])) // k for q, k in need.items())])
            if times <= 0:
                continue
            for q, k in need.items():
                skip = 0
                for s in sizes[q]:
                    n = int(min(left[s], times * k - skip))
                    if n:
                        take(s, n, out.containers, skip, k)
                        skip += n
            out.containers += times
    # What is left: the largest size, then again the largest that fits; as often as the sizes last.
    there = [s for s in range(1, capacity + 1) if left[s]]
    while there:
        need: dict[int, int] = {}
        space = capacity
        while space:
            i = bisect.bisect_right(there, space) - 1
            while i >= 0 and left[there[i]] <= need.get(there[i], 0):
                i -= 1
            if i < 0:
                break
            s = there[i]
            k = min(space // s, int(left[s]) - need.get(s, 0))
            need[s] = need.get(s, 0) + k
            space -= k * s
        times = min(int(left[s]) // k for s, k in need.items())
        for s, k in need.items():
            take(s, times * k, out.containers, 0, k)
            if not left[s]:
                there.remove(s)
        out.containers += times
    if histogram[0] and not out.containers:
        out.containers = 1
    return out


def pack(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """``(group, id, part, n_tokens, container)`` for ``items(group, id, size)``.

    ``capacities`` gives each group's capacity: a driver-side parameter, as the plan is per
    capacity. Containers are numbered from 0 within a group: first those of rests and whole
    items, then those filled by parts of divided items.
    """
    spark = items.sparkSession
    if not capacities:
        return spark.createDataFrame([], "group long, id long, part long, n_tokens long, container long")
    cap = F.create_map(*[F.lit(x).cast("long") for kv in capacities.items() for x in kv])[F.col("group")]
    split = items.select(F.col("group").cast("long").alias("group"), "id", F.col("size").cast("long").alias("size"))
    split = split.withColumn("cap", cap.cast("long"))
    split = split.select("group", "id", "cap", F.expr("case when size > cap then (size - 1) div cap else 0 end").alias("full"), "size")
    split = split.withColumn("rest", F.col("size") - F.col("full") * F.col("cap"))
    total = max(1, split.count())
    salts = int(max(16, total // NUMBERED))
    rows = split.withColumn("salt", F.pmod(F.xxhash64("id", "group"), F.lit(salts)).cast("int"))
    # Counts by (group, size, salt) with map-side aggregation; their running sums number the items.
    counts = rows.groupBy("group", "rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full"))
    before = Window.partitionBy("group", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("group", "rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    by_salt = counts.groupBy("group", "salt").agg(F.sum("n_full").alias("n_full"))
    ahead = Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = by_salt.select("group", "salt", F.coalesce(F.sum("n_full").over(ahead), F.lit(0)).alias("of"))
    # At most capacity + 1 rows a group.
    plans = {g: np.zeros(c + 1, dtype=np.int64) for g, c in capacities.items()}
    for r in counts.groupBy("group", "rest").agg(F.sum("n").alias("n")).collect():
        plans[r["group"]][r["rest"]] = r["n"]
    made = {g: plan(h, capacities[g]) for g, h in plans.items()}
    lookup = {}
    for g, p in made.items():
        s = np.array(sorted(p.segments), dtype=np.int64).reshape(-1, 6)
        lookup[g] = (s[:, 0], s, p.containers)
    shared = spark.sparkContext.broadcast(lookup)  # its size is bounded by the capacities
    within = Window.partitionBy("group", "rest", "salt").orderBy("id")
    fulls = Window.partitionBy("group", "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        rows.withColumn("r", F.row_number().over(within) - 1)
        .join(offsets, ["group", "rest", "salt"])
        .withColumn("f", F.coalesce(F.sum("full").over(fulls), F.lit(0)))
        .join(full_offsets, ["group", "salt"])
        .select("group", "id", "rest", "full", "cap", (F.col("r") + F.col("o")).cast("long").alias("r"), (F.col("f") + F.col("of")).cast("long").alias("f"))
    )
    kind = items.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, rest, r, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 5, 6))
            at = np.zeros(len(g), dtype=np.int64)
            first_full = np.zeros(len(g), dtype=np.int64)
            for one in np.unique(g):
                keys, seg, n = shared.value[one]
                rows_ = np.flatnonzero(g == one)
                # Segments are in order of (size, start): one search on a joint key finds the last that starts at or before r.
                joint = keys * (1 << 40) + seg[:, 1]
                s = seg[np.searchsorted(joint, rest[rows_] * (1 << 40) + r[rows_], side="right") - 1]
                at[rows_] = s[:, 3] + (s[:, 4] + r[rows_] - s[:, 1]) // s[:, 5]
                first_full[rows_] = n + f[rows_]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(at), pa.array(first_full)],
                names=["group", "id", "rest", "full", "cap", "at", "first"],
            )

    placed = ranked.mapInArrow(place, f"group long, id {kind}, rest long, full long, cap long, at long, first long")
    parts = F.concat(
        F.expr("transform(case when full > 0 then sequence(0L, full - 1) else array() end, k -> struct(k as part, cap as n_tokens, first + k as container))"),
        F.array(F.struct(F.col("full").alias("part"), F.col("rest").alias("n_tokens"), F.col("at").alias("container"))),
    )
    return placed.select("group", "id", F.explode(parts).alias("p")).select("group", "id", "p.part", "p.n_tokens", "p.container")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container, or the containers, of each document for each budget."""
    budgets = table(spark, d, "budgets").collect()  # fixed: one row a capacity
    names = sorted({b["tokenizer"] for b in budgets})
    sizes = materialize(token_sizes(table(spark, d, "documents"), "doc_id", "text", names), "sizes")
    sized = F.array(*[F.struct(F.lit(b["budget_id"]).alias("group"), F.col(b["tokenizer"]).alias("size")) for b in budgets])
    items = sizes.select(F.col("doc_id").alias("id"), F.inline(sized)).select("group", "id", "size")
    packed = pack(items, {b["budget_id"]: b["max_tokens"] for b in budgets})
    return packed.select(F.col("group").alias("budget_id"), F.col("id").alias("doc_id"), "part", "n_tokens", "container")


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: documents placed, containers over their capacity, documents divided though they fit, and whether the containers are within 1 % of the lower bound."""
    packed = materialize(p7_containers(spark, d), "containers")
    budgets = table(spark, d, "budgets").select("budget_id", "max_tokens")
    loads = packed.groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("load")).join(F.broadcast(budgets), "budget_id")
    boxes = loads.groupBy("budget_id").agg(F.count_if(F.col("load") > F.col("max_tokens")).alias("n_overfull"), F.count(F.lit(1)).alias("n"), F.sum("load").alias("t"), F.first("max_tokens").alias("m"))
    docs = packed.groupBy("budget_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("t")).join(F.broadcast(budgets), "budget_id")
    docs = docs.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("max_tokens"))).alias("n_divided"))
    close = F.col("n") <= F.ceil(F.col("t") / F.col("m")) * 1.01 + 1
    return boxes.join(docs, "budget_id").select("budget_id", "n_docs", "n_overfull", "n_divided", close.alias("near_bound"))


QUERIES = {"p7_containers": p7_containers, "p7_valid": p7_valid}
#: What must hold of any packing, as rows.
SQL = {"p7_valid": "SELECT budget_id, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS n_overfull, 0::BIGINT AS n_divided, true AS near_bound FROM budgets"}
