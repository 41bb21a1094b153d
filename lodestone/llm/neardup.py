"""Problem 2: near-duplicate records with small edits, by a generalised pigeonhole join.

A record is the set of its runs of three consecutive words (its bits). Texts that are equal
as word sequences are one class first. In each class's text, anchors are taken: the runs whose
hashes are the ``PARTITIONS`` smallest, so that similar texts take mostly the same. The bits around
an anchor, which an edit hits together, make a partition. A partition has a threshold: -1
(not looked at), 0 (all of its eleven words must agree), or 1 (one of its two halves may be hit:
by the pigeonhole principle the other half agrees).

The thresholds t are allocated for each text by dynamic programming, so that the sum of (t + 1) is
``BUDGET`` and the estimated number of candidates is least. That takes whole partitions mostly, which
find texts with few or clustered edits. On top, the first partitions are raised to 1 where
their halves are rare, which finds texts with edits everywhere; how many follows from the share
(``demand``). The estimates come from a table of counters over all texts, whose
size is bounded and set by their number. Partitions probed under a common signature give candidate
pairs, which are verified on their whole texts by the exact share.

The anchors are a sample of each text's bits, so the guarantee is one of probability: the recall
against brute force is measured in the tests and stated in the README by kind and length. With
``exhaustive`` every signature of every anchor of every run is probed, whatever its cost.
Signatures whose counter is small are grouped (the counter is an upper bound of the group),
the others meet in blocks; none is dropped.

Null titles and contents are blank; records without a word belong to no pair, and texts of one
or two words are in pairs with equal ones only. Repeated rows of an id are one record. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.pairs import BLOCK, pairs_within
from lodestone.session import materialize, table

SHARE = 0.6
PARTITIONS = 20
#: Sum of (t + 1) over a text's partitions.
BUDGET = 14
#: Chance that a pair of the least share whose edits are spread evenly is missed.
MISS = 0.0125
#: Anchors of the exhaustive way: all runs.
EVERY_RUN = 1 << 30
#: Words before an anchor's run and after it that belong to its partition.
REACH = 4
#: Values that a byte stands for in the table of counters.
LEVELS = np.concatenate([np.arange(65.0), 64.0 * 1.1 ** np.arange(1, 192)])
#: Logarithm of the largest number of counters (32 MB of bytes), and counters for each text below that.
COUNTERS, PER_TEXT = 25, 16
#: Halves of up to so many texts cost next to nothing.
FEW = 8.0
#: Counters that are summed and sent together.
CHUNK = 1 << 12
#: Logarithm of the largest bit table that is broadcast (8 MB).
BITS = 26
#: Sizes, in distinct runs, are in classes by this logarithm; texts whose classes are farther apart than this can't have the share.
CLASS = math.log(1.1)
APART = math.ceil(-math.log(SHARE) / CLASS) + 1
GAPS = re.compile(r"[\W_]+")
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    def __missing__(self, w: str) -> int:
        c = xxhash.xxh3_64_intdigest(w)
        if len(self) > 1_000_000:
            self.clear()
        self[w] = c
        return c


_CODES = WordCodes()


def distinct_runs(owner: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """Number of distinct runs of each of ``count`` texts, by as many bits of their hashes as are left beside the owner."""
    low = np.uint64(64 - max(1, count.bit_length()))
    k = np.sort((owner.astype(np.uint64) << low) | (h >> (np.uint64(64) - low)))
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    return np.bincount((k[new] >> low).astype(np.int64), minlength=count)


def _runs(texts: list[str]):
    """Of texts of words with one space between: ends, begins, numbers of runs, places and owners of the runs, and a hash of any words."""
    flat = " ".join(texts).split(" ")
    lens = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    c = np.fromiter(map(_CODES.__getitem__, flat), np.uint64, len(flat))
    ends = np.cumsum(lens)
    n = len(c)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE_INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:n])])
    run = lambda a, b: _mix((total[b] - total[a]) * inverse[a])
    at = np.arange(max(0, n - 2))
    owner = np.repeat(np.arange(len(texts)), lens)[: n - 2] if n > 2 else at
    good = at + 2 < ends[owner]
    return ends, ends - lens, np.maximum(lens - 2, 0), at[good], owner[good], run


def partitions(texts: list[str], m: int = PARTITIONS, reach: int = REACH, sized: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of words with one space between: owner, signatures (whole, left, right) of each partition; and sizes.

    Sizes are numbers of runs with their repeats, or where ``sized`` of distinct runs, which the share is of.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)
    ends, begins, sizes, at, owner, run = _runs(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.uint64), sizes
    h = run(at, at + 3)
    # Most runs can't be among the smallest: only those under three times the expected limit are ordered.
    limit = np.minimum(1.0, 3.0 * m / np.maximum(sizes, 1))[owner]
    low = h < (limit * 1.8446744073709550e19).astype(np.uint64)
    low |= limit >= 1.0
    enough = np.bincount(owner[low], minlength=len(texts)) >= np.minimum(2 * m, sizes)
    low |= ~enough[owner]
    runs = sizes
    if sized:
        sizes = distinct_runs(owner, h, len(texts))

    def smallest(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, o, x = at[low], owner[low], h[low]
        order = np.lexsort((x, o))
        a, o, x = a[order], o[order], x[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
        return a[new], o[new]

    first_at, first_owner = smallest(low)
    # Where repeats leave fewer than m distinct ones, all of that text's runs are ordered.
    few = (np.bincount(first_owner, minlength=len(texts)) < m) & (np.bincount(owner[low], minlength=len(texts)) < runs)
    at, owner = smallest(low | few[owner]) if few.any() else (first_at, first_owner)
    first = np.searchsorted(owner, np.arange(len(texts)))
    keep = np.arange(len(at)) - first[owner] < m
    at, owner = at[keep], owner[keep]
    a, b = np.maximum(at - reach, begins[owner]), np.minimum(at + 3 + reach, ends[owner])
    return owner, np.stack([run(a, b), run(a, at + 3), run(at, b)] if m < EVERY_RUN else [run(at, at + 3)] * 3, axis=1), sizes


def demand(share: float, miss: float = MISS) -> int:
    """How many partitions are raised to threshold 1.

    Of two texts with just that share an anchor is common with the chance of the share; where their
    edits are spread evenly, the worst case, one of the halves around a common anchor is free of them.
    """
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - share))))


def allocate(owner: np.ndarray, cost0: np.ndarray, cost1: np.ndarray, count: int, m: int = PARTITIONS, budget: int = 14) -> np.ndarray:
    """Thresholds of the partitions: for each owner the sum of (t + 1) is the budget at the least cost.

    Exact dynamic programming over the partitions of all owners at once. A threshold of infinite
    cost isn't taken; where the budget can't be spent, as much of it as can be is. Of equal
    costs the first partitions are taken.
    """
    first = np.searchsorted(owner, np.arange(count))
    k = np.arange(len(owner)) - first[owner]
    c = np.full((m, count, 2), np.inf, dtype=np.float32)
    c[k, owner, 0], c[k, owner, 1] = cost0, cost1
    rest = np.full((count, budget + 1), np.inf, dtype=np.float32)
    rest[:, 0] = 0.0
    picks = np.zeros((m, count, budget + 1), dtype=np.int8)
    for i in range(m - 1, -1, -1):  # rest: least cost of spending so much on the partitions from i on
        now = rest.copy()
        for t in (1, 2):
            if t > budget:
                continue
            moved = rest[:, : budget + 1 - t] + c[i, :, t - 1][:, None]
            better = (moved <= now[:, t:]) & np.isfinite(moved)
            now[:, t:][better] = moved[better]
            picks[i][:, t:][better] = t
        rest = now
    out = np.full((count, m), -1, dtype=np.int8)
    left = budget - np.argmax(np.isfinite(rest[:, ::-1]), axis=1)
    rows = np.arange(count)
    for i in range(m):
        t = picks[i][rows, left]
        out[:, i] = t - 1
        left = left - t
    return out[owner, k]


def _summed(parts: DataFrame, width: int, slots) -> np.ndarray:
    """How often each of ``width`` slots occurs, as places in ``LEVELS`` (rounded up); ``slots`` gives those of a batch.

    A task sends the chunks of counters that its rows hit, compressed: in proportion to its rows. They are
    added in the order of their chunks, one at a time, so that no task holds more than one sum.
    """
    chunk = min(width, CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.uint32)
        for b in batches:
            at, n = np.unique(slots(b), return_counts=True)
            total[at] += n.astype(np.uint32)
        hit = np.flatnonzero(total.reshape(-1, chunk).any(axis=1))
        for some in np.array_split(hit, max(1, len(hit) // 1024)):
            data = [zlib.compress(total[i * chunk : (i + 1) * chunk].tobytes(), 1) for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(chunk, dtype=np.int64)
        done: list[tuple[int, bytes]] = []
        level = lambda: zlib.compress(np.searchsorted(LEVELS, np.minimum(total, LEVELS[-1])).astype(np.uint8).tobytes(), 6)
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                if p != last and last is not None:
                    done.append((last, level()))
                    total[:] = 0
                last = p
                total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)
        if last is not None:
            done.append((last, level()))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], names=["part", "data"])

    sent = parts.mapInArrow(run, "part int, data binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros(width, dtype=np.uint8)
    for r in sent.mapInArrow(add, "part int, data binary").collect():  # at most width bytes
        out[r["part"] * chunk : (r["part"] + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(r["data"])), dtype=np.uint8)
    return out


def counters(texts: DataFrame, width: int, m: int = PARTITIONS) -> np.ndarray:
    """How often the signatures of each counter occur in all texts."""

    def slots(b: pa.RecordBatch) -> np.ndarray:
        _, sig, _ = partitions(b.column(0).to_pylist(), m)
        return (sig.reshape(-1) & np.uint64(width - 1)).astype(np.int64)

    return _summed(texts.select("text"), width, slots)


def only_paired(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that may be in a pair, by a bit table of at most ``BITS`` bits: others don't travel.

    Where the table is too small for the pairs it lets more texts pass, and none is lost.
    """
    width = 1 << min(BITS, max(16, math.ceil(math.log2(16 * max(1, pairs.count())))))
    found = _summed(pairs.select("ha", "hb"), width, lambda b: np.concatenate([c.to_numpy() & (width - 1) for c in b.columns]))
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(found > 0))

    @F.pandas_udf("boolean")
    def paired(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (width - 1)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 > 0)

    return texts.filter(paired("h"))


def signatures(texts: DataFrame, counts: np.ndarray, cold: int, few: float, share: float = SHARE, exhaustive: bool = False) -> DataFrame:
    """``(sig, h)``: what each text is probed under; the lowest ten bits of sig are its side and the class of its size.

    The texts of a signature with more than ``cold`` by its counter are in blocks, and for every two
    blocks p <= q there is a signature of its own, under which the texts of p (side 1) meet
    those of q (side 2). Otherwise, and within a block, all meet (side 0).
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # a byte a counter: of bounded size
    mask = np.uint64(len(counts) - 1)
    budget = demand(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            owner, sig, sizes = partitions(b.column(1).to_pylist(), EVERY_RUN if exhaustive else PARTITIONS, sized=True)
            seen = LEVELS[table_[(sig & mask).astype(np.int64)]]
            # A signature that no other text can have, as its counter says, is looked at for nothing: it isn't sent.
            shared_by = seen > 1
            if exhaustive:
                keep = shared_by
            else:
                cost0 = np.where(shared_by[:, 0], seen[:, 0], np.inf)
                cost1 = np.where(shared_by[:, 1:].any(axis=1), seen.sum(axis=1), np.inf)
                t = allocate(owner, cost0, cost1, len(h), PARTITIONS, BUDGET)
                # The first partitions, which similar texts have in common, are raised where their halves cost next to nothing.
                k = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(h)))[owner]
                raised = (k < budget)[:, None] & (seen[:, 1:] <= few)
                keep = np.concatenate([(t >= 0)[:, None], (t >= 1)[:, None] | raised], axis=1) & shared_by
            who = np.repeat(owner, 3).reshape(-1, 3)[keep]
            s, est = sig[keep], seen[keep]
            order = np.lexsort((s, who))
            who, s, est = who[order], s[order], est[order]
            new = np.ones(len(who), dtype=bool)
            new[1:] = (who[1:] != who[:-1]) | (s[1:] != s[:-1])
            who, s, est = who[new], s[new], est[new]
            size = np.minimum(np.log(np.maximum(sizes[who], 1)) / CLASS, 255).astype(np.uint64)
            x, side = h[who], np.zeros(len(who), np.uint64)
            hot = est > cold
            if hot.any():
                more = [_blocks(a, b, int(math.ceil(c / BLOCK))) for a, b, c in zip(s[hot], x[hot], est[hot])]
                times = [len(m) for m in more]
                flat = np.array([y for m in more for y in m], dtype=np.uint64).reshape(-1, 2)
                s = np.concatenate([s[~hot], flat[:, 0]])
                side = np.concatenate([side[~hot], flat[:, 1]])
                x, size = (np.concatenate([y[~hot], np.repeat(y[hot], times)]) for y in (x, size))
            key = (s & ~np.uint64(1023)) | (side << np.uint64(8)) | size
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x)], names=["sig", "h"])

    return texts.select("h", "text").mapInArrow(run, "sig long, h long")


def _blocks(sig: np.uint64, h: np.int64, n: int) -> list[tuple[int, int]]:
    """The signatures of a text's block with each block, and its side there."""
    own = int(h) % n
    out = []
    for other in range(n):
        p, q = min(own, other), max(own, other)
        out.append((xxhash.xxh3_64_intdigest(f"{sig}:{p}:{q}"), 0 if p == q else 1 if own == p else 2))
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows with the same signature, which follow each other; a group may go on in the next batch."""
    sig = h = meta = np.zeros(0, np.int64)
    for b in _and_end(batches):
        if b is not None:
            key = b.column(0).to_numpy()
            sig = np.concatenate([sig, key >> 10])
            meta = np.concatenate([meta, key & 1023])
            h = np.concatenate([h, b.column(1).to_numpy()])
            upto = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
        else:
            upto = len(sig)
        s, x, m = sig[:upto], h[:upto], meta[:upto]
        sig, h, meta = sig[upto:], h[upto:], meta[upto:]
        n, side = m & 255, m >> 8
        at = np.arange(len(s))
        step = 1
        while True:
            at = at[at + step < len(s)]
            at = at[s[at] == s[at + step]]
            if not len(at):
                break
            to = at + step
            ok = (np.abs(n[at] - n[to]) <= APART) & (x[at] != x[to]) & ((side[at] != side[to]) | (side[at] == 0))
            if ok.any():
                p, q = x[at[ok]], x[to[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["ha", "hb"])
            step += 1


def _and_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def candidates(sigs: DataFrame) -> DataFrame:
    """Distinct pairs ``(ha, hb)``, ha < hb, of texts with a common signature and sizes that allow the share."""
    met = sigs.repartition(F.shiftright("sig", 10)).sortWithinPartitions("sig")
    return met.mapInArrow(_pairs, "ha long, hb long").distinct()


def share_of(a: str, b: str) -> float:
    """Share of the two sets of runs of three words; of texts too short for any, 0."""
    x, y = a.split(" "), b.split(" ")
    p, q = set(zip(x, x[1:], x[2:])), set(zip(y, y[1:], y[2:]))
    return len(p & q) / len(p | q) if p or q else 0.0


def verified(pairs: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs ``(ka, kb)`` whose share is large enough, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = y = None
        sy: set[str] = set()
        q: set[tuple[str, str, str]] = set()
        for b in batches:
            ka, kb, ta, tb = (b.column(i) for i in range(4))
            ok = []
            for i, (one, two) in enumerate(zip(ta.to_pylist(), tb.to_pylist())):
                if two != last:  # rows come in the order of the second text
                    last, y = two, two.split(" ")
                    sy, q = set(y), set()
                x = one.split(" ")
                sx = set(x)
                # Each word that only one text has, but for the last two, starts a run that the other lacks.
                m, n = max(0, len(sx - sy) - 2), max(0, len(sy - sx) - 2)
                most = min(len(x) - 2 - m, len(y) - 2 - n)
                if most < share * (most + m + n) - 1e-9:
                    continue
                p = set(zip(x, x[1:], x[2:]))
                q = q or set(zip(y, y[1:], y[2:]))
                both = len(p & q)
                if both and both >= share * (len(p) + len(q) - both) - 1e-9:
                    ok.append(i)
            at = pa.array(ok, pa.int32())
            yield pa.RecordBatch.from_arrays([ka.take(at), kb.take(at)], names=["ka", "kb"])

    # One exchange of the texts serves both sides of a pair; equal texts are dropped behind it.
    t = texts.select("h", "key", "text").repartition("h").dropDuplicates(["h", "key"])
    j = pairs.join(t.select(F.col("h").alias("ha"), F.col("key").alias("ka"), F.col("text").alias("ta")), "ha")
    j = j.join(t.select(F.col("h").alias("hb"), F.col("key").alias("kb"), F.col("text").alias("tb")), "hb")
    return j.select("ka", "kb", "ta", "tb").mapInArrow(run, "ka binary, kb binary")


def classes(records: DataFrame) -> DataFrame:
    """``(id, key, h, text)`` of ``records(id, title, content)`` that have a word: text in words, and its 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [GAPS.sub(" ", f"{t} {c or ''}".lower() if t else (c or "").lower()).strip() for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            at = [i for i, t in enumerate(texts) if t]
            keys = [xxhash.xxh3_128_digest(texts[i]) for i in at]
            h = np.frombuffer(b"".join(keys), dtype=np.int64)[::2] if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(keys, pa.binary()), pa.array(h), pa.array([texts[i] for i in at], pa.string())], names=["id", "key", "h", "text"])

    return materialize(records.filter("id is not null").select("id", "title", "content").mapInArrow(run, "id string, key binary, h long, text string"), "texts")


def similar_classes(texts: DataFrame, share: float = SHARE, exhaustive: bool = False) -> DataFrame:
    """Pairs ``(ka, kb)`` of classes with different texts whose share is large enough."""
    n = texts.count()
    # Counters in proportion to the texts, so that unrelated signatures add about as much to one at any size. From
    # the bound on they add more: costs below that noise count alike.
    width = 1 << min(COUNTERS, max(10, math.ceil(math.log2(max(1, PER_TEXT * n)))))
    counts = counters(texts, width, EVERY_RUN if exhaustive else PARTITIONS)
    noise = float(LEVELS[counts].mean())
    sigs = signatures(texts, counts, max(BLOCK, int(4 * noise)), max(FEW, 2 * noise), share, exhaustive)
    pairs = materialize(candidates(sigs), "pairs")
    return verified(pairs, only_paired(texts.select("h", "key", "text"), pairs), share)


def near_pairs(records: DataFrame, share: float = SHARE, exhaustive: bool = False) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of ``records(id, title, content)``, id_a < id_b, with a share of at least ``share`` (no less than SHARE) or equal words."""
    texts = classes(records)
    members = texts.select("key", "id").distinct()
    links = similar_classes(texts, share, exhaustive)
    a = members.select(F.col("key").alias("ka"), F.col("id").alias("x"))
    b = members.select(F.col("key").alias("kb"), F.col("id").alias("y"))
    across = links.join(a, "ka").join(b, "kb").filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return across.unionByName(pairs_within(members, "key", "id").select("id_a", "id_b")).distinct()


def components(nodes: DataFrame, links: DataFrame, most: int = 60) -> DataFrame:
    """``(node, label)``: the smallest node of each node's component; ``links(a, b)``.

    Alternating large-star and small-star steps, each written to the shared folder, until
    nothing changes; the number of rounds grows with the logarithm of a component's size.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = (state["n"], state["s"])
    else:
        raise RuntimeError(f"components not settled within {most} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def section_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").filter(~F.coalesce("deleted", F.lit(False)))
    return s.select("id", "title", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(section_records(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each section id: its group (the smallest text key of its component) and the number of texts linked to its own."""
    texts = classes(section_records(spark, d))
    members = texts.select("key", "id").distinct()
    links = materialize(similar_classes(texts), "links")
    label = components(members.select(F.col("key").alias("node")).distinct(), links.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    degree = links.select(F.col("ka").alias("node")).unionByName(links.select(F.col("kb").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = label.join(degree, "node", "left").select(F.col("node").alias("key"), F.lower(F.hex("label")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "key").select("id", "group_id", "n_links")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

_TEXT = "array_to_string(list_filter(regexp_split_to_array(lower(CASE WHEN coalesce(title, '') <> '' THEN title || ' ' ELSE '' END || coalesce(content, '')), '[^\\pL\\pN]+'), lambda w: w <> ''), ' ')"
SQL = {
    # Brute force: every two texts with a common run are compared.
    "p2_found": f"""
      WITH r AS (SELECT DISTINCT id, {_TEXT} AS t FROM sections WHERE id IS NOT NULL AND NOT coalesce(deleted, false)),
      c AS (SELECT t, row_number() OVER (ORDER BY t) AS k, string_split(t, ' ') AS w FROM (SELECT DISTINCT t FROM r WHERE t <> '')),
      g AS (SELECT DISTINCT k, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
      n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
      b AS (SELECT x.k AS ka, y.k AS kb, count(*) AS both_ FROM g x JOIN g y ON x.h = y.h AND x.k < y.k GROUP BY 1, 2),
      l AS (SELECT ka, kb FROM b JOIN n p ON p.k = ka JOIN n q ON q.k = kb WHERE both_ >= {SHARE} * (p.n + q.n - both_) - 1e-9),
      m AS (SELECT id, k FROM r JOIN c USING (t))
      SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b
      FROM (SELECT ka, kb FROM l UNION ALL SELECT k, k FROM c) p JOIN m x ON x.k = p.ka JOIN m y ON y.k = p.kb WHERE x.id <> y.id""",
}
