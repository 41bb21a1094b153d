"""Problem 1: same or near-same records across splits, by winnowing fingerprints.

A record's query is fingerprinted on its bare characters and each of its answers on its own: of
every window of ``WINDOW`` rolling hashes of ``GRAM`` characters the smallest is selected,
so that two texts with ``GRAM + WINDOW - 1`` characters in common share a fingerprint. An answer
is one window, whatever its length, as only equal answers count: equal answers select the same
hash. Evaluation and training records are joined on the answers' fingerprints; where one is
frequent on both sides, on the pair of it and a word of the query's prefix: of its distinct words,
the rarest first, so many that two queries with a share of ``SHARE`` have one of them in common.
So a frequent answer alone brings no records together and no pair is lost, and the rest meets in
blocks. The fingerprints that two answers of a candidate pair have in common are chained where they are collinear and
the chain is extended; only a pair with an answer that it covers wholly on both sides is kept. Likewise the queries'
fingerprints are chained, extended by alignment at both ends and between the seeds, and the covered part of either
query is reported. The share of the queries' words is checked exactly.

Queries too short for a fingerprint (fewer than ``GRAM`` bare characters) are one fingerprint as
a whole. Null queries, null, empty and blank answers and answers of fewer than ten bare
characters bring no pair. Repeated rows of an id are one record. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.neardup import _summed
from lodestone.llm.text import bare_text, words
from lodestone.operators.pairs import BLOCK
from lodestone.session import materialize, table

GRAM = 8
WINDOW = 12
#: Pairs that an answer's seed may bring together on its own; beyond, a word of the query's prefix must agree too.
RARE = 4096
#: Counters by which words are ordered, rare ones first (4 MB); any order gives the same pairs.
COUNTERS = 1 << 20
SHARE = 0.6
LEAST = 10
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, place, hash)``: the selected rolling-hash minima of each text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not texts:
        return none
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(lens.sum())
    short = [(i, 0, xxhash.xxh3_64_intdigest(t)) for i, t in enumerate(texts) if 0 < len(t) < gram]
    owner = place = np.zeros(0, np.int64)
    h = np.zeros(0, np.uint64)
    if n >= gram:
        at, hs = _rolled(texts, lens, gram)
        who = np.repeat(np.arange(len(texts)), lens)
        ends = np.cumsum(lens)
        begin = (ends - lens)[who]
        good = at + gram <= ends[who]
        # The smallest of each window that lies within its text; texts with fewer hashes are one window.
        many = np.maximum(ends - lens, ends - gram - window + 1)[who]  # the last window's start
        starts = good & ((at <= many) | (at == begin))
        spread = np.lib.stride_tricks.sliding_window_view(np.concatenate([hs, np.full(window - 1, 2**64 - 1, np.uint64)]), window)
        inside = np.minimum(window, ends[who] - gram + 1 - at)
        first = np.flatnonzero(starts)
        view = np.where(np.arange(window)[None, :] < inside[first][:, None], spread[first], np.uint64(2**64 - 1))
        chosen = np.unique(first + np.argmin(view, axis=1))
        owner, place, h = who[chosen], chosen - begin[chosen], hs[chosen]
    if short:
        owner = np.concatenate([owner, [x[0] for x in short]]).astype(np.int64)
        place = np.concatenate([place, [x[1] for x in short]]).astype(np.int64)
        h = np.concatenate([h, np.array([x[2] for x in short], dtype=np.uint64)])
    return owner, place, h


def minima(answers: list[str], gram: int = LEAST) -> np.ndarray:
    """The smallest rolling hash of each bare answer, all of ``gram`` or more characters: its window is the whole.

    With it go the smallest hash of the answer's second half and its length, which equal answers
    have in common too, so that long answers which share a phrase aren't brought together.
    """
    if not answers:
        return np.zeros(0, np.uint64)
    lens = np.fromiter(map(len, answers), np.int64, len(answers))
    at, h = _rolled(answers, lens, gram)
    begins = np.cumsum(lens) - lens
    halves = np.stack([begins, begins + (lens - gram + 1) // 2], axis=1).reshape(-1)
    least = np.minimum.reduceat(h, halves).reshape(-1, 2)
    return _mix(np.minimum(least[:, 0], least[:, 1]) ^ _mix(least[:, 1] + lens.astype(np.uint64)))


def _rolled(texts: list[str], lens: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes at every place of the joined texts; the largest number where one would leave its text."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:n])])
    at = np.arange(n)
    ends = np.repeat(np.cumsum(lens), lens)
    h = np.full(n, 2**64 - 1, np.uint64)
    ok = at + gram <= ends
    h[ok] = _mix((total[at[ok] + gram] - total[at[ok]]) * inverse[at[ok]])
    return at, h


def chain(seeds: list[tuple[int, int]], gram: int = GRAM) -> list[tuple[int, int]]:
    """The longest chain of seeds ``(place in a, place in b)`` that rise in both."""
    seeds = sorted(set(seeds), key=lambda z: (z[0], -z[1]))
    ends: list[int] = []  # smallest last place in b of the chains of each length
    at: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, y) in enumerate(seeds):
        k = bisect.bisect_left(ends, y)
        if k:
            back[i] = at[k - 1]
        if k == len(ends):
            ends.append(y)
            at.append(i)
        else:
            ends[k], at[k] = y, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def aligned(a: str, b: str, seeds: list[tuple[int, int]], gram: int = GRAM) -> tuple[int, int]:
    """Characters of ``a`` and of ``b`` that the chain covers once it is extended by alignment.

    Seeds are widened as far as the texts agree; gaps between neighbours, and what is before the
    first and after the last, are aligned by their longest common subsequence.
    """
    links = chain(seeds, gram)
    if not links:
        return 0, 0
    spans: list[tuple[int, int, int]] = []
    for x, y in links:
        if spans and x < spans[-1][0] + spans[-1][2]:
            continue
        lo_x, lo_y = (spans[-1][0] + spans[-1][2], spans[-1][1] + spans[-1][2]) if spans else (0, 0)
        if y < lo_y or a[x : x + gram] != b[y : y + gram]:
            continue
        s = 0
        while x - s > lo_x and y - s > lo_y and a[x - s - 1] == b[y - s - 1]:
            s += 1
        n = gram
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
        spans.append((x - s, y - s, n + s))
    covered = sum(n for *_, n in spans)
    edges = [(0, 0), *((x + n, y + n) for x, y, n in spans)]
    nexts = [*((x, y) for x, y, _ in spans), (len(a), len(b))]
    for (x0, y0), (x1, y1) in zip(edges, nexts):
        covered += _common(a[x0:x1], b[y0:y1])
    return min(covered, len(a)), min(covered, len(b))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the places of ``a`` as the bits of one number."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").filter("id is not null and split is not null").select("id", "query", "answers", "split", "source_name")


def answer_seeds(df: DataFrame) -> DataFrame:
    """``(seed, id, train)``: the selected hash of each answer that is long enough to prove something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, bares = [], []
            for i, answers in enumerate(b.column(1).to_pylist()):
                for x in {bare_text(y) for y in answers or ()}:
                    if len(x) >= LEAST:
                        owner.append(i)
                        bares.append(x)
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(minima(bares).view(np.int64)), b.column(0).take(at), b.column(2).take(at)], names=["seed", "id", "train"])

    return df.select("id", "answers", (F.col("split") == "train").alias("train")).mapInArrow(run, "seed long, id string, train boolean")


def word_codes(query: str | None) -> np.ndarray:
    """Codes of the distinct words of a query."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(words(query))), np.uint64))


def prefix(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a query's words, so many that less than the share of them is left without one.

    Two queries with the share have at least that part of either's words in common, and so, both
    being in one order of all words, a word of both prefixes.
    """
    order = np.lexsort((codes, counts[(codes & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return codes[order[: len(codes) - math.ceil(SHARE * len(codes) - 1e-9) + 1]]


def word_counts(rec: DataFrame) -> np.ndarray:
    """How many queries the words of each counter occur in."""

    def slots(b: pa.RecordBatch) -> np.ndarray:
        codes = [word_codes(q) for q in b.column(0).to_pylist()]
        return (np.concatenate([np.zeros(0, np.uint64), *codes]) & np.uint64(COUNTERS - 1)).astype(np.int64)

    return _summed(rec.select("query"), COUNTERS, slots)


def with_query_words(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """``df(seed, id, train, query)`` with each seed joined to each word of the query's prefix."""
    shared = df.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix(word_codes(q), shared.value) for q in b.column(3).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            h = np.concatenate([np.zeros(0, np.uint64), *found])
            seed = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_mix(h ^ _mix(seed[owner])).view(np.int64)), b.column(1).take(at), b.column(2).take(at)], names=["seed", "id", "train"])

    return df.select("seed", "id", "train", "query").mapInArrow(run, "seed long, id string, train boolean")


def _crossed(s: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs ``(ev, tr)`` under common seeds; both sides of a frequent seed are cut into blocks, and each two blocks meet under a key of their own."""
    blocks = lambda n: F.expr(f"cast(ceil({n} / {BLOCK}) as int)")
    j = s.join(sizes.select("seed", blocks("nt").alias("bt"), blocks("ne").alias("be")), "seed")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    every = lambda n: F.expr(f"explode(sequence(0, {n} - 1))")
    tr = j.filter("train").select("seed", F.col("id").alias("tr"), own("bt").alias("p"), every("be").alias("q"))
    ev = j.filter("not train").select("seed", F.col("id").alias("ev"), every("bt").alias("p"), own("be").alias("q"))
    return ev.join(tr, ["seed", "p", "q"]).filter("ev <> tr").select("ev", "tr")


def _both(s: DataFrame) -> DataFrame:
    return s.groupBy("seed").agg(F.count_if("train").alias("nt"), F.count_if(~F.col("train")).alias("ne")).filter("nt > 0 and ne > 0")


def candidates(rec: DataFrame) -> DataFrame:
    """Distinct pairs ``(ev, tr)`` that share an answer's seed; where it is frequent, also a word of their prefixes."""
    s = materialize(answer_seeds(rec).distinct(), "seeds")
    sizes = materialize(_both(s), "sizes")
    rare = f"nt * ne <= {RARE}"
    few = _crossed(s, sizes.filter(rare))
    frequent = sizes.filter(f"not ({rare})").select("seed")
    if frequent.isEmpty():
        return few.distinct()
    hot = s.join(frequent, "seed", "left_semi")
    counts = word_counts(rec.join(hot.select("id").distinct(), "id", "left_semi"))
    named = hot.join(rec.select("id", "query"), "id")
    hot = materialize(with_query_words(named, counts).distinct(), "hotseeds")
    return few.unionByName(_crossed(hot, _both(hot))).distinct()


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """``(ev, tr, split, source_name, cover_ev, cover_tr, share, same)`` for each candidate pair.

    Share is that of the word sets; same says whether it is large enough and a long enough answer
    is common. The covers are the shares of the bare queries that the extended chain covers, 0
    where same is false.
    """
    rec = records(spark, d)
    pairs = materialize(candidates(rec), "pairs")
    ids = pairs.select(F.col("ev").alias("id")).unionByName(pairs.select(F.col("tr").alias("id"))).distinct()
    rec = materialize(rec.join(ids, "id", "left_semi"), "texts")
    e = rec.filter("split <> 'train'").select(F.col("id").alias("ev"), F.col("query").alias("qe"), F.col("answers").alias("ae"), "split", "source_name")
    t = rec.filter("split = 'train'").select(F.col("id").alias("tr"), F.col("query").alias("qt"), F.col("answers").alias("at"))
    j = pairs.join(e.distinct(), "ev").join(t.distinct(), "tr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qe, ae, qt, at = (b.column(i).to_pylist() for i in range(4, 8))
            sh = []
            for x, y in zip(qe, qt):
                p, q = set(words(x)), set(words(y))
                sh.append(len(p & q) / len(p | q) if p | q else 0.0)
            likely = [i for i, z in enumerate(sh) if z >= SHARE - 1e-12]
            # One call each: the answers of all likely pairs, then the queries of those with a common answer.
            sides = [[[z for z in map(bare_text, a[i] or ()) if len(z) >= LEAST] for i in likely] for a in (ae, at)]
            marks = [iter(_places([z for zs in side for z in zs])) for side in sides]
            same = [False] * len(sh)
            for i, fs, gs in zip(likely, *sides):
                pf, pg = ([next(m) for _ in zs] for zs, m in zip((fs, gs), marks))
                same[i] = any(whole(f, g, u, v) for f, u in zip(fs, pf) for g, v in zip(gs, pg))
            found = [i for i, z in enumerate(same) if z]
            xs, ys = ([bare_text(q[i]) for i in found] for q in (qe, qt))
            ce, ct = [0.0] * len(sh), [0.0] * len(sh)
            for i, x, y, u, v in zip(found, xs, ys, _places(xs), _places(ys)):
                m, n = (len(x), len(y)) if x == y else aligned(x, y, _seeds(u, v))
                ce[i] = m / len(x) if x else 0.0
                ct[i] = n / len(y) if y else 0.0
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(ce, pa.float64()), pa.array(ct, pa.float64()), pa.array(sh, pa.float64()), pa.array(same, pa.bool_())],
                names=["ev", "tr", "split", "source_name", "cover_ev", "cover_tr", "share", "same"],
            )

    shape = "ev string, tr string, split string, source_name string, cover_ev double, cover_tr double, share double, same boolean"
    return j.select("ev", "tr", "split", "source_name", "qe", "ae", "qt", "at").mapInArrow(run, shape)


def _places(texts: list[str]) -> list[dict[int, list[int]]]:
    """For each text the places of each of its fingerprints; of a run of the same fingerprint, as in a text that repeats itself, the first."""
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    last = (-1, 0)
    owner, place, h = winnow(texts)
    order = np.lexsort((place, owner))
    for o, p, x in zip(owner[order].tolist(), place[order].tolist(), h[order].tolist()):
        if (o, x) != last:
            out[o].setdefault(x, []).append(p)
        last = (o, x)
    return out


def _seeds(a: dict[int, list[int]], b: dict[int, list[int]]) -> list[tuple[int, int]]:
    return [(p, q) for h, ps in a.items() for p in ps for q in b.get(h, ())]


def whole(f: str, g: str, fs: dict[int, list[int]], gs: dict[int, list[int]]) -> bool:
    """Whether the extended chain of the fingerprints that two answers have in common covers both wholly, without a gap."""
    links = chain(_seeds(fs, gs)) if len(f) == len(g) else []
    return bool(links) and links[0][0] == links[0][1] and aligned(f, g, links[:1]) == (len(f), len(g)) and f == g


def _by_owner(texts: list[str]) -> list[dict[int, int]]:
    """For each text the place of each of its fingerprints."""
    out: list[dict[int, int]] = [{} for _ in texts]
    for o, p, h in zip(*(x.tolist() for x in winnow(texts))):
        out[o].setdefault(h, p)
    return out


def exact(found: DataFrame) -> DataFrame:
    return found.filter(F.col("same") & (F.col("share") >= SHARE - 1e-12))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids, exactly one of them in split train, with a share of words of 0.6 and a common answer."""
    return exact(overlaps(spark, d)).select(F.least("ev", "tr").alias("id_a"), F.greatest("ev", "tr").alias("id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation record: records that overlap, pairs, and mean coverage of the records."""
    best = exact(overlaps(spark, d)).groupBy("split", "source_name", "ev").agg(F.countDistinct("tr").alias("n"), F.max("cover_ev").alias("cover"))
    return best.groupBy("split", "source_name").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_pairs"), F.round(F.avg("cover"), 6).alias("mean_coverage"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation record: records that overlap, and pairs."""
    return p1_report(spark, d).select("split", "source_name", "n_records", "n_pairs")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_counts": p1_counts}

_BARE = "regexp_replace(lower(coalesce({}, '')), '[^\\pL\\pN]+', '', 'g')"
SQL = {
    "p1_found": f"""
      WITH r AS (SELECT DISTINCT id, query, answers, split FROM queries),
      a AS (SELECT DISTINCT id, split = 'train' AS tr, {_BARE.format('u.a')} AS b, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\pL\\pN]+'), lambda w: w <> '')) AS ws
            FROM r, unnest(answers) AS u(a) WHERE length({_BARE.format('u.a')}) >= {LEAST})
      SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM a x JOIN a y ON x.b = y.b AND x.tr AND NOT y.tr AND x.id <> y.id
      WHERE len(list_intersect(x.ws, y.ws)) >= 0.6 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) AND len(x.ws) > 0""",
    "p1_counts": f"""
      WITH r AS (SELECT DISTINCT id, query, answers, split, source_name FROM queries),
      a AS (SELECT DISTINCT id, split, source_name, {_BARE.format('u.a')} AS b, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\pL\\pN]+'), lambda w: w <> '')) AS ws
            FROM r, unnest(answers) AS u(a) WHERE length({_BARE.format('u.a')}) >= {LEAST}),
      p AS (SELECT DISTINCT y.split, y.source_name, y.id AS ev, x.id AS tr FROM a x JOIN a y ON x.b = y.b AND x.split = 'train' AND y.split <> 'train' AND x.id <> y.id
            WHERE len(list_intersect(x.ws, y.ws)) >= 0.6 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) AND len(x.ws) > 0)
      SELECT split, source_name, count(DISTINCT ev) AS n_records, count(*) AS n_pairs FROM p GROUP BY 1, 2""",
}
