"""Scores of BM25 by matrices: queries and texts as sparse rows over the terms asked for.

Terms that many queries and many texts have make up nearly all products; they are columns of a dense
product in single precision. The others are added term by term. All summands are positive, so the
error of such a score has a relative bound; what could be among the best k within that bound
is scored again in double precision, and no hit is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries, and texts, of one tile: 32 MB of scores.
QUERIES, TEXTS = 2048, 4096
#: Texts, and words of texts, that a task holds at once.
HELD_TEXTS, HELD_WORDS = 1 << 15, 1 << 22
#: A product costs as much by itself as this many in the dense product; columns of that product at most.
SINGLE, DENSE = 600, 1024
#: Products of one term in a tile from which it is added by itself.
ALONE = 256


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the slices that begin at ``start``, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def best(q: np.ndarray, idx: np.ndarray, score: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, in the order that the final rank has: by rounded score, then by number."""
    order = np.lexsort((idx, -np.round(score, 9), q))
    q, idx, score = q[order], idx[order], score[order]
    kept = slice(None) if k is None else np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], idx[kept], score[kept]


@dataclass(frozen=True)
class Rows:
    """A sparse matrix: row i has ``term`` and ``weight`` from ``ends[i]`` to ``ends[i + 1]``."""

    ends: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, at: np.ndarray) -> Rows:
        size = self.ends[at + 1] - self.ends[at]
        p = ragged(self.ends[at], size)
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.term[p], self.weight[p])

    def cut(self, a: int, b: int) -> Rows:
        b = min(b, len(self))
        s = slice(self.ends[a], self.ends[b])
        return Rows(self.ends[a : b + 1] - self.ends[a], self.term[s], self.weight[s])

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def dense(self, column: np.ndarray, n: int) -> np.ndarray:
        """As a matrix of the terms that have a column."""
        out, c = np.zeros((len(self), n), np.float32), column[self.term]
        has = c >= 0
        out[self.row()[has], c[has]] = self.weight[has]
        return out

    def others(self, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By term, of the terms that have no column: term, first place and number; then rows and weights in that order."""
        has = np.flatnonzero(column[self.term] < 0)
        has = has[np.argsort(self.term[has], kind="stable")]
        term, start, size = np.unique(self.term[has], return_index=True, return_counts=True)
        return term, start, size, np.stack([self.row()[has], has])


class Queries:
    """A block of queries: ``rows`` over ``vocabulary``, who searches all texts, and who those of a subset."""

    def __init__(self, t: pa.Table, wanted: pa.Table | None, bound: pa.Table | None, n: float, avgdl: float, k1: float, b: float) -> None:
        """``t(qid, term, qtf, df)``; ``wanted(qid, subset_id)`` of the filtered queries; ``bound(qid)`` are those that search nothing but that."""
        code = lambda c: c.combine_chunks().dictionary_encode("encode")
        q, term = code(t.column("qid")), code(t.column("term"))
        self.qid, self.vocabulary = q.dictionary, term.dictionary
        at, to = q.indices.to_numpy(), term.indices.to_numpy()
        df, qtf = (t.column(c).to_numpy().astype(np.float64) for c in ("df", "qtf"))
        order = np.lexsort((to, at))
        self.rows = Rows(np.searchsorted(at[order], np.arange(len(self.qid) + 1)), to[order], (qtf * np.log1p((n - df + 0.5) / (df + 0.5)))[order])
        self.avgdl, self.k1, self.b = avgdl, k1, b
        products = np.zeros(len(self.vocabulary))
        np.add.at(products, to, df)
        often = np.flatnonzero(products * SINGLE >= n * len(self.qid))
        often = often[np.argsort(-products[often], kind="stable")][:DENSE]
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.n_columns = len(often)
        # Each sum of n positive numbers in single precision is right to n + 2 roundings, each factor to one more.
        self.error = float((len(often) + np.diff(self.rows.ends).max(initial=0) + 8) * 2.0**-23)
        self.free = np.arange(len(self.qid))
        self.wanted: dict[str, np.ndarray] = {}
        if wanted is not None:
            self.free = np.flatnonzero(pc.invert(pc.is_in(self.qid, value_set=bound.column("qid").combine_chunks())).to_numpy(zero_copy_only=False))
            who = pc.index_in(wanted.column("qid").combine_chunks(), value_set=self.qid)
            subset = wanted.column("subset_id").combine_chunks().filter(who.is_valid()).dictionary_encode()
            who, by = who.drop_null().to_numpy(), subset.indices.to_numpy()
            self.wanted = {s: np.unique(who[by == i]) for i, s in enumerate(subset.dictionary.to_pylist())}


class Texts:
    """Texts that a task holds: ``(row_idx, dl, terms, tfs[, subset_ids])``, less the terms that nobody asks for."""

    def __init__(self, batches: list[pa.RecordBatch], q: Queries) -> None:
        idx, size, term, weight, self.subset, self.of = [], [], [], [], [], []
        held = 0
        for b in batches:
            words, tf, dl = b.column("terms"), b.column("tfs").flatten().to_numpy().astype(np.float64), b.column("dl").to_numpy().astype(np.float64)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            codes = words.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(codes.dictionary, value_set=q.vocabulary), -1).to_numpy(zero_copy_only=False)
            to = known[codes.indices.to_numpy()]
            asked = to >= 0
            row, to, tf = row[asked], to[asked], tf[asked]
            idx.append(b.column("row_idx").to_numpy())
            size.append(np.bincount(row, minlength=b.num_rows))
            term.append(to)
            weight.append(tf * (q.k1 + 1) / (tf + q.k1 * ((1 - q.b) + q.b * dl[row] / q.avgdl)))
            if q.wanted:
                sets = b.column("subset_ids")
                self.subset += sets.flatten().to_pylist()
                self.of.append(held + np.repeat(np.arange(b.num_rows), pc.list_value_length(sets).to_numpy(zero_copy_only=False)))
            held += b.num_rows
        self.idx = np.concatenate(idx)
        self.rows = Rows(np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(term), np.concatenate(weight))

    def of_subsets(self) -> Iterator[tuple[str, np.ndarray]]:
        if self.subset:
            code = pa.array(self.subset, pa.string()).dictionary_encode()
            by, of = code.indices.to_numpy(zero_copy_only=False), np.concatenate(self.of)
            for i, s in enumerate(code.dictionary.to_pylist()):
                yield s, of[by == i]


class Search:
    """The running best k of a block of queries; all hits, as they come, if k is null."""

    def __init__(self, q: Queries, k: int | None) -> None:
        self.q, self.k = q, k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        #: No score below it can be among the best k.
        self.least = np.zeros(len(q.qid))
        self.vector = np.zeros(len(q.vocabulary))

    def add(self, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s, at in t.of_subsets():
            if s in self.q.wanted:
                yield from self._scan(self.q.wanted[s], at, t)
        if self.k is None:
            yield from self._scan(self.q.free, np.arange(len(t.idx)), t)
            return
        for i in range(0, len(self.q.free), QUERIES):
            self._tiles(self.q.free[i : i + QUERIES], t)

    def _with(self, i: int) -> np.ndarray:
        """Weights of a query by term, in a vector that is used again and again."""
        s = slice(self.q.rows.ends[i], self.q.rows.ends[i + 1])
        self.vector[self.q.rows.term[s]] = self.q.rows.weight[s]
        return self.q.rows.term[s]

    def _scan(self, who: np.ndarray, at: np.ndarray, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each query against each of the texts, in double precision."""
        rows = t.rows.take(at)
        row, idx, parts = rows.row(), t.idx[at], []
        for i in who:
            terms = self._with(i)
            score = np.bincount(row, self.vector[rows.term] * rows.weight, len(at))
            self.vector[terms] = 0
            hit = np.flatnonzero(score > 0)
            if self.k is not None:
                low = self.least[i]
                if len(hit) > self.k:
                    low = max(low, np.partition(score, -self.k)[-self.k])
                hit = hit[score[hit] >= low - 1e-8]
            parts.append((np.full(len(hit), i), idx[hit], score[hit]))
            if self.k is None:
                yield parts.pop()
        if parts:
            self._settle(parts)

    def _tiles(self, who: np.ndarray, t: Texts) -> None:
        q, margin = self.q.rows.take(who), self.q.error
        dense, (terms, start, size, where) = q.dense(self.q.column, self.q.n_columns), q.others(self.q.column)
        parts, held = [], 0
        for j in range(0, len(t.idx), TEXTS):
            d = t.rows.cut(j, j + TEXTS)
            s = dense @ d.dense(self.q.column, self.q.n_columns).T
            terms_d, start_d, size_d, where_d = d.others(self.q.column)
            _, a, b = np.intersect1d(terms, terms_d, assume_unique=True, return_indices=True)
            alone = size[a] * size_d[b] >= ALONE
            for x, n, y, m in zip(start[a[alone]].tolist(), size[a[alone]].tolist(), start_d[b[alone]].tolist(), size_d[b[alone]].tolist()):
                (r, e), (c, f) = where[:, x : x + n], where_d[:, y : y + m]
                s[r[:, None], c] += (q.weight[e][:, None] * d.weight[f]).astype(np.float32)
            a, b = a[~alone], b[~alone]
            # The rest at once: each of a term's queries, and for it each of the term's texts.
            left = ragged(start[a], size[a])
            n = np.repeat(size_d[b], size[a])
            right = where_d[:, ragged(np.repeat(start_d[b], size[a]), n)]
            left = where[:, np.repeat(left, n)]
            np.add.at(s.reshape(-1), left[0] * s.shape[1] + right[0], (q.weight[left[1]] * d.weight[right[1]]).astype(np.float32))
            new = self.least[who] == 0
            if s.shape[1] > self.k and new.any():
                self.least[who[new]] = np.maximum(0, np.partition(s[new], -self.k, axis=1)[:, -self.k].astype(np.float64) * (1 - margin))
            low = (self.least[who] * (1 - margin)).astype(np.float32)
            hit = np.flatnonzero((s >= low[:, None]) & (s > 0))
            r, c = np.divmod(hit, s.shape[1])
            parts.append((who[r], j + c, s.reshape(-1)[hit]))
            held += len(hit)
            if held > 16 * self.k * len(who):
                self._settle(self._exact(parts, t))
                parts, held = [], 0
        self._settle(self._exact(parts, t))

    def _exact(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], t: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores in double precision of ``(query, text, score)``, less those that k others surely pass."""
        if not parts:
            return []
        who, at, near = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-near, who))
        who, at, near = who[order], at[order], near[order]
        last = np.searchsorted(who, who) + self.k - 1
        full = last < np.searchsorted(who, who, "right")
        low = np.where(full, near[np.minimum(last, len(who) - 1)] * (1 - 2 * self.q.error), 0) if len(who) else near
        who, at = who[near >= low], at[near >= low]
        found = []
        for i, x, n in zip(*np.unique(who, return_index=True, return_counts=True)):
            terms, of = self._with(i), at[x : x + n]
            size = t.rows.ends[of + 1] - t.rows.ends[of]
            p = ragged(t.rows.ends[of], size)
            score = np.bincount(np.repeat(np.arange(n), size), self.vector[t.rows.term[p]] * t.rows.weight[p], n)
            self.vector[terms] = 0
            found.append((np.full(n, i), t.idx[of], score))
        return found

    def _settle(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.found = best(*(np.concatenate(x) for x in zip(self.found, *parts)), self.k)
        who, n = np.unique(self.found[0], return_counts=True)
        full = n == self.k
        last = np.cumsum(n) - 1
        self.least[who[full]] = np.maximum(self.least[who[full]], self.found[2][last[full]] * (1 - 1e-9) - 1e-8)


def searched(batches: Iterator[pa.RecordBatch], q: Queries, k: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``(qid, row_idx, score)``: the best k of a task's texts for each query."""
    run, held, texts, words = Search(q, k), [], 0, 0

    def done() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for at, idx, score in run.add(Texts(held, q)):
            yield q.qid.take(pa.array(at)), idx, score

    for b in batches:
        if b.num_rows:
            held.append(b)
            texts, words = texts + b.num_rows, words + len(b.column("tfs").flatten())
        if texts >= HELD_TEXTS or words >= HELD_WORDS:
            yield from done()
            held, texts, words = [], 0, 0
    if held:
        yield from done()
    at, idx, score = run.found
    yield q.qid.take(pa.array(at)), idx, score
