"""BM25 scores of blocks of documents against blocks of queries, in numpy inside Spark tasks.

A task gets the hits of its documents, ``(docno, term number, tf, dl)``, those of a
document together. A block of documents times a block of queries is one matrix of scores:
terms of many queries are multiplied as a matrix, the others go by lists of the
queries that have them. So no row for a (query, document, term) or a (query,
document) is made, and of every query only the best k rows of a task leave it.

Memory: a block of scores has ``DOCS`` x ``QUERIES`` numbers, and a task holds at
most about twice k rows a query, or ``HELD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 -- pa.compute

DOCS, QUERIES = 1024, 512
#: A term is a row of the matrix if at least one in so many queries of a block has it.
SHARE = 16
#: Rows that a task holds before it lets go of what cannot be among the best.
HELD = 1 << 19


def k3_weight(k3: float, qtf: np.ndarray) -> np.ndarray:
    return (k3 + 1) * qtf / (k3 + qtf)


def document_part(k1: float, b: float, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return (k1 + 1) * tf / (k1 * ((1.0 - b) + b * dl / avgdl) + tf)


class Queries:
    """A block of queries: their numbers are ``lo`` to ``lo + n``; ``term``, ``idf``, ``qtf`` belong to query ``at``."""

    def __init__(self, lo: int, n: int, at: np.ndarray, term: np.ndarray, idf: np.ndarray, qtf: np.ndarray, k3s):
        self.lo, self.n = lo, n
        order = np.argsort(term, kind="stable")
        self.terms, t, size = np.unique(term[order], return_inverse=True, return_counts=True)
        often = size * SHARE >= n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.columns = int(often.sum())
        self.start, self.size, self.of = np.cumsum(size) - size, size, at[order] - lo
        dense = often[t]
        self.rows = order, dense, self.column[t[dense]], self.of[dense]
        self.has = np.zeros((self.columns, n), np.float32)
        self.has[self.rows[2:]] = 1
        self.lists, self.matrices = [], []
        for k3 in k3s:
            self.weigh(idf * k3_weight(k3, qtf))

    def weigh(self, w: np.ndarray) -> None:
        """One more matrix, from the rows' weights."""
        order, dense, *cells = self.rows
        m = np.zeros((self.columns, self.n))
        m[tuple(cells)] = w[order][dense]
        self.lists.append(w[order])
        self.matrices.append(m)

    def meet(self, row: np.ndarray, term: np.ndarray, docs: int) -> Meeting:
        return Meeting(self, row, term, docs)


class Meeting:
    """What a block of queries and a block of documents have in common."""

    def __init__(self, queries: Queries, row: np.ndarray, term: np.ndarray, docs: int):
        self.queries, self.docs = queries, docs
        t = np.minimum(np.searchsorted(queries.terms, term), len(queries.terms) - 1)
        hit = queries.terms[t] == term
        column = queries.column[t]
        self.dense, self.few = np.flatnonzero(hit & (column >= 0)), np.flatnonzero(hit & (column < 0))
        self.cell = row[self.dense] * queries.columns + column[self.dense]
        t = t[self.few]
        size = queries.size[t]
        self.rep = np.repeat(self.few, size)
        self.pos = np.arange(len(self.rep)) - np.repeat(np.cumsum(size) - size - queries.start[t], size)
        self.flat = row[self.rep] * queries.n + queries.of[self.pos]

    def matrix(self, own: np.ndarray) -> np.ndarray:
        """The document parts ``own`` of the frequent terms, a document a row."""
        return np.bincount(self.cell, weights=own[self.dense], minlength=self.docs * self.queries.columns).reshape(self.docs, self.queries.columns)

    def scores(self, own: np.ndarray, matrix: np.ndarray, which: int) -> np.ndarray:
        out = matrix @ self.queries.matrices[which]
        if len(self.flat):
            out += np.bincount(self.flat, weights=own[self.rep] * self.queries.lists[which][self.pos], minlength=out.size).reshape(out.shape)
        return out

    def common(self) -> np.ndarray:
        """Whether document and query have a term in common."""
        a = np.zeros((self.docs, self.queries.columns), np.float32)
        a.reshape(-1)[self.cell] = 1
        out = a @ self.queries.has > 0
        out.reshape(-1)[self.flat] = True
        return out


def query_blocks(n: int, at: np.ndarray, term: np.ndarray, idf: np.ndarray, qtf: np.ndarray, k3s) -> list[Queries]:
    """Blocks of ``n`` queries; the rows are ordered by query."""
    out = []
    for lo in range(0, n, QUERIES):
        rows = slice(*np.searchsorted(at, (lo, lo + QUERIES)))
        out.append(Queries(lo, min(QUERIES, n - lo), at[rows], term[rows], idf[rows], qtf[rows], k3s))
    return out


def document_blocks(batches):
    """``(docnos, row, term, tf, dl)`` of at most ``DOCS`` documents of batches in which a docno's rows lie together."""
    held = []

    def block(t: pa.Table, start: np.ndarray):
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
        return t.column("docno").take(pa.array(start)).combine_chunks(), row, t.column("_t").to_numpy(), t.column("tf").to_numpy().astype(float), t.column("dl").to_numpy().astype(float)

    def starts(t: pa.Table) -> np.ndarray:
        d = t.column("docno").combine_chunks()
        new = pa.compute.not_equal(d[1:], d[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        null = d.is_null().to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, new | (null[1:] != null[:-1])))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([*held, t]).combine_chunks() if held else t
        at = starts(t)
        lo = 0
        while len(at) - lo > DOCS:  # the last document may go on
            own = t.slice(int(at[lo]), int(at[lo + DOCS] - at[lo]))
            yield block(own, at[lo : lo + DOCS] - at[lo])
            lo += DOCS
        held = [t.slice(int(at[lo]))]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield block(t, starts(t))


class Best:
    """Every list's best k rows so far (ties: the larger docno, nulls last); ``least`` is what a row must reach."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.least = np.full(n, -np.inf)
        self.rows, self.docs, self.size = [], [], 0
        self.room = max(HELD, 2 * n * k)

    def add(self, which: np.ndarray, score: np.ndarray, docno: pa.Array) -> None:
        self.rows.append((which, score))
        self.docs.append(docno)
        self.size += len(which)
        if self.size > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        which, score = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        docno = pa.concat_arrays(self.docs)
        key = np.round(score, self.digits)
        place = np.empty(len(docno), np.int64)
        place[pa.compute.sort_indices(docno, null_placement="at_start").to_numpy()] = np.arange(len(docno))
        order = np.lexsort((-place, -key, which))
        own = which[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        last = order[rank == self.k - 1]
        self.least[which[last]] = key[last]
        keep = np.sort(order[rank < self.k])
        which, score, docno = which[keep], score[keep], docno.take(pa.array(keep))
        self.rows, self.docs, self.size = [(which, score)], [docno], len(keep)
        return which, score, docno


def top_rows(batches, blocks: list[Queries], points, n: int, k: int, avgdl: float, digits: int):
    """``(setting, query, score, docno)`` arrays: of every setting and query the best ``k`` documents of these batches.

    ``points`` are ``(k1, b, numbers of the k3 values)``; the settings are numbered in that order.
    """
    settings = sum(len(p[2]) for p in points)
    best = Best(settings * n, k, digits)
    margin = 10.0 ** -digits
    for docno, row, term, tf, dl in document_blocks(batches):
        parts = [document_part(k1, b, tf, dl, avgdl) for k1, b, _ in points]
        for q in blocks:
            m = q.meet(row, term, len(docno))
            if not len(m.cell) and not len(m.flat):
                continue
            common, s = None, -1
            for own, (_, _, k3s) in zip(parts, points, strict=True):
                matrix = m.matrix(own)
                for which in k3s:
                    s += 1
                    lists = slice(s * n + q.lo, s * n + q.lo + q.n)
                    score = m.scores(own, matrix, which)
                    least = best.least[lists]
                    if len(docno) > k and np.isneginf(least).any():
                        # What k documents of this block reach; above 0 they have terms in common.
                        kth = np.partition(score, len(docno) - k, axis=0)[len(docno) - k]
                        least = np.maximum(least, np.where(kth > 0, kth - margin, -np.inf))
                    found = score >= least - margin
                    if (least <= margin).any():
                        common = m.common() if common is None else common
                        found &= common
                    at, of = np.nonzero(found)
                    if len(at):
                        best.add(of + lists.start, score[at, of], docno.take(pa.array(at)))
    if best.rows:
        which, score, docno = best.cut()
        for lo in range(0, len(which), 1 << 16):
            w = which[lo : lo + (1 << 16)]
            yield w // n, w % n, score[lo : lo + len(w)], docno[lo : lo + len(w)]
