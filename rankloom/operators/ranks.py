"""Ranks of known documents under every setting of a BM25 grid, in numpy inside Spark tasks.

A document counts for a query only if, under some setting, it reaches what the
query's known documents (or its k-th best document) have at least: its ``floor``.
So a task bounds the scores of a block of documents and a block of queries from
above, for a few settings at a time, and only pairs whose bound reaches the floor
are scored exactly; of these the ones that reach it leave the task, with their hits.
They are brought together by query and ranked under every setting.

A hit's share of a score is a part of the document times a part of the query,
and that of k3 depends on the term's count in the query only, so the hits of a
pair are added up by that count before they meet the values of k3.

Memory: pairs are scored ``PAIRS`` at a time, a task holds at most about ``HELD`` of
them, and what is ranked at a time has at most about ``CELLS`` scores beside the known
documents' own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .blocks import document_blocks, document_part, k3_weight, query_blocks

#: Pairs whose scores are computed at a time.
PAIRS = 2048
#: Pairs that a task holds before it lets go of what cannot be among the best.
HELD = 1 << 16
#: Scores, or places of a block's look-up table, at a time.
CELLS = 1 << 22
#: Values of b that are bounded together lie this close.
SPAN = 0.25
#: Below this a floor is not divided by; every document with a common term is scored.
LEAST = 1e-3


def by_count(side):
    """The query side with each query's terms ordered by their count in it."""
    order = np.lexsort((side.term, side.qtf, side.at))
    return replace(side, at=side.at[order], term=side.term[order], df=side.df[order], qtf=side.qtf[order])


@dataclass(frozen=True)
class Grid:
    """The settings, all combinations of the values, and the query side (``by_count``)."""

    side: object
    k1s: np.ndarray
    bs: np.ndarray
    k3s: np.ndarray
    digits: int
    #: Documents that are ranked; None: all.
    k: int | None

    @property
    def margin(self) -> float:
        return 10.0 ** -self.digits

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.k1s), len(self.bs), len(self.k3s)

    def repeated(self) -> np.ndarray:
        """The queries whose scores depend on k3."""
        return np.bincount(self.side.at, weights=self.side.qtf != 1, minlength=len(self.side.queries)) > 0

    def slices(self, docs: int, k3: int):
        """Parts of the grid, ``(slice of k1, slice of b)``, that have few scores of so many documents."""
        for i in range(len(self.k1s)):
            if docs * len(self.bs) * k3 <= CELLS:
                yield slice(i, i + 1), slice(None)
            else:
                yield from ((slice(i, i + 1), slice(j, j + 1)) for j in range(len(self.bs)))


def pair_scores(grid: Grid, idf: np.ndarray, pair: np.ndarray, slot: np.ndarray, tf: np.ndarray, dl: np.ndarray, k1s, bs, k3s) -> np.ndarray:
    """Scores [pair, k1, b, k3] of hits; those of a pair lie together, ordered by the term's count in the query."""
    k1, b = (x.ravel() for x in np.meshgrid(k1s, bs, indexing="ij"))
    own = idf[slot][:, None] * document_part(k1, b, tf[:, None], dl[:, None], grid.side.avgdl)
    qtf = grid.side.qtf[slot]
    run = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (qtf[1:] != qtf[:-1])))
    own = np.add.reduceat(own, run, axis=0)
    pair = pair[run]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    out = np.add.reduceat(own[:, :, None] * k3_weight(np.asarray(k3s), qtf[run][:, None])[:, None, :], first, axis=0)
    return out.reshape(len(first), len(k1s), len(bs), len(k3s))


# ---- the documents that reach a floor --------------------------------------------------

def _cells(grid: Grid):
    """``(k1, first b, last b)`` as numbers: settings that are bounded together."""
    lo = 0
    for j in range(1, len(grid.bs) + 1):
        if j == len(grid.bs) or abs(grid.bs[j] - grid.bs[lo]) > SPAN:
            yield from ((i, lo, j - 1) for i in range(len(grid.k1s)))
            lo = j


class Bounds:
    """Upper bounds of blocks' scores, as shares of the floors; ``pairs`` are those that may reach them."""

    def __init__(self, grid: Grid, floor: np.ndarray):
        side, idf = grid.side, grid.side.idf("rsj")
        self.grid, self.negative = grid, np.zeros(len(side.terms), bool)
        self.negative[side.term] = idf < 0
        self.cells = list(_cells(grid))
        self.blocks = query_blocks(len(side.queries), side.at, side.term, idf, side.qtf, [])
        floor = floor - 3 * grid.margin
        self.always = (floor < LEAST).any(axis=(1, 2, 3))
        share = 1.0 / np.maximum(floor, LEAST)
        weight = idf[:, None] * k3_weight(grid.k3s, side.qtf[:, None])
        for i, first, last in self.cells:
            w = np.max(weight[:, None, :] * share[side.at, i, first : last + 1], axis=(1, 2))
            for q in self.blocks:
                q.weigh(w[slice(*np.searchsorted(side.at, (q.lo, q.lo + q.n)))])

    def pairs(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray, docs: int):
        """``(Queries, documents, queries)`` of the pairs of a block, ordered by document."""
        meetings = [(q, q.meet(row, term, docs)) for q in self.blocks]
        found = [None] * len(meetings)
        less = self.negative[term]
        for c, (i, first, last) in enumerate(self.cells):
            a, z = (document_part(self.grid.k1s[i], self.grid.bs[j], tf, dl, self.grid.side.avgdl) for j in (first, last))
            own = np.where(less, np.minimum(a, z), np.maximum(a, z))  # a part grows or falls with b throughout
            for n, (_, m) in enumerate(meetings):
                if len(m.cell) or len(m.flat):
                    may = m.scores(own, m.matrix(own), c) >= 1 - 1e-6
                    found[n] = may if found[n] is None else np.logical_or(found[n], may, out=found[n])
        for (q, m), may in zip(meetings, found, strict=True):
            if may is None:
                continue
            always = self.always[q.lo : q.lo + q.n]
            if always.any():
                may[:, always] = m.common()[:, always]
            at, of = np.nonzero(may)
            if len(at):
                yield q, at, of


def _pair_hits(grid: Grid, q, start: np.ndarray, size: np.ndarray, row: np.ndarray, term: np.ndarray, docs: int, at: np.ndarray, of: np.ndarray):
    """``(pairs, pair, slot, hit)`` of some pairs at a time: the hits that document and query have in common, by the query's terms."""
    t = np.minimum(np.searchsorted(q.terms, term), len(q.terms) - 1)
    there = np.flatnonzero(q.terms[t] == term)
    step = max(1, CELLS // len(q.terms))
    for lo in range(0, docs, step):
        first, last = np.searchsorted(at, (lo, lo + step))
        if first == last:
            continue
        hits = there[slice(*np.searchsorted(row[there], (lo, lo + step)))]
        key, one = np.unique((row[hits] - lo) * len(q.terms) + t[hits], return_index=True)
        again = len(key) < len(hits)  # rows of one docno may have a term in common
        if again:
            hits = hits[np.argsort((row[hits] - lo) * len(q.terms) + t[hits], kind="stable")]
            key, one, count = np.unique((row[hits] - lo) * len(q.terms) + t[hits], return_index=True, return_counts=True)
        table = np.full(min(step, docs - lo) * len(q.terms), -1, np.int32)
        table[key] = np.arange(len(key))
        for p in range(first, last, PAIRS):
            own = slice(p, min(p + PAIRS, last))
            query = of[own] + q.lo
            n = size[query]
            pair = np.repeat(np.arange(len(query)), n)
            slot = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - start[query], n)
            u = table[(at[own] - lo)[pair] * len(q.terms) + np.searchsorted(q.terms, grid.side.term[slot])]
            has = u >= 0
            pair, slot, u = pair[has], slot[has], u[has]
            if again:
                n = count[u]
                hit = hits[np.repeat(one[u], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pair, slot = np.repeat(pair, n), np.repeat(slot, n)
            else:
                hit = hits[one[u]]
            yield own, pair, slot, hit


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values))


def reaching(batches, grid: Grid, floor: np.ndarray):
    """Tables ``(q, docno, slots, tf, dl)`` of the pairs that reach ``floor`` [query, k1, b, k3] under a setting, with their hits.

    With ``grid.k`` only pairs that are among the best k of these batches under a setting
    need stay, so those beyond are dropped where a query has many.
    """
    side, idf, repeated = grid.side, grid.side.idf("rsj"), grid.repeated()
    size = np.bincount(side.at, minlength=len(side.queries))
    start = np.cumsum(size) - size
    bounds, floor = Bounds(grid, floor), floor.copy()
    held, n = [], 0
    for docno, row, term, tf, dl in document_blocks(batches):
        for q, at, of in bounds.pairs(row, term, tf, dl, len(docno)):
            for again in (False, True):
                which = repeated[of + q.lo] == again
                k3s = grid.k3s if again else grid.k3s[:1]
                own_at, own_of = at[which], of[which]
                for pairs, pair, slot, hit in _pair_hits(grid, q, start, size, row, term, len(docno), own_at, own_of):
                    if not len(pair):
                        continue
                    there, pair = np.unique(pair, return_inverse=True)
                    scores = pair_scores(grid, idf, pair, slot, tf[hit], dl[hit], grid.k1s, grid.bs, k3s)
                    query = own_of[pairs][there] + q.lo
                    keep = (scores >= floor[query][..., : len(k3s)] - 2 * grid.margin).any(axis=(1, 2, 3))
                    if not keep.any():
                        continue
                    mine = keep[pair]
                    count = np.bincount(pair, minlength=len(there))[keep]
                    held.append(pa.table([pa.array(query[keep], pa.int32()), docno.take(pa.array(own_at[pairs][there][keep])), _lists(slot[mine].astype(np.int32), count),
                                          _lists(tf[hit[mine]], count), _lists(dl[hit[mine]], count)], names=["q", "docno", "slots", "tf", "dl"]))
                    n += len(count)
        if n > HELD:
            yield _best(pa.concat_tables(held).combine_chunks(), grid, idf, repeated, floor)
            held, n = [], 0
    if held:
        yield _best(pa.concat_tables(held).combine_chunks(), grid, idf, repeated, floor)


def _best(t: pa.Table, grid: Grid, idf: np.ndarray, repeated: np.ndarray, floor: np.ndarray) -> pa.Table:
    """The rows that are among their query's best k under a setting; raises the floors to the k-th."""
    q = t.column("q").to_numpy()
    many = np.bincount(q, minlength=len(repeated)) > (grid.k if grid.k is not None else len(q))
    if not many.any():
        return t
    keep = ~many[q]
    order = np.argsort(q, kind="stable")
    for query in np.flatnonzero(many):
        rows = order[slice(*np.searchsorted(q[order], (query, query + 1)))]
        g = Group(t.take(pa.array(rows)), grid, idf, repeated[query])
        best = np.zeros(len(rows), bool)
        for where, scores in g.all_scores():
            first = g.order(scores)[:, : grid.k]
            best[first] = True
            kth = scores[first[:, -1], np.arange(scores.shape[1])].reshape(g.shape(where))
            floor[query][where] = np.maximum(floor[query][where], kth)
        keep[rows] = best
    return t.filter(pa.array(keep))


# ---- a query's documents under every setting -----------------------------------------

class Group:
    """The pairs of one query, ``(docno, slots, tf, dl)``."""

    def __init__(self, t: pa.Table, grid: Grid, idf: np.ndarray, repeated: bool):
        t = t.combine_chunks()
        one = lambda c: t.column(c).combine_chunks()
        self.grid, self.idf, self.docno = grid, idf, one("docno")
        self.k3s = grid.k3s if repeated else grid.k3s[:1]
        self.size = pc.list_value_length(one("slots")).to_numpy()
        self.slot, self.tf, self.dl = (one(c).flatten().to_numpy() for c in ("slots", "tf", "dl"))
        self.start = np.cumsum(self.size) - self.size
        self.place = np.empty(t.num_rows, np.int64)
        self.place[pc.sort_indices(self.docno, null_placement="at_start").to_numpy()] = np.arange(t.num_rows)

    def shape(self, where) -> tuple:
        return len(self.grid.k1s[where[0]]), len(self.grid.bs[where[1]]), len(self.k3s)

    def scores(self, rows: np.ndarray, where) -> np.ndarray:
        """Rounded scores [row, setting of this part of the grid]."""
        k1s, bs = self.grid.k1s[where[0]], self.grid.bs[where[1]]
        out = np.empty((len(rows), len(k1s) * len(bs) * len(self.k3s)))
        for lo in range(0, len(rows), PAIRS):
            own = rows[lo : lo + PAIRS]
            n = self.size[own]
            pair = np.repeat(np.arange(len(own)), n)
            hit = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - self.start[own], n)
            out[lo : lo + len(own)] = pair_scores(self.grid, self.idf, pair, self.slot[hit], self.tf[hit], self.dl[hit], k1s, bs, self.k3s).reshape(len(own), -1)
        return np.round(out, self.grid.digits, out=out)

    def all_scores(self):
        """``(part of the grid, scores)`` of all documents."""
        rows = np.arange(len(self.size))
        for where in self.grid.slices(len(rows), len(self.k3s)):
            yield where, self.scores(rows, where)

    def order(self, scores: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """[setting, rank]: the rows by score, then the larger docno, nulls last."""
        s = -scores.T
        return np.lexsort((np.broadcast_to(-(self.place if rows is None else self.place[rows]), s.shape), s))


def _position(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return out


def kth_best(t: pa.Table, grid: Grid, idf: np.ndarray, repeated: bool) -> np.ndarray | None:
    """What the k-th best of one query's pairs reaches, [k1, b, k3]; None if they are fewer."""
    if t.num_rows < grid.k:
        return None
    g, out = Group(t, grid, idf, repeated), np.empty(grid.shape)
    at = t.num_rows - grid.k
    for where, scores in g.all_scores():
        out[where] = np.partition(scores, at, axis=0)[at].reshape(g.shape(where))
    return out


def known_ranks(t: pa.Table, grid: Grid, idf: np.ndarray, repeated: bool) -> tuple[pa.Array, np.ndarray]:
    """``(docno, ranks [document, setting])`` of one query's known documents among its pairs; column ``known`` marks them."""
    known = t.column("known").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    g = Group(t, grid, idf, repeated)
    mine, others = np.flatnonzero(known), np.flatnonzero(~known)
    out = np.empty((len(mine), *grid.shape), np.int64)
    for where in grid.slices(len(mine) + min(len(others), PAIRS), len(g.k3s)) if len(mine) else ():
        own = g.scores(mine, where)
        alone = _position(g.order(own, mine))
        rank = 1 + alone
        for lo in range(0, len(others), PAIRS):
            rows = np.append(mine, others[lo : lo + PAIRS])
            scores = np.concatenate([own, g.scores(rows[len(mine) :], where)])
            rank += _position(g.order(scores, rows))[:, : len(mine)] - alone
        out[(slice(None), *where)] = rank.T.reshape(len(mine), *g.shape(where))
    return g.docno.take(pa.array(mine)), out.reshape(len(mine), int(np.prod(grid.shape)))


def by_query(batches, column: str):
    """``(query, table)`` of batches in which the rows of a query lie together."""
    held, last = [], None
    for b in batches:
        q = b.column(column).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else ()
        for lo, hi in zip(start, np.append(start[1:], len(q)), strict=True) if len(q) else ():
            if held and q[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = q[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)
