"""Exact top-k inner-product search by distributed histogram selection.

The query vectors are handled in blocks of ``block`` queries, each block
broadcast (its size is block x dimension x 8 bytes, fixed by the parameter).
For a block, every row is scored in every pass:

1. a pass finds the score bounds of each query;
2. histogram passes narrow the interval that holds the k-th highest score: a
   task reports its bin counts from the top down until they reach k (lower
   bins cannot hold the global k-th score), the counts are summed over tasks
   and the bin where they reach k becomes the next interval, until it holds a
   single score value T;
3. the last pass keeps scores above T and, at T, the smallest ids only: a task
   reports no more of them than the query still needs.

Nothing is sampled and no task holds more than its own batch of scores.

Defined cases: null vectors and vectors with null or non-finite components
take no part; a repeated vec_id counts once, with its smallest vector; missing
trailing components of a shorter vector count as 0; a query with fewer than k
candidates returns all of them; an empty table returns no rows; a score beyond
61 bits (components of some 10^6) is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import settle, table

BINS = 512


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>) of the usable rows, one for each vec_id."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == F.lit(float("inf"))))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~bad)
    x = x.select("vec_id", F.transform("e", lambda a: F.floor(a * 256)).alias("v"))
    return x.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as an integer matrix of ``dim`` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out, at = np.zeros((len(sizes), dim), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, : min(n, dim)] = flat[at[i] : at[i] + min(n, dim)]
    return out


def _scores(q: np.ndarray, m: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point while all sums stay exact in it. A candidate's score has at most 61 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    near = q.astype(np.float64) @ m.T.astype(np.float64)
    if most < 2**52:
        return near.astype(np.int64)
    if (np.abs(near[ok]) >= 2**61).any():
        raise OverflowError("the inner product of two vectors is beyond 61 bits; scale the components down")
    return q @ m.T  # partial sums may wrap, the result does not


def _batches(it: Iterator[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray):
    """(ids, scores [query, row], whether the row may be a candidate) by slices of bounded size."""
    step = max(1, (4 << 20) // max(1, len(q_ids)))
    for b in it:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            ok = ids[None, :] != q_ids[:, None]
            yield ids, _scores(q, _matrix(part.column("v"), q.shape[1]), ok), ok


def _bounds(rows: DataFrame, bc) -> DataFrame:
    def run(it):
        q_ids, q = bc.value
        lo = np.full(len(q_ids), np.iinfo(np.int64).max)
        hi = np.full(len(q_ids), np.iinfo(np.int64).min)
        n = np.zeros(len(q_ids), dtype=np.int64)
        for _, s, ok in _batches(it, q_ids, q):
            lo = np.minimum(lo, np.where(ok, s, np.iinfo(np.int64).max).min(axis=1))
            hi = np.maximum(hi, np.where(ok, s, np.iinfo(np.int64).min).max(axis=1))
            n += ok.sum(axis=1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"q": at, "lo": lo[at], "hi": hi[at], "n": n[at]})

    found = rows.mapInArrow(run, "q bigint, lo bigint, hi bigint, n bigint")
    return found.groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def _histogram(rows: DataFrame, bc, k: int, state) -> DataFrame:
    """(q, bin, count) of the scores in each query's interval, from the top down to each task's own k-th."""

    def run(it):
        q_ids, q = bc.value
        lo, width, need, hi = state.value
        hist = np.zeros((len(q_ids), BINS), dtype=np.int64)
        for _, s, ok in _batches(it, q_ids, q):
            ok &= (s >= lo[:, None]) & (s <= hi[:, None]) & (need[:, None] > 0)
            qi, ri = np.nonzero(ok)
            bins = (s[qi, ri] - lo[qi]) // width[qi]
            hist += np.bincount(qi * BINS + bins, minlength=len(q_ids) * BINS).reshape(hist.shape)
        above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
        qi, bi = np.nonzero((hist > 0) & (above < k))
        yield pa.RecordBatch.from_pydict({"q": qi, "bin": bi, "n": hist[qi, bi]})

    return rows.mapInArrow(run, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bin(hist: DataFrame, need: DataFrame) -> DataFrame:
    """(q, bin, above): the bin where the counts from the top reach ``need``."""
    w = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("n").over(w)).join(need, "q")
    hit = run.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return hit.select("q", "bin", (F.col("upto") - F.col("n")).alias("above"))


def _take(rows: DataFrame, bc, state) -> DataFrame:
    """Scores above each query's T, and of those at T the smallest ids, as many as it needs."""

    def run(it):
        q_ids, q = bc.value
        cut, ties = state.value
        pend: dict[int, np.ndarray] = {}
        for ids, s, ok in _batches(it, q_ids, q):
            qi, ri = np.nonzero(ok & (s > cut[:, None]))
            if len(qi):
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[qi], "vec_id": ids[ri], "score": s[qi, ri]})
            for j in np.flatnonzero((ok & (s == cut[:, None])).any(axis=1)):
                own = np.concatenate([pend.get(j, ids[:0]), ids[ok[j] & (s[j] == cut[j])]])
                pend[j] = np.sort(own)[: ties[j]]
        for j, own in pend.items():
            if len(own):
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(own), q_ids[j]), "vec_id": own, "score": np.full(len(own), cut[j])})

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _block_top(spark: SparkSession, rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame | None:
    bc = spark.sparkContext.broadcast((q_ids, q))
    n = len(q_ids)
    lo, hi, need = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for r in _bounds(rows, bc).collect():  # a row for each query of the block
        lo[r.q], hi[r.q], need[r.q] = r.lo, r.hi, min(k, r.n)
    if not need.any():
        return None
    open_ = (need > 0) & (hi > lo)
    while open_.any():
        width = np.maximum(1, -(-(hi - lo + 1) // BINS))
        state = spark.sparkContext.broadcast((lo, width, np.where(open_, need, 0), hi))
        needed = spark.createDataFrame(pd.DataFrame({"q": np.flatnonzero(open_), "need": need[open_]}), "q bigint, need bigint")
        for r in _kth_bin(_histogram(rows, bc, k, state), needed).collect():  # a row for each query of the block
            lo[r.q] += r.bin * width[r.q]
            hi[r.q] = min(hi[r.q], lo[r.q] + width[r.q] - 1)
            need[r.q] -= r.above
        open_ = (need > 0) & (hi > lo)
    cut = np.where(need > 0, lo, np.iinfo(np.int64).max)
    return _take(rows, bc, spark.sparkContext.broadcast((cut, need)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query vector.

    ``vectors`` and ``queries`` have (vec_id, v) as from :func:`integer_vectors`;
    a query's own vec_id is no candidate. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    out, last = None, None
    while True:  # blocks of queries, by id
        nxt = queries if last is None else queries.filter(F.col("vec_id") > last)
        got = nxt.orderBy("vec_id").limit(block).toArrow()
        if not got.num_rows:
            break
        q_ids = got.column("vec_id").to_numpy()
        dim = int(np.diff(got.column("v").combine_chunks().offsets.to_numpy()).max())
        part = _block_top(spark, vectors, q_ids, _matrix(got.column("v"), dim), k)
        if part is not None:
            out = part if out is None else out.unionByName(part)
        last = int(q_ids[-1])
        if got.num_rows < block:
            break
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(integer_vectors(table(spark, sf_dir, "embeddings")))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
