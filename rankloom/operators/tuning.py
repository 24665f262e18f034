"""Parameter tuning.

Candidates are scored once; a parameter grid multiplies the (bounded)
candidate table by the grid size through ``explode`` of a literal array,
and ranking and evaluation run per (parameter, query) in the same job.
The best setting is picked per topic set with a window -- highest mean,
smallest parameter value on ties.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.sizing import BROADCAST_BYTES, measured
from . import evaluate as ev
from . import ranks
from .lexical import SCORE_DIGITS, as_index, bm25_contribution_of, bm25_features, numbered_hits, query_side, query_terms, ranked, top_scores

# The interpolation grid 0.0, 0.1, ..., 0.9.
ALPHA_GRID = tuple(i / 10 for i in range(10))


def _grid_column(values, name: str):
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)


def alpha_scan(scored: DataFrame, qrels: DataFrame, dense_col: str = "dense_score",
               alphas=ALPHA_GRID, measure: str = "map", keys=("variant",), k: int = 100) -> DataFrame:
    """``(*keys, alpha, <measure>)`` for F3 interpolation at every alpha."""
    keys = [c for c in keys if c in scored.columns]
    g = scored.select(*keys, "qid", "docno", "score", dense_col, _grid_column(alphas, "alpha"))
    g = g.withColumn("score", F.col("alpha") * F.col("score") + (F.lit(1.0) - F.col("alpha")) * F.col(dense_col))
    run = ranked(g, [*keys, "alpha", "qid"], k)
    grid = scored.select(*keys).distinct().select(*keys, _grid_column(alphas, "alpha"))
    res = ev.evaluate(run, qrels, [measure], keys=(*keys, "alpha"), known=grid)
    return res.select(*keys, "alpha", F.col("value").alias(measure))


def best_row(scan: DataFrame, param_cols, measure: str = "map", keys=("variant",)) -> DataFrame:
    """The best parameter row per ``keys`` (ties: smallest parameters)."""
    keys = [c for c in keys if c in scan.columns]
    order = [F.round(F.col(measure), 6).desc()] + [F.col(c).asc() for c in param_cols]
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return scan.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def bm25_grid_scan(source, topics: DataFrame, qrels: DataFrame, grid,
                   measure: str = "map", k: int = 100, keys=("variant", "qid"),
                   max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """BM25 evaluated at every (k1, b, k3) of ``grid``.

    Blocks of documents are scored against blocks of queries under each setting
    (``lexical.top_scores``), so what is shuffled is each partition's best k of a
    setting and query, which is one more key of the ranking and evaluation.
    Beyond the bound of a broadcast the grid is exploded onto the hits.
    """
    keys = [c for c in keys if c in topics.columns]
    index = as_index(source)
    points = list(dict.fromkeys((float(k1), float(b), float(k3)) for (k1, b, k3) in grid))
    pts = F.array(*[F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(k3).alias("k3")) for (k1, b, k3) in points])
    qt, small = measured(query_terms(topics, keys), max_bytes)
    if small:
        scores, qkeys = top_scores(index, qt, points, k, keys)
        bc = F.broadcast
    else:
        feats, qkeys, bc = bm25_features(index, None, keys=keys, max_bytes=max_bytes, qterms=qt)
        g = feats.select("*", F.posexplode(pts).alias("_s", "p")).select("*", "p.k1", "p.b", "p.k3").drop("p")
        contrib = bm25_contribution_of(F.col("k1"), F.col("b"), F.col("k3"))
        scores = g.groupBy("_s", "_q", "docno").agg(F.sum(contrib).alias("score"))
    top = ranked(scores, ["_s", "_q"], k).withColumn("p", pts[F.col("_s")]).select("*", "p.k1", "p.b", "p.k3").drop("p").join(bc(qkeys), "_q")
    outer = [c for c in keys if c != "qid"]
    known = topics.select(*outer).distinct().select(*outer, F.explode(pts).alias("p")).select(*outer, "p.k1", "p.b", "p.k3")
    res = ev.evaluate(top, qrels, [measure], keys=(*outer, "k1", "b", "k3"), known=known)
    return res.select(*outer, "k1", "b", "k3", F.col("value").alias(measure))


# ---- large grids by counting ranks -------------------------------------------------

#: Rows of hits whose settings are computed at a time.
SLICE = 2048


def settings(k1s, bs, k3s) -> list[tuple[float, float, float]]:
    """All (k1, b, k3), in the order of the score vectors."""
    return [(float(k1), float(b), float(k3)) for k1 in k1s for b in bs for k3 in k3s]


def _score_vectors(batches, k1s, bs, k3s):
    """``(query, docno, scores)`` arrays of sorted hits: a pair's scores under every setting.

    A hit's share is a factor of k3 times a factor of (k1, b), so a batch is
    one product; the last pair of a batch waits for the next one.
    """
    k1, b = (x.ravel() for x in np.meshgrid(np.array(k1s, float), np.array(bs, float), indexing="ij"))
    k3 = np.array(k3s, float)
    rest = None
    for part in batches:
        for lo in range(0, part.num_rows, SLICE):
            cols = {n: part.column(n).to_numpy(zero_copy_only=False)[lo:lo + SLICE] for n in ("_q", "docno", "tf", "dl", "df", "n_docs", "avgdl", "qtf")}
            tf, qtf = cols["tf"].astype(float)[:, None], cols["qtf"].astype(float)[:, None]
            idf = np.log2((cols["n_docs"] - cols["df"] + 0.5) / (cols["df"] + 0.5))[:, None]
            ratio = (cols["dl"] / cols["avgdl"])[:, None]
            own = ((k1 + 1) * tf / (k1 * ((1 - b) + b * ratio) + tf))[:, :, None] * (idf * ((k3 + 1) * qtf / (k3 + qtf)))[:, None, :]
            q, d, v = cols["_q"], cols["docno"], own.reshape(len(tf), -1)
            if rest is not None:
                q, d, v = np.append(rest[0], q), np.append(rest[1], d), np.vstack([rest[2], v])
            first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (d[1:] != d[:-1])))
            v, q, d = np.add.reduceat(v, first, axis=0), q[first], d[first]
            rest = q[-1:], d[-1:], v[-1:]
            if len(q) > 1:
                yield q[:-1], d[:-1], v[:-1]
    if rest is not None:
        yield rest


def _known_floors(feats: DataFrame, k1s, bs, k3s, k: int | None) -> DataFrame:
    """``(_q, floor)``: what a query's known documents have at least, or the k-th of them, under every setting."""
    def low(batches):
        held, last = [], None
        for q, _, v in _score_vectors(batches, k1s, bs, k3s):
            for lo, hi in zip(start := np.flatnonzero(np.append(True, q[1:] != q[:-1])), np.append(start[1:], len(q)), strict=True):
                if held and q[lo] != last:
                    yield last, np.concatenate(held)
                    held = []
                last = q[lo]
                held.append(v[lo:hi])
        if held:
            yield last, np.concatenate(held)

    def floors(batches):
        for q, v in low(batches):
            least = v.min(axis=0) if k is None or len(v) <= k else np.partition(v, len(v) - k, axis=0)[len(v) - k]
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([least], pa.list_(pa.float64()))], names=["_q", "floor"])

    return feats.repartition(_parts(feats), "_q").sortWithinPartitions("_q", "docno").mapInArrow(floors, "_q long, floor array<double>")


def _parts(df: DataFrame) -> int:
    """Partitions for work by query, which is much for few bytes."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A query's k-th best document of a part of the collection is a floor of its k-th best of all; the part has so many times the root of the documents.
PART = 64


def _grid_ranks(source, topics: DataFrame, qrels: DataFrame, k1s, bs, k3s, keys, k: int | None, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(_q, docno, _s, rank)`` and ``(*keys, _q)``; ``_s`` is a setting's number. See ``bm25_grid_ranks``."""
    k1s, bs, k3s = ([float(x) for x in v] for v in (k1s, bs, k3s))
    size = len(k1s) * len(bs) * len(k3s)
    spark = topics.sparkSession
    index = as_index(source)
    qt, _ = measured(query_terms(topics, keys), BROADCAST_BYTES)
    relevant, small = measured(qrels.filter(F.col("rel") >= 1).select("qid", "docno").distinct(), max_bytes)
    within = qt.select(*keys).distinct().join(F.broadcast(relevant) if small else relevant, "qid").select(*keys, "docno")
    feats, qkeys, bc = bm25_features(index, None, keys=keys, qterms=qt, within=within)
    feats = feats.select("_q", "docno", "tf", "dl", "df", "n_docs", "avgdl", "qtf")
    kind = feats.schema["docno"]
    known, few = measured(within.select(F.xxhash64(*keys).alias("_q"), "docno").distinct().withColumn("known", F.lit(True)), max_bytes)
    floors = _known_floors(feats, k1s, bs, k3s, k).cache()
    chunks = max(1, math.ceil(floors.count() * (8 * size + 64) / max_bytes))
    hit = T.StructType([T.StructField("_q", T.LongType()), kind, T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.DoubleType())),
                        T.StructField("dl", T.ArrayType(T.DoubleType()))])
    ranked_ = T.StructType([T.StructField("_q", T.LongType()), kind, T.StructField("_s", T.IntegerType()), T.StructField("rank", T.LongType())])
    out = None
    for c in range(chunks):
        own = floors.filter(F.pmod(F.xxhash64("_q"), F.lit(chunks)) == c).toArrow().sort_by("_q")  # one chunk: at most about max_bytes
        if not own.num_rows:
            continue
        judged = spark.createDataFrame(own.select(["_q"]), "_q long")
        terms = qt.withColumn("_q", F.xxhash64(*keys)).join(F.broadcast(judged), "_q", "left_semi").drop("_q")  # queries of this chunk
        side, _ = query_side(index, terms, keys)
        grid = ranks.Grid(ranks.by_count(side), np.array(k1s), np.array(bs), np.array(k3s), SCORE_DIGITS, k)
        floor = own.column("floor").combine_chunks().flatten().to_numpy().reshape(len(side.queries), *grid.shape).copy()
        rows, hits = numbered_hits(index, side)
        held = spark.sparkContext.broadcast(grid)

        def reaching(rows: DataFrame, floor: np.ndarray, grid=held, hits=hits) -> DataFrame:
            least = spark.sparkContext.broadcast(floor)

            def run(batches):
                side = grid.value.side
                for t in ranks.reaching(hits(batches, side.terms), grid.value, least.value):
                    q = pa.array(side.queries[t.column("q").to_numpy()])
                    docno = t.column("docno").cast(to_arrow_type(kind.dataType))
                    yield from pa.table([q, docno, *t.columns[2:]], names=hit.names).to_batches(max_chunksize=1 << 14)

            return rows.mapInArrow(run, hit)

        def numbered(batches, grid=held):
            grid = grid.value
            idf, repeated, number = grid.side.idf("rsj"), grid.repeated(), {int(q): i for i, q in enumerate(grid.side.queries)}
            for q, t in ranks.by_query(batches, "_q"):
                yield q, t, (grid, idf, repeated[number[int(q)]])

        def best(batches, numbered=numbered):
            for q, t, about in numbered(batches):
                least = ranks.kth_best(t, *about)
                if least is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([least.ravel()], pa.list_(pa.float64()))], names=["_q", "floor"])

        def rank(batches, numbered=numbered):
            for q, t, about in numbered(batches):
                docno, at = ranks.known_ranks(t, *about)
                one, s = np.nonzero(at <= k) if k is not None else np.indices(at.shape).reshape(2, -1)
                for lo in range(0, len(one), 1 << 16):
                    d, n = one[lo : lo + (1 << 16)], s[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q)), docno.take(pa.array(d)), pa.array(n.astype(np.int32)), pa.array(at[d, n])], names=ranked_.names)

        every = math.ceil(math.sqrt(side.n_docs) / PART)
        if k is not None and every > 1:
            part = reaching(rows.filter(F.pmod(F.xxhash64("docno"), F.lit(every)) == 0), floor)
            kth = part.repartition(_parts(part), "_q").sortWithinPartitions("_q").mapInArrow(best, "_q long, floor array<double>").toArrow()  # at most the floors' bytes
            at = np.searchsorted(side.queries, kth.column("_q").to_numpy())
            floor[at] = np.maximum(floor[at], kth.column("floor").combine_chunks().flatten().to_numpy().reshape(len(at), *grid.shape))
        found = reaching(rows, floor).join(F.broadcast(known) if few else known, ["_q", "docno"], "left").select(*hit.names, "known")
        one = found.repartition(_parts(found), "_q").sortWithinPartitions("_q").mapInArrow(rank, ranked_)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], ranked_)
    return out, bc(qkeys)


def _points(k1s, bs, k3s) -> F.Column:
    return F.array(*[F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(k3).alias("k3")) for k1, b, k3 in settings(k1s, bs, k3s)])


def bm25_grid_ranks(source, topics: DataFrame, qrels: DataFrame, k1s, bs, k3s, keys=("variant", "qid"),
                    max_bytes: int = BROADCAST_BYTES, k: int | None = None) -> DataFrame:
    """``(*keys, docno, k1, b, k3, rank)`` of the relevant documents that match, under every setting.

    No run is made: a document's rank is one more than the number of documents
    of the query that score higher (or as high, with a larger docno). Only
    documents that score as high as some relevant one can be among those, and with
    ``k`` (ranks beyond it are left out) only such as reach the k-th best of a part
    of the collection. These floors, a number for each query and setting, are
    broadcast in chunks of queries of at most ``max_bytes``; one pass over the hits
    finds the documents that reach them under some setting (``ranks``). They are
    brought together by query and ranked under every setting, so what is shuffled
    grows neither with the settings nor with the tasks.
    """
    keys = [c for c in keys if c in topics.columns]
    out, qkeys = _grid_ranks(source, topics, qrels, k1s, bs, k3s, keys, k, max_bytes)
    return out.withColumn("p", _points(k1s, bs, k3s)[F.col("_s")]).join(qkeys, "_q").select(*keys, "docno", "p.k1", "p.b", "p.k3", "rank")


def bm25_large_grid(source, topics: DataFrame, qrels: DataFrame, k1s, bs, k3s, measure: str = "map", k: int = 1000,
                    keys=("variant", "qid")) -> DataFrame:
    """``(*outer keys, k1, b, k3, <measure>)`` of every setting, from the relevant documents' ranks within ``k``."""
    keys = [c for c in keys if c in topics.columns]
    outer = [c for c in keys if c != "qid"]
    found, qkeys = _grid_ranks(source, topics, qrels, k1s, bs, k3s, keys, k, BROADCAST_BYTES)
    hits = found.join(qkeys, "_q").select(*keys, "docno", "_s", "rank")
    known = topics.select(*outer).distinct().select(*outer, F.explode(F.sequence(F.lit(0), F.lit(len(settings(k1s, bs, k3s)) - 1))).alias("_s"))
    res = ev.evaluate(hits, qrels, [measure], keys=(*outer, "_s"), known=known)
    return res.withColumn("p", _points(k1s, bs, k3s)[F.col("_s")]).select(*outer, "p.k1", "p.b", "p.k3", F.col("value").alias(measure))


def fold_tuning(scored: DataFrame, qrels: DataFrame, n_folds: int = 2, dense_col: str = "dense_score",
                alphas=ALPHA_GRID, measure: str = "map", keys=("variant",), k: int = 100) -> DataFrame:
    """Tune alpha on the other folds, report it on each held-out fold.

    fold = qid mod n_folds. ``(*keys, fold, alpha, train_<measure>, test_<measure>)``.
    """
    keys = [c for c in keys if c in scored.columns]
    folds = F.explode(F.array(*[F.lit(f) for f in range(n_folds)])).alias("fold")
    s = scored.select("*", folds)
    q = qrels.select("qid", "docno", "rel", F.pmod(F.col("qid"), F.lit(n_folds)).alias("qfold"))
    train_s = s.filter(F.pmod(F.col("qid"), F.lit(n_folds)) != F.col("fold"))
    test_s = s.filter(F.pmod(F.col("qid"), F.lit(n_folds)) == F.col("fold"))
    out = []
    for f in range(n_folds):
        tr = alpha_scan(train_s.filter(F.col("fold") == f).drop("fold"),
                        q.filter(F.col("qfold") != f).drop("qfold"), dense_col, alphas, measure, keys, k)
        best = best_row(tr, ["alpha"], measure, keys).select(*keys, "alpha",
                                                             F.col(measure).alias(f"train_{measure}"))
        te = alpha_scan(test_s.filter(F.col("fold") == f).drop("fold"),
                        q.filter(F.col("qfold") == f).drop("qfold"), dense_col, alphas, measure, keys, k)
        te = te.select(*keys, "alpha", F.col(measure).alias(f"test_{measure}"))
        out.append(best.join(te, [*keys, "alpha"]).withColumn("fold", F.lit(f).cast("long")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select(*keys, "fold", "alpha", f"train_{measure}", f"test_{measure}")
