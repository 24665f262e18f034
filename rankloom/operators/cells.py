"""Vector search through cells (D8): exact with bounds, or approximate with measured recall.

Centres come from k-means on a bounded, fixed sample (``FIT_ROWS`` for each
cell); every vector is then placed, in its nearest cell and once more in the
second nearest (a copy, used by the approximate search only). A cell keeps its
radius, the largest angle between a vector placed there and the centre. The
placed vectors are range-partitioned by (cell, docno), so a cell that holds a
third of all vectors is many tasks' work, and a search only multiplies: the
queries go in broadcast chunks, a task takes a cell's rows of a batch and the
queries that probe it, and keeps each query's k best. No vector is shuffled.

Exact: the nearest cells first; then, with the k-th similarity known, the cells
that may hold a better one, as a vector in a cell is at least (angle to the
centre - radius) away from the query. ``visited`` gives the share of cells that
this leaves. Approximate: a fixed number of nearest cells, given or the smallest
that reaches the wanted recall on a sample of the queries against exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_lists, matrix
from ..plans.sizing import BROADCAST_BYTES, settled
from .dense import _best, _unit, exact_search
from .lexical import SCORE_DIGITS, ranked

# Sampled vectors for each cell, queries of the measurement, wanted recall.
FIT_ROWS = 256
SAMPLE_QUERIES = 256
RECALL = 0.92
EPS = 2 * 10.0 ** -SCORE_DIGITS  # similarities are compared rounded


@dataclass(frozen=True)
class Cells:
    placed: DataFrame  # (docno, vec, cell, first): unit vectors; ``first`` is the nearest cell
    centers: np.ndarray
    radius: np.ndarray  # by cell, of the vectors whose nearest it is


def _place(docs: DataFrame, centers: np.ndarray, copies: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = held.value
        for b in batches:
            x = _unit(matrix(b.column("vec")))
            if not len(x):
                continue
            near = np.argsort(-np.round(x @ c.T, 9), axis=1, kind="stable")[:, :copies].astype(np.int64)
            for j in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column("docno"), as_lists(x), pa.array(near[:, j]), pa.array(near[:, 0])], names=["docno", "vec", "cell", "first"])

    schema = T.StructType([docs.schema["docno"], T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType()), T.StructField("first", T.LongType())])
    return docs.select("docno", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null").mapInArrow(run, schema)


def _radii(placed: DataFrame, centers: np.ndarray) -> np.ndarray:
    held = placed.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c, far = held.value, {}
        for b in batches:
            cell = b.column("cell").to_numpy()
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", matrix(b.column("vec")), c[cell]), -1, 1))
            for k in np.unique(cell).tolist():
                far[k] = max(far.get(k, 0.0), float(angle[cell == k].max()))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(far.keys(), pa.int64()), "r": pa.array(far.values(), pa.float64())})

    out = np.zeros(len(centers))
    rows = placed.filter("cell = first").mapInArrow(run, "cell long, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()  # one row a cell
    for r in rows:
        out[r["cell"]] = r["r"]
    return out


def build(dvecs: DataFrame, n_cells: int | None = None, seed: int = 7, copies: int = 2, keep=settled) -> Cells:
    """Cells over ``(docno, vec)``; the square root of their number unless given. ``keep`` stores the placed vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dvecs = dvecs.filter("vec is not null")
    n = dvecs.count()
    n_cells = n_cells or max(2, math.isqrt(n))
    vec = F.col("vec").cast("array<double>")
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    sample = dvecs
    if n > FIT_ROWS * n_cells:
        sample = sample.filter(F.pmod(F.xxhash64("docno"), F.lit(1 << 20)) < math.ceil((1 << 20) * FIT_ROWS * n_cells / n))
    # Equal vectors once: copies do not draw the centres to themselves.
    unit = settled(sample.select(F.transform(vec, lambda x: x / F.when(length > 0, length).otherwise(1.0)).alias("v")).distinct())
    if unit.count() <= n_cells:
        points = [r["v"] for r in unit.orderBy("v").collect()]  # at most n_cells rows
        centers = np.array(points, dtype=np.float64) if points else np.zeros((1, 1))
    else:
        model = KMeans(k=n_cells, seed=seed, featuresCol="features").fit(unit.select(array_to_vector("v").alias("features")))
        centers = _unit(np.array(model.clusterCenters()))
    placed = _place(dvecs, centers, min(copies, len(centers)))
    placed = keep(placed.repartitionByRange("cell", "docno").sortWithinPartitions("cell"))
    return Cells(placed, centers, _radii(placed, centers))


def _bounds(q: np.ndarray, centers: np.ndarray, radius) -> np.ndarray:
    """The best similarity that each cell may hold for each query."""
    angle = np.arccos(np.clip(q @ centers.T, -1, 1))
    return np.cos(np.maximum(0.0, angle - radius))


def _edges(q: np.ndarray, centers: np.ndarray, probe: int) -> np.ndarray:
    """The similarity of each query's last probed centre."""
    if probe >= len(centers):
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for lo in range(0, len(q), 1024):
        out[lo:lo + 1024] = -np.partition(-(q[lo:lo + 1024] @ centers.T), probe - 1, axis=1)[:, probe - 1]
    return out


def _scan(cells: Cells, names: list, q: np.ndarray, edge: np.ndarray, k: int, schema: T.StructType, kth: np.ndarray | None = None) -> DataFrame:
    """Each query's k best of every batch: in the probed cells, or (``kth`` given) in the others that may reach it."""
    spark = cells.placed.sparkSession
    held = spark.sparkContext.broadcast((names, q, edge, kth, cells.centers, cells.radius))
    approximate = kth is None
    docs = cells.placed if approximate else cells.placed.filter("cell = first")

    def run(batches):
        import pandas as pd

        names, q, edge, kth, centers, radius = held.value
        for b in batches:
            cell, first = b.column("cell").to_numpy(), b.column("first").to_numpy()
            docno = b.column("docno").to_numpy(zero_copy_only=False)
            x, found = None, []
            for c in np.unique(cell).tolist():
                near = q @ centers[c]
                probe = near >= edge if kth is None else (near < edge) & (np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius[c])) >= kth - EPS)
                probe = np.flatnonzero(probe)
                if not len(probe):
                    continue
                x = matrix(b.column("vec")) if x is None else x
                rows = np.flatnonzero(cell == c)
                order = np.unique(docno[rows], return_inverse=True)[1]
                copy = first[rows] != c
                for lo in range(0, len(probe), max(1, (4 << 20) // len(rows))):  # for bounded memory
                    own = probe[lo:lo + max(1, (4 << 20) // len(rows))]
                    s = q[own] @ x[rows].T
                    if copy.any():  # a copy counts only where the query does not see the vector in its nearest cell
                        s[:, copy] = np.where(q[own] @ centers[first[rows[copy]]].T >= edge[own][:, None], -np.inf, s[:, copy])
                    for i, scores in zip(own.tolist(), s, strict=True):
                        top = _best(scores, order, k)
                        found += [(*names[i], docno[rows[j]], float(scores[j])) for j in top.tolist() if scores[j] > -np.inf]
            frame = pd.DataFrame(found, columns=schema.names)
            yield from pa.Table.from_pandas(frame, arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(run, schema)


def search(cells: Cells, qvecs: DataFrame, k: int, probe: int, exact: bool = False, qkeys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Top k by cosine, ``(*qkeys, docno, score, rank)``: of the ``probe`` nearest cells, or of all (``exact``)."""
    qkeys = list(qkeys)
    dim = cells.centers.shape[1]
    q = qvecs.filter("vec is not null").select(*qkeys, F.col("vec").cast("array<double>").alias("vec"))
    chunks = max(1, math.ceil(q.count() * (8 * dim + 64) / max_bytes))
    schema = T.StructType([q.schema[c] for c in qkeys] + [cells.placed.schema["docno"], T.StructField("score", T.DoubleType())])
    out = None
    for c in range(chunks):
        rows = q.filter(F.pmod(F.xxhash64(*qkeys), F.lit(chunks)) == c).collect()  # one chunk: at most about max_bytes
        if not rows:
            continue
        names, m = [tuple(r[x] for x in qkeys) for r in rows], _unit(np.array([r["vec"] for r in rows], dtype=np.float64))
        edge = _edges(m, cells.centers, probe)
        part = _scan(cells, names, m, edge, k, schema)
        if exact and probe < len(cells.centers):
            # Without the copies the first round is a subset of the placed vectors; its k-th similarity bounds the rest.
            got = settled(ranked(part, qkeys, k).drop("rank"))
            kth = _kth(got, names, qkeys, k)
            part = got.unionByName(_scan(cells, names, m, edge, k, schema, kth)).groupBy(*qkeys, "docno").agg(F.max("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return ranked(out if out is not None else q.sparkSession.createDataFrame([], schema), qkeys, k)


def _kth(got: DataFrame, names: list, qkeys: list[str], k: int) -> np.ndarray:
    """The k-th similarity of each query of a chunk, -inf where there are fewer."""
    found = {tuple(r[x] for x in qkeys): r["s"] for r in got.groupBy(*qkeys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).collect()}  # one row a query of the chunk
    return np.array([found.get(n, -np.inf) for n in names])


def visited(cells: Cells, qvecs: DataFrame, run: DataFrame, k: int, probe: int, qkeys=("variant", "qid")) -> DataFrame:
    """``(*qkeys, cells, share)``: how many cells the exact search of ``run``'s queries reads."""
    qkeys = list(qkeys)
    worst = run.groupBy(*qkeys).agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    held = run.sparkSession.sparkContext.broadcast((cells.centers, cells.radius))
    rows = qvecs.filter("vec is not null").join(worst, qkeys).select(*qkeys, F.col("vec").cast("array<double>").alias("vec"), F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(-2.0)).alias("kth"))

    def count(batches):
        centers, radius = held.value
        for b in batches:
            q = _unit(matrix(b.column("vec")))
            if not len(q):
                continue
            near = q @ centers.T >= _edges(q, centers, probe)[:, None]
            read = near | (_bounds(q, centers, radius) >= b.column("kth").to_numpy()[:, None] - EPS)
            n = read.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in qkeys), pa.array(n.astype(np.int64)), pa.array(n / len(centers))], names=[*qkeys, "cells", "share"])

    schema = T.StructType([rows.schema[c] for c in qkeys] + [T.StructField("cells", T.LongType()), T.StructField("share", T.DoubleType())])
    return rows.mapInArrow(count, schema)


def enough(cells: Cells, qvecs: DataFrame, k: int, recall: float = RECALL, qkeys=("variant", "qid"), sample: int = SAMPLE_QUERIES) -> int:
    """The smallest number of nearest cells that holds ``recall`` of the exact top k of at most ``sample`` of the queries."""
    qkeys = list(qkeys)
    some = qvecs.filter("vec is not null").orderBy(F.xxhash64(*qkeys), *qkeys).limit(sample).select(*qkeys, F.array(F.col("vec").cast("array<double>")).alias("vecs"))
    some = settled(some)
    docs = cells.placed.filter("cell = first").select("docno", F.array("vec").alias("vecs"))
    true = exact_search(some, docs, k, qkeys, True).select(*qkeys, "docno")
    homes = cells.placed.select("docno", "cell").join(F.broadcast(settled(true)), "docno").select(*qkeys, "docno", "cell").collect()  # at most sample * k * copies rows
    order = {}
    for r in some.collect():  # at most `sample` rows
        near = _unit(np.array(r["vecs"], dtype=np.float64)) @ cells.centers.T
        order[tuple(r[c] for c in qkeys)] = np.argsort(np.argsort(-near[0], kind="stable"))
    best: dict = {}
    for r in homes:
        q = tuple(r[c] for c in qkeys)
        best[(q, r["docno"])] = min(best.get((q, r["docno"]), 1 << 30), int(order[q][r["cell"]]))
    need = np.sort(np.array(list(best.values()), dtype=np.int64))
    return int(need[max(0, math.ceil(recall * len(need)) - 1)]) + 1 if len(need) else 1
