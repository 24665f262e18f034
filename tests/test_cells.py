"""Cells: exact search with bounds, measured recall, copies, hot cells, token vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import cells, multivector
from rankloom.plans import workspace as wsmod

from .conftest import SF_SMALL


def clustered(rng, n, dim, groups, spread):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + spread * 0.1 * rng.normal(size=(n // 3, dim))  # a third of all vectors in one place
    return x


def frame(spark, x, key):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{key} long, vec array<double>").repartition(5)


def brute(q, x, k):
    u = lambda m: m / np.maximum(1e-300, np.linalg.norm(m, axis=1, keepdims=True))
    s = np.round(u(q) @ u(x).T, 6)
    return {i: [int(d) for d in sorted(range(len(x)), key=lambda d: (-s[i, d], -d))[:k]] for i in range(len(q))}


def by_query(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["docno"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = clustered(rng, 900, 8, 12, 0.15)
    x[5] = x[6] = x[7]  # ties
    x[8] = 0  # no direction
    return x, np.vstack([x[::60] + 0.05 * rng.normal(size=x[::60].shape), np.zeros((1, 8))])


def test_bounded_search_is_exact_and_reads_few_cells(spark, data):
    x, q = data
    found = cells.build(frame(spark, x, "docno"), 30)
    qv = frame(spark, q, "qid")
    for probe in (1, 3):
        run = cells.search(found, qv, 7, probe, exact=True, qkeys=("qid",)).cache()
        assert by_query(run) == brute(q, x, 7)
    share = {r["qid"]: r["share"] for r in cells.visited(found, qv, run, 7, 3, ("qid",)).collect()}
    assert np.mean([s for i, s in share.items() if i < len(q) - 1]) < 0.6  # clustered vectors: bounds prune
    chunks = cells.search(found, qv, 7, 3, exact=True, qkeys=("qid",), max_bytes=400)
    assert by_query(chunks) == brute(q, x, 7)  # queries in many chunks


def test_copies_count_once_and_help(spark, data):
    x, q = data
    truth = brute(q, x, 7)
    recall = {}
    for copies in (1, 2):
        found = cells.build(frame(spark, x, "docno"), 30, copies=copies)
        assert found.placed.count() == copies * len(x)
        run = cells.search(found, frame(spark, q, "qid"), 7, 2, qkeys=("qid",))
        got = by_query(run)
        assert all(len(set(d)) == len(d) for d in got.values())
        recall[copies] = np.mean([d in truth[i] for i in got for d in got[i]])
    assert recall[2] >= recall[1]


def test_measured_number_of_cells_reaches_its_recall(spark, data):
    x, q = data
    found = cells.build(frame(spark, x, "docno"), 30)
    qv = frame(spark, q, "qid")
    n = cells.enough(found, qv, 7, 0.95, ("qid",))
    truth, got = brute(q, x, 7), by_query(cells.search(found, qv, 7, n, qkeys=("qid",)))
    assert n < 30 and np.mean([len(set(truth[i]) & set(got[i])) / 7 for i in truth]) >= 0.93


def test_a_hot_cell_is_many_tasks_work(spark, data):
    x, _ = data
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be joined
    spark.conf.set(name, "false")
    try:
        found = cells.build(frame(spark, x, "docno"), 6)
    finally:
        spark.conf.unset(name)
    cell = found.placed.filter("cell = first").groupBy("cell").count().orderBy(F.desc("count")).first()["cell"]
    parts = found.placed.filter(F.col("cell") == cell).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_small_and_empty_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "docno long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "qid long, vec array<double>")
    found = cells.build(one)
    assert by_query(cells.search(found, q, 5, 1, exact=True, qkeys=("qid",))) == {1: [1]}
    none = cells.build(one.limit(0))
    assert cells.search(none, q.limit(0), 5, 1, qkeys=("qid",)).count() == 0


def test_token_cells_propose_enough_documents(spark):
    w = wsmod.workspace(spark, SF_SMALL)
    index = w.token_index
    queries = multivector.query_vectors(index.filter("docno % 25 = 0"))
    key = lambda df: {(r["qid"], r["docno"]) for r in df.collect()}
    exact = key(multivector.search(queries, index, 10))
    found = cells.build(multivector.token_vectors(index))
    got = key(multivector.rerank(multivector.propose(queries, found, 40), queries, index, k=10))
    assert len(got & exact) / len(exact) >= 0.9
