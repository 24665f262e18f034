"""Integration checks and invariants on the smallest driver tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rankloom.operators import dense, feedback, lexical
from rankloom.plans import methods as M
from rankloom.plans import workspace as wsmod
from rankloom.plans.experiment import metrics_long
from rankloom.sources import results
from rankloom.sources.containment import contains_pairs

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def w(spark):
    return wsmod.workspace(spark, SF_SMALL)


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["variant", "metric", "value"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_containment_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("docno"), "text")
    pats = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    con = duckdb.connect()
    want = sorted(con.execute(
        f"SELECT b.item_id, d.doc_id FROM '{SF_SMALL}/benchmark.parquet' b "
        f"JOIN '{SF_SMALL}/documents.parquet' d ON contains(d.text, b.text)").fetchall())
    got = sorted((r["qid"], r["docno"]) for r in contains_pairs(docs, pats).collect())
    assert got == want and len(want) > 0
    # Without a broadcast budget the joins shuffle; the result must not change.
    assert sorted((r["qid"], r["docno"]) for r in contains_pairs(docs, pats, max_bytes=1).collect()) == want


def test_containment_of_short_and_odd_patterns(spark):
    docs = spark.createDataFrame([(1, "xfoo bar baz quxy"), (2, "foo\nbar  baz"), (3, None), (4, "a foo bar")], "docno long, text string")
    pats = spark.createDataFrame([(1, "foo bar baz qux"), (2, "oo b"), (3, "foo"), (4, ""), (5, None), (6, " bar baz"), (7, "bar  baz"), (8, "foo bar")], "qid long, text string")
    want = sorted((p, d) for p, t in [tuple(r) for r in pats.collect()] for d, x in [tuple(r) for r in docs.collect()] if t and x and t in x)
    for size in (1, 1 << 20):
        assert sorted((r["qid"], r["docno"]) for r in contains_pairs(docs, pats, max_bytes=size).collect()) == want
    assert contains_pairs(docs, pats.filter("qid = 4")).count() == 0


def test_run_invariants(w):
    run = w.bm25(100)
    per_q = run.groupBy("variant", "qid").agg(F.count("*").alias("n"), F.min("rank").alias("lo"),
                                               F.max("rank").alias("hi"),
                                               F.countDistinct("rank").alias("d")).collect()
    assert per_q
    for r in per_q:
        assert r["n"] <= 100 and r["lo"] == 1 and r["hi"] == r["n"] == r["d"]


def test_rerank_is_permutation(w):
    cands = M.candidates(w).select("variant", "qid", "docno")
    for name, run in M.method_runs(w).items():
        diff = run.select("variant", "qid", "docno").exceptAll(cands).count()
        assert diff == 0, name
        assert run.count() == cands.count(), name


def test_metric_ranges(w):
    long = metrics_long(w)
    vals = long.collect()
    assert vals and all(0.0 <= r["value"] <= 1.0 for r in vals)
    by = {(r["method"], r["variant"], r["metric"]): r["value"] for r in vals}
    for (m, v, metric), val in by.items():
        if metric == "R@10":
            assert val <= by[(m, v, "R@25")] <= by[(m, v, "R@50")]


def test_shuffle_partitions_do_not_change_results(spark, w):
    base = sorted(tuple(r) for r in lexical.bm25(w.prepared, w.topics, k=20).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in lexical.bm25(w.prepared, w.topics, k=20).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [(a[:3], a[4]) for a in base] == [(a[:3], a[4]) for a in one]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(base, one))


def test_split_topics_union_equals_joint_run(w):
    joint = sorted(tuple(r) for r in lexical.bm25(w.prepared, w.topics, k=10).select(
        "variant", "qid", "docno", "rank").collect())
    parts = []
    for v in ("title", "description", "narrative"):
        t = w.topics.filter(F.col("variant") == v)
        parts += [tuple(r) for r in lexical.bm25(w.prepared, t, k=10).select(
            "variant", "qid", "docno", "rank").collect()]
    assert sorted(parts) == joint


def test_probing_every_cell_is_exact(w):
    qv = M.query_vectors(w).filter(F.col("variant") == "narrative")
    dv = dense.hashed_vectors(w.prepared, ["docno"]).cache()
    exact = {(r["qid"], r["docno"]) for r in dense.exact_knn(qv, dv, 10).collect()}
    full = {(r["qid"], r["docno"]) for r in dense.ivf_knn(qv, dv, 10, n_cells=4, nprobe=4).collect()}
    assert full == exact  # probing every cell is exact


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ivf_recall_of_the_registered_parameters(spark, sf):
    w = wsmod.workspace(spark, f"/root/testdata/{sf}")
    qv, dv = M.query_vectors(w), dense.hashed_vectors(w.prepared, ["docno"]).cache()
    key = lambda df: {(r["variant"], r["qid"], r["docno"]) for r in df.collect()}
    exact = key(dense.exact_knn(qv, dv, 10))
    assert len(key(dense.ivf_knn(qv, dv, 10)) & exact) / len(exact) >= 0.9
    dv.unpersist()


def test_prf_reranker_keeps_candidates(w):
    first = w.bm25(100)
    rr = feedback.prf_reranker(w.index, w.topics, first)
    assert rr.select("variant", "qid", "docno").exceptAll(first.select("variant", "qid", "docno")).count() == 0
    exp = feedback.expansion_terms(first, w.index).groupBy("variant", "qid").count().collect()
    assert all(r["count"] <= feedback.FB_TERMS for r in exp)


def test_results_json_roundtrip_and_store(spark, w):
    long = metrics_long(w)
    path = results.scratch_path(spark, "test-json")
    results.write_results_json(long, path)
    back = results.read_results_json(spark, path)
    a = sorted((r["variant"], r["method"], r["metric"], r["value"]) for r in long.collect())
    b = sorted((r["variant"], r["method"], r["metric"], r["value"]) for r in back.collect())
    assert a == b
    key = ("test", path)
    s1 = results.materialize(long, "metrics", key)
    s2 = results.materialize(long.limit(0), "metrics", key)  # second call reads the stored table
    assert s1.count() == s2.count() == long.count()
    with pytest.raises(FileNotFoundError):
        results.require(spark, path + "-missing")


def test_bm25_reads_the_stored_index(w):
    run = lexical.bm25(w.index, w.topics, k=20)
    plan = run._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "documents.parquet" not in plan and "sort_array" not in plan  # no corpus scan, no term counting
    stored = sorted(tuple(r) for r in run.collect())
    direct = sorted(tuple(r) for r in lexical.bm25(w.prepared, w.topics, k=20).collect())
    assert [(a[:3], a[4], round(a[3], 6)) for a in stored] == [(a[:3], a[4], round(a[3], 6)) for a in direct]


def test_results_do_not_depend_on_broadcasts(w):
    from rankloom.operators import textprep

    run = w.bm25(20).filter("variant = 'title'")
    key = lambda df, c: sorted((r["qid"], r["docno"], r[c]) for r in df.collect())
    texts = textprep.attach_text(run, w.corpus)
    assert key(texts, "text") == key(textprep.attach_text(run, w.corpus, max_bytes=0), "text")
    qv, dv = M.query_vectors(w), dense.candidate_vectors(texts.select("docno", "text"))
    assert key(dense.score_vectors(texts, qv, dv), "dense_score") == key(dense.score_vectors(texts, qv, dv, max_bytes=0), "dense_score")
    psg = dense.hashed_vectors(dense.passages(texts.select("docno", "text").dropDuplicates(["docno"])), ["docno", "psg"])
    assert key(dense.maxp_scores(run, qv, psg), "dense_score") == key(dense.maxp_scores(run, qv, psg, max_bytes=0), "dense_score")
    assert sorted(map(tuple, lexical.bm25(w.index, w.topics, 5, max_bytes=0).select("variant", "qid", "docno", "rank").collect())) == \
        sorted(map(tuple, lexical.bm25(w.index, w.topics, 5).select("variant", "qid", "docno", "rank").collect()))


def test_rerankers_keep_the_depth_they_are_given(w):
    deep = w.only("description")
    want = {r["qid"]: r["count"] for r in deep.bm25(150).groupBy("qid").count().collect()}
    assert max(want.values()) > 100
    for name, run in M.method_runs(deep, 150).items():
        assert {r["qid"]: r["count"] for r in run.groupBy("qid").count().collect()} == want, name


def test_reset_releases_every_cached_table(spark):
    wsmod.reset()
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()  # noqa: E731,SLF001
    before = kept()
    M.candidates(wsmod.workspace(spark, SF_SMALL)).count()
    assert kept() > before
    wsmod.reset()
    assert kept() == before
