"""Stored tables: fingerprints, publication, segments, forward indexes; feedback on token vectors."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense, lexical, multivector, textprep
from rankloom.plans import methods as M
from rankloom.plans import workspace as wsmod
from rankloom.sources import collection as coll
from rankloom.sources import store

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def w(spark):
    return wsmod.workspace(spark, SF_SMALL)


def plan_of(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()  # noqa: SLF001


# ---- S9 ---------------------------------------------------------------------------

def copy_tables(to, *names):
    for n in names:
        shutil.copy(f"{SF_SMALL}/{n}.parquet", f"{to}/{n}.parquet")


def test_changed_data_of_equal_size_is_not_answered_from_an_old_index(spark, tmp_path):
    copy_tables(tmp_path, "benchmark", "labels")
    write = lambda text: spark.createDataFrame([(i, f"{text} {i}", "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write("apple pear")
    wsmod.reset()
    first = wsmod.workspace(spark, str(tmp_path)).index.term_stats
    assert {r["term"] for r in first.collect()} >= {"apple", "pear"}
    write("stone sand")
    wsmod.reset()
    again = {r["term"] for r in wsmod.workspace(spark, str(tmp_path)).index.term_stats.collect()}
    assert "stone" in again and "apple" not in again
    forward = wsmod.workspace(spark, str(tmp_path)).forward_terms
    assert {"stone"} <= {t for r in forward.collect() for t in r["words"]}


def test_a_writer_that_dies_leaves_no_table(spark):
    path = store.store_path(spark, "dies", ("x", os.getpid()))

    def dies(side):
        spark.range(3).write.parquet(side)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.publish(spark, path, dies)
    assert not store.complete(spark, path)
    got = store.materialize(lambda: spark.range(5), "dies", ("x", os.getpid()), spark)
    assert got.count() == 5
    late = store.publish(spark, path, spark.range(9).write.parquet)  # a second writer of the same table: the first one stays
    assert late is None and spark.read.parquet(path).count() == 5
    assert not [n for n in os.listdir(path.removeprefix("file:").rsplit("/", 1)[0]) if n.startswith("_dies") and os.path.exists(n)]


def test_an_unfinished_folder_is_replaced(spark):
    path = store.store_path(spark, "half", (os.getpid(),))
    spark.range(2).write.parquet(path)
    os.remove(path.removeprefix("file:") + "/_SUCCESS")
    assert store.materialize(lambda: spark.range(7), "half", (os.getpid(),), spark).count() == 7


def test_added_documents_extend_the_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder = f"{tmp_path}/documents.parquet"
    docs.filter("doc_id % 3 <> 0").coalesce(2).write.parquet(folder)
    prepare = lambda files: textprep.prepare_joined(coll.corpus_from_documents(spark.read.parquet(*files)))
    build = lambda: lexical.store_segments(spark, [folder], prepare, (folder,))
    one = store.segments(spark, "index", (folder,), folder)
    build()
    docs.filter("doc_id % 3 = 0").coalesce(1).write.mode("append").parquet(folder)
    two = store.segments(spark, "index", (folder,), folder)
    assert len(one) == 1 and len(two) == 2 and one[0] in two  # the old part keeps its number, so its tables
    grown, full = build(), lexical.build_index(textprep.prepare_joined(coll.corpus_from_documents(docs)))
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(grown.postings) == rows(full.postings) and rows(grown.term_stats) == rows(full.term_stats)
    assert np.allclose(rows(grown.coll_stats), rows(full.coll_stats))
    topics = coll.topics_from_benchmark(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
    key = lambda i: sorted((r["variant"], r["qid"], r["docno"], r["rank"]) for r in lexical.bm25(i, topics, 10).collect())
    assert key(grown) == key(full)
    assert store.segments(spark, "index", (folder,), folder) == two  # nothing new: nothing written
    docs.limit(5).coalesce(1).write.mode("overwrite").parquet(folder)
    assert len(store.segments(spark, "index", (folder,), folder)) == 1  # replaced: all anew


# ---- forward indexes ------------------------------------------------------------------

def test_rerankers_read_stored_vectors_only(w):
    run = w.bm25(20)
    run.count()
    for scored in (dense.score_stored(run, M.query_vectors(w), w.forward), dense.maxp_scores(run, M.query_vectors(w), w.forward_passages),
                   dense.maxsim_codes(run, dense.token_codes(w.topics, M.QKEYS, "query"), w.forward_terms), M.covered(w, run)):
        # What is kept in memory (the run, query vectors) is a leaf; beside it only stored tables are read.
        text = plan_of(scored, "optimizedPlan")
        assert "documents.parquet" not in text.split("InMemoryRelation")[0]
        assert "split(" not in text.split("InMemoryRelation")[0]


def test_stored_vectors_meet_candidates_without_an_exchange_of_theirs(spark, w):
    run = w.bm25(20).select("variant", "qid", "docno", "score", "rank")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        scored = dense.score_stored(run, M.query_vectors(w), w.forward, max_bytes=0)
        lines = plan_of(scored).split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    at = next(i for i, line in enumerate(lines) if "forward" in line and "Scan" in line and "Bucketed: true" in line)
    # Up from the scan to its join: no exchange on the way.
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            assert "Exchange" not in line, line
            if "Join" in line:
                break
    want = {(r["variant"], r["qid"], r["docno"]): r["dense_score"] for r in dense.score_stored(run, M.query_vectors(w), w.forward).collect()}
    got = {(r["variant"], r["qid"], r["docno"]): r["dense_score"] for r in scored.collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)


def test_candidates_without_a_stored_row_score_zero(spark, w):
    run = spark.createDataFrame([("title", 0, -5, 1.0, 1)], "variant string, qid long, docno long, score double, rank long")
    assert dense.score_stored(run, M.query_vectors(w), w.forward).first()["dense_score"] == 0.0
    assert M.covered(w, run).first()["pointwise"] == 0.0


def test_hashed_vectors_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(3)
    words = ["the", "Cat", "sät", "x1", "mat"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(50)] + [None, "", "..."]
    d = spark.createDataFrame(list(enumerate(texts)), "docno long, text string").repartition(3)
    for r in dense.hashed_vectors(d, ["docno"]).collect():
        v = np.zeros(dense.DIM)
        for t in (texts[r["docno"]] or "").lower().replace(".", " ").split():
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            v[h % dense.DIM] += 1 if h // dense.DIM % 2 == 0 else -1
        assert r["vec"] == v.tolist() and abs(r["norm"] - np.linalg.norm(v)) < 1e-12


# ---- D7, D9, D10 -------------------------------------------------------------------------

def test_feedback_brute_force(w):
    index = w.token_index
    queries = multivector.query_vectors(index.filter("docno % 25 = 0"))
    run = multivector.search(queries, index, 10)
    docs = {r["docno"]: r["tokens"] for r in index.collect()}
    mats = {d: np.array([t["vec"] for t in ts]) for d, ts in docs.items()}
    df = {}
    for ts in docs.values():
        for t in {t["term"] for t in ts}:
            df[t] = df.get(t, 0) + 1
    best = {}
    for r in run.collect():
        best.setdefault(r["qid"], []).append((r["rank"], r["docno"]))
    ranked = multivector.feedback_ranker(queries, run, index, 10, clusters=5, fb_embs=2, rounds=4).collect()
    again = multivector.feedback_reranker(queries, run, index, clusters=5, fb_embs=2, rounds=4).collect()
    for q, got in best.items():
        rows = [(d, t) for d in sorted(d for rank, d in got if rank <= 3) for t in docs[d]]
        x = np.array([t["vec"] for _, t in rows])
        c = multivector.kmeans(x, 5, 4)
        names = [rows[int(np.round(((x - v) ** 2).sum(axis=1), 9).argmin())][1]["term"] for v in c]
        idf = [np.log((len(docs) + 1) / (df[n] + 1)) for n in names]
        keep = sorted(range(len(c)), key=lambda i: (-round(idf[i], 9), i))[:2]
        qv, qw = np.vstack([mats[q], c[keep]]), np.array([1.0] * len(mats[q]) + [idf[i] for i in keep])
        score = {d: float(((qv @ m.T).max(axis=1) * qw).sum()) for d, m in mats.items()}
        order = sorted(score, key=lambda d: (-round(score[d], 6), -d))[:10]
        mine = sorted((r["rank"], r["docno"], r["score"]) for r in ranked if r["qid"] == q)
        assert [d for _, d, _ in mine] == order and all(abs(s - score[d]) < 1e-9 for _, d, s in mine)
        mine = sorted((r["rank"], r["docno"], r["score"]) for r in again if r["qid"] == q)
        assert [d for _, d, _ in mine] == sorted((d for _, d in got), key=lambda d: (-round(score[d], 6), -d))


def test_feedback_without_weight_is_plain_maxsim(w):
    index = w.token_index
    queries = multivector.query_vectors(index.filter("docno % 25 = 0"))
    run = multivector.search(queries, index, 10)
    key = lambda df: sorted((r["qid"], r["docno"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert key(multivector.feedback_reranker(queries, run, index, beta=0.0)) == key(run)
    assert key(multivector.rerank(run, queries, index)) == key(run)
    assert key(multivector.rerank(run, queries, index, max_bytes=0)) == key(run)


def test_queries_without_feedback_stay_as_they_are(spark, w):
    queries = multivector.query_vectors(w.token_index.filter("docno = 0"))
    none = spark.createDataFrame([], "qid long, docno long, score double, rank long")
    got = multivector.expand(queries, none, w.token_index).collect()
    assert [len(r["vecs"]) for r in got] == [4] and got[0]["weights"] == [1.0] * 4


def test_clusters_of_few_and_equal_vectors():
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert multivector.kmeans(x, 9).tolist() == x.tolist()  # an empty cluster keeps its start
    assert multivector.kmeans(x[:0], 3).shape == (0, 2)
