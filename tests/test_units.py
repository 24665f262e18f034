"""Unit goldens from the hand-checkable micro fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import analysis as A
from rankloom.operators import dense, evaluate, fusion, lexical, rerank, textprep
from rankloom.sources import collection, results

from .conftest import rows


def corpus_df(spark):
    return spark.createDataFrame(
        [("a", "T", "A"), ("b", "T", None), ("c", "", "A"), ("d", "", "")],
        "docno string, title string, abstract string")


def test_text_preparation(spark):
    c = corpus_df(spark)
    assert rows(textprep.prepare_joined(c), "docno", "text") == [("a", "T A"), ("b", "T"), ("c", "A"), ("d", "")]
    assert rows(textprep.prepare_concat(c, " "), "doc_id", "text") == [("a", "T A"), ("b", "T"), ("c", "A"), ("d", "")]
    assert rows(textprep.prepare_concat(c, "\n", drop_empty=True, id_col="docno"), "docno", "text") == [
        ("a", "T\nA"), ("b", "T"), ("c", "A")]
    cands = spark.createDataFrame([("q", d) for d in "abcdz"], "qid string, docno string")
    assert rows(textprep.attach_text(cands, c), "docno", "text") == [
        ("a", "A"), ("b", "T"), ("c", "A"), ("d", ""), ("z", "")]


def test_attach_text_last_row_wins(spark):
    c = spark.createDataFrame([("a", "old", "x", 1), ("a", "new", "y", 2), ("", "blank", "b", 3)],
                              "docno string, title string, abstract string, seq int")
    cands = spark.createDataFrame([("q", "a"), ("q", "")], "qid string, docno string")
    assert rows(textprep.attach_text(cands, c, order_col="seq"), "docno", "text") == [("", ""), ("a", "y")]


def test_ensure_text_and_repair(spark):
    df = spark.createDataFrame([("q1", "hello")], "qid string, query string")
    assert textprep.ensure_text(df).first()["text"] == "hello"
    t = spark.createDataFrame([("1", "short", "long words")], "qid string, title string, description string")
    assert collection.repair_query_column(t).first()["query"] == "long words"
    with pytest.raises(ValueError):
        collection.repair_query_column(t.drop("description"))


def bm25_corpus(spark):
    return spark.createDataFrame([("a", "cat cat dog"), ("b", "dog bird"), ("c", "fish"),
                                  ("d", "bird fish fish fish")], "docno string, text string")


@pytest.mark.parametrize("query,expected", [
    ("cat", {"a": 1.591280}),
    ("cat dog", {"a": 1.591280, "b": 0.0}),
    ("cat cat", {"a": 2.864304}),
])
def test_bm25_golden(spark, query, expected):
    topics = spark.createDataFrame([("q", query)], "qid string, query string")
    run = lexical.bm25(bm25_corpus(spark), topics, k=10, keys=("qid",))
    got = {r["docno"]: round(r["score"], 6) for r in run.collect()}
    assert got == expected


def test_bm25_plan_has_group_limit_and_broadcast(spark):
    topics = spark.createDataFrame([("q", "cat dog")], "qid string, query string")
    run = lexical.bm25(bm25_corpus(spark), topics, k=10, keys=("qid",))
    plan = run._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    run.collect()
    plan = plan + run._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "WindowGroupLimit" in plan and "Broadcast" in plan


def test_term_counts_and_collection_stats(spark):
    c = bm25_corpus(spark)
    post = rows(lexical.postings(c), "docno", "term", "tf")
    assert ("a", "cat", 2) in post and ("d", "fish", 3) in post and len(post) == 7
    st = lexical.collection_stats(c).first()
    assert (st["n_docs"], st["total_len"], st["avgdl"], st["n_terms"]) == (4, 10, 2.5, 4)


def metric_fixture(spark):
    qrels = spark.createDataFrame(
        [("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d3", 0), ("q1", "d4", 1), ("q2", "d2", 1),
         ("q3", "d9", 1), ("q4", "d1", 0)], "qid string, docno string, rel int")
    run = spark.createDataFrame(
        [("q1", "d3", 9.0), ("q1", "d1", 8.0), ("q1", "d5", 7.0), ("q1", "d2", 7.0), ("q1", "d4", 6.0),
         ("q2", "d1", 3.0), ("q2", "d2", 2.0), ("q4", "d1", 1.0), ("q5", "d1", 1.0)],
        "qid string, docno string, score double")
    return run, qrels


def test_metrics_golden(spark):
    run, qrels = metric_fixture(spark)
    ms = ["RR@10", "nDCG@10", "nDCG@3", "AP@100", "AP@2", "R@2", "R@10", "P@10"]
    pq = {r["qid"]: r for r in evaluate.per_query(run, qrels, ms, keys=()).collect()}
    assert round(pq["q1"]["nDCG@10"], 6) == 0.664144
    assert round(pq["q1"]["nDCG@3"], 6) == 0.403030
    assert round(pq["q1"]["AP@100"], 6) == 0.533333
    assert round(pq["q1"]["AP@2"], 6) == 0.166667
    assert round(pq["q2"]["nDCG@10"], 6) == 0.630930
    means = {r["metric"]: round(r["value"], 6) for r in evaluate.evaluate(run, qrels, ms, keys=()).collect()}
    assert means == {"RR@10": 0.25, "nDCG@10": 0.323768, "nDCG@3": 0.25849, "AP@100": 0.258333,
                     "AP@2": 0.166667, "R@2": 0.333333, "R@10": 0.5, "P@10": 0.1}


def test_metric_names():
    assert evaluate.parse_measure("ndcg_cut.10").kind == "nDCG"
    assert evaluate.parse_measure("map").k is None
    assert evaluate.parse_measure("P.10").k == 10
    with pytest.raises(ValueError):
        evaluate.parse_measure("bogus")


def test_fusion_golden(spark):
    df = spark.createDataFrame([("q", "a", 12.0, 0.9), ("q", "b", 10.0, 0.1), ("q", "c", 8.0, 0.5)],
                               "qid string, docno string, score double, dense double")
    f2 = {r["docno"]: (round(r["bm25_norm"], 6), round(r["score"], 6))
          for r in fusion.convex_fusion(df, "dense", 0.2, keys=("qid",)).collect()}
    assert f2 == {"a": (1.0, 0.98), "b": (0.5, 0.42), "c": (0.0, 0.1)}
    f3 = {r["docno"]: round(r["score"], 6) for r in fusion.interpolate(df, "dense", 0.2, keys=("qid",)).collect()}
    assert f3 == {"a": 3.12, "b": 2.08, "c": 2.0}
    one = spark.createDataFrame([("q", "a", 3.0), ("r", "x", 1.0), ("r", "y", 1.0)],
                                "qid string, docno string, score double")
    assert {r["bm25_norm"] for r in fusion.minmax_norm(one, keys=("qid",)).collect()} == {1.0}


def test_vectors(spark):
    cands = spark.createDataFrame([("q", "x"), ("q", "y"), ("q", "z")], "qid string, docno string")
    qt = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "qid string, pos int, vec array<double>")
    dt = spark.createDataFrame([("x", 0, [0.6, 0.8]), ("x", 1, [1.0, 0.0]), ("y", 0, [0.0, 1.0]),
                                ("z", 0, [0.8, 0.6])], "docno string, pos int, vec array<double>")
    got = {r["docno"]: round(r["li_score"], 6) for r in dense.maxsim_dense(cands, qt, dt, ("qid",)).collect()}
    assert got == {"x": 1.8, "y": 1.0, "z": 1.4}
    qv = spark.createDataFrame([("q", [0.0, 0.0], 0.0)], "qid string, vec array<double>, norm double")
    dv = spark.createDataFrame([("x", [1.0, 0.0], 1.0)], "docno string, vec array<double>, norm double")
    s = dense.score_vectors(cands.filter("docno = 'x'"), qv, dv, "cosine", ("qid",)).first()
    assert s["dense_score"] == 0.0


def test_maxsim_codes_matches_dense_form(spark):
    dim = 8
    docs = spark.createDataFrame([("x", "alpha beta gamma"), ("y", "delta"), ("z", "alpha alpha")],
                                 "docno string, text string")
    topics = spark.createDataFrame([("q", "alpha delta omega")], "qid string, query string")
    cands = spark.createDataFrame([("q", d) for d in "xyz"], "qid string, docno string")
    qc = dense.token_codes(topics, ["qid"], "query", dim)
    dc = dense.token_codes(docs, ["docno"], "text", dim, distinct=True)
    fast = {r["docno"]: r["li_score"] for r in dense.maxsim_codes(cands, qc, dc, ("qid",)).collect()}

    def onehot(codes_df, key):
        ex = codes_df.select(*key, F.posexplode("codes").alias("pos", "code"))
        vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                          lambda i: F.when(F.floor(F.col("code") / 2) == i,
                                           F.when(F.col("code") % 2 == 1, 1.0).otherwise(-1.0)).otherwise(0.0))
        return ex.select(*key, "pos", vec.alias("vec"))

    slow = {r["docno"]: r["li_score"] for r in
            dense.maxsim_dense(cands, onehot(qc, ["qid"]), onehot(dc, ["docno"]), ("qid",)).collect()}
    assert fast == slow


def test_pairwise_and_pointwise(spark):
    df = spark.createDataFrame([("q", "a", "cat dog", "cat"), ("q", "b", "cat dog", "cat dog"),
                                ("q", "c", "cat dog", "fish")], "qid string, docno string, query string, text string")
    pw = {r["docno"]: r["score"] for r in rerank.pointwise(df, keys=("qid",)).collect()}
    assert pw == {"a": 0.5, "b": 1.0, "c": 0.0}
    pr = {r["docno"]: round(r["score"], 6) for r in rerank.pairwise(rerank.pointwise(df, keys=("qid",)),
                                                                    keys=("qid",)).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    assert pr["b"] == round(sig(0.5) + sig(1.0), 6)
    assert pr["c"] == round(sig(-1.0) + sig(-0.5), 6)


DESCRIPTION = {
    "BM25": {"RR@10": 0.8771666666666667, "nDCG@10": 0.6232562560098154, "AP@100": 0.07753780503920846,
             "mrt": 24.533413999999993, "R@50": 0.06653023444787304},
    "BM25 >> TCT-ColBERT % 100": {"RR@10": 0.8723333333333333, "nDCG@10": 0.6581198462431217,
                                  "AP@100": 0.08256267709656433, "mrt": 133.21808799999985,
                                  "R@50": 0.07077405961488768},
    "BM25 >> MINILM % 100": {"RR@10": 0.9031666666666667, "nDCG@10": 0.6501256569707335,
                             "AP@100": 0.07999800754011989, "mrt": 106.34471199999979,
                             "R@50": 0.06884129549509219},
    "BM25 >> MonoT5 % 100": {"RR@10": 0.8666666666666667, "nDCG@10": 0.7222497206448882,
                             "AP@100": 0.08524993723483877, "mrt": 966.7601299999998,
                             "R@50": 0.07358940537448713},
    "BM25 >> TasB % 100": {"RR@10": 0.8736666666666667, "nDCG@10": 0.6814911257012192,
                           "AP@100": 0.08415518025547158, "mrt": 385.89673599999963,
                           "R@50": 0.07260853003831741},
}


def published_long(spark, tmp_path):
    path = str(tmp_path / "results")
    data = [("description", json.dumps(DESCRIPTION))]
    spark.createDataFrame(data, "variant string, value string").write.partitionBy("variant").text(path)
    return results.read_results_json(spark, path)


def test_analysis_goldens(spark, tmp_path):
    long = published_long(spark, tmp_path)
    pct = {(r["method"], r["metric"]): round(r["pct"], 4)
           for r in A.clean_names(A.pct_vs_baseline(long)).collect()}
    assert pct[("TCT-ColBERT", "RR@10")] == -0.5510
    assert pct[("MonoT5", "mrt")] == 3840.5854
    assert pct[("TasB", "AP@100")] == 8.5344
    mm = {(r["method"], r["metric"]): r["norm_value"] for r in A.minmax_across_methods(long).collect()}
    assert round(mm[("BM25", "RR@10")], 6) == 0.287671
    assert round(mm[("BM25 >> TasB % 100", "R@50")], 6) == 0.861049
    rk = {(r["method"], r["metric"]): r["rank"] for r in A.rank_methods(long).collect()}
    assert [rk[("BM25", m)] for m in ("RR@10", "nDCG@10", "AP@100", "R@50")] == [2, 5, 5, 5]
    assert [rk[("BM25 >> MINILM % 100", m)] for m in ("RR@10", "nDCG@10", "AP@100", "R@50")] == [1, 4, 4, 4]


def test_average_rank_ties(spark):
    long = spark.createDataFrame([("t", "BM25", "RR@10", 0.8088888888888889),
                                  ("t", "MINILM", "RR@10", 0.8088888888888889),
                                  ("t", "MonoT5", "RR@10", 0.8563333333333333),
                                  ("t", "TasB", "RR@10", 0.78)], "variant string, method string, metric string, value double")
    rk = {r["method"]: r["rank"] for r in A.rank_methods(long).collect()}
    assert rk == {"MonoT5": 1.0, "BM25": 2.5, "MINILM": 2.5, "TasB": 4.0}


def test_minmax_zero_range_is_null(spark):
    long = spark.createDataFrame([("t", "a", "m", 0.5), ("t", "b", "m", 0.5)],
                                 "variant string, method string, metric string, value double")
    assert {r["norm_value"] for r in A.minmax_across_methods(long).collect()} == {None}


def test_trec_run_lines(spark):
    run = spark.createDataFrame([(1, 7, 1, 2.5)], "qid long, docno long, rank long, score double")
    assert results.trec_run_lines(run, "BM25").first()["line"] == "1 Q0 7 1 2.500000 BM25"


def test_rename_fires_on_published_labels(spark, tmp_path):
    got = {(r["method"], r["metric"]) for r in A.label(published_long(spark, tmp_path)).collect()}
    assert ("BM25 >> SBERT % 100", "mrt (ms)") in got
    assert not any(m == "BM25 >> MINILM % 100" or x == "mrt" for m, x in got)


def test_methods_and_queries_without_hits_count_zero(spark):
    run, qrels = metric_fixture(spark)
    two = run.withColumn("method", F.lit("a")).unionByName(run.filter("qid = 'q5'").withColumn("method", F.lit("b")))
    pq = evaluate.per_query(two, qrels, ["RR@10", "map", "P@5"], keys=("method",)).collect()
    assert len(pq) == 2 * 4
    assert all(r["RR@10"] == r["map"] == r["P@5"] == 0 for r in pq if r["method"] == "b" or r["qid"] in ("q3", "q4"))
    means = {(r["method"], r["metric"]): r["value"] for r in evaluate.evaluate(two, qrels, ["RR@10"], keys=("method",)).collect()}
    assert means == {("a", "RR@10"): 0.25, ("b", "RR@10"): 0.0}


def test_fusion_limits_and_equal_topic_texts(spark):
    df = spark.createDataFrame([(q, d, s, x) for q in ("q1", "q2") for d, s, x in (("a", 12.0, 0.1), ("b", 10.0, 0.9), ("c", 8.0, 0.5))],
                               "qid string, docno string, score double, dense double").withColumn("query", F.lit("same words"))
    order = lambda out: [r["docno"] for r in out.filter("qid = 'q2'").orderBy("rank").collect()]
    assert order(fusion.convex_fusion(df, "dense", 0.0, keys=("qid",))) == ["a", "b", "c"]
    assert order(fusion.convex_fusion(df, "dense", 1.0, keys=("qid",))) == ["b", "c", "a"]
    assert order(fusion.interpolate(df, "dense", 1.0, keys=("qid",))) == ["a", "b", "c"]
    two = fusion.convex_fusion(df, "dense", 0.2, keys=("qid",))
    assert rows(two.groupBy("qid").count(), "qid", "count") == [("q1", 3), ("q2", 3)]  # equal texts stay two topics
    chained = fusion.compose(df, lambda d: d.filter("docno <> 'a'"), lambda d: d.withColumn("n", F.lit(1)))
    assert chained.count() == 4 and "n" in chained.columns


def test_text_field_null_text_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([("q", "a", "cat dog", "none", "cat dog"), ("q", "b", "cat dog", "cat", None)],
                               "qid string, docno string, query string, text string, abstract string")
    other = {r["docno"]: r["score"] for r in rerank.pointwise(textprep.ensure_text(df, "abstract"), "abstract", ("qid",)).collect()}
    assert other == {"a": 1.0, "b": 0.0}  # P7: another field; P9: a null text is empty
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", "T", "A", "unused")], "docno string, title string, abstract string, extra string").write.parquet(path)
    plan = textprep.prepare_joined(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "ReadSchema" in plan and "extra" not in plan.split("ReadSchema")[1]  # P12


class LengthEncoder(dense.Encoder):
    dim = 2

    def encode(self, texts):
        import numpy as np

        return np.array([[len(t), 1.0] for t in texts])


def length_scorer():
    return lambda queries, texts: [len(t) - len(q) for q, t in zip(queries, texts)]


def longer_scorer():
    return lambda queries, a, b: [float(len(x) > len(y)) for x, y in zip(a, b)]


def test_model_interfaces(spark):
    df = spark.createDataFrame([("q", d, "qq", t, 1.0) for d, t in (("a", "xxx"), ("b", "x"), ("c", None))], "qid string, docno string, query string, text string, score double")
    dense.register_encoder("length", LengthEncoder)
    for enc in ("length", LengthEncoder):  # by name (D11) and as a factory (U2), one text at a time and batched (X4)
        for size in (1, 32):
            got = {r["docno"]: (r["vec"], round(r["norm"], 4)) for r in dense.encode_with(df, enc, ["docno"], batch_size=size).collect()}
            assert got == {"a": ([3.0, 1.0], 3.1623), "b": ([1.0, 1.0], 1.4142), "c": ([0.0, 1.0], 1.0)}
    assert isinstance(dense.encoder("length"), LengthEncoder)
    with pytest.raises(KeyError):
        dense.encoder("missing")
    got = {r["docno"]: r["model_score"] for r in rerank.score_pairs_with(df, length_scorer, batch_size=2).collect()}
    assert got == {"a": 1.0, "b": -1.0, "c": -2.0}
    pair = rerank.pairwise_with(df, longer_scorer, keys=("qid",), depth=3).orderBy("rank").collect()
    assert [(r["docno"], r["score"]) for r in pair] == [("a", 2.0), ("b", 1.0), ("c", 0.0)]


def test_shared_folder_is_required_on_a_cluster():
    from rankloom import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_library_gathers_only_what_is_bounded():
    """Every collect in the library says on its line what bounds it."""
    import pathlib
    import re

    for path in pathlib.Path(A.__file__).parents[1].rglob("*.py"):
        for n, line in enumerate(path.read_text().splitlines(), 1):
            if re.search(r"\.(collect|toPandas|toLocalIterator|toArrow)\(\)", line):
                assert "#" in line or ".limit(" in line or ".orderBy(" in line and "ends" in line, f"{path}:{n}"


def test_stop_words_leave_the_postings(spark):
    stop = spark.createDataFrame([("dog",)], "term string")
    topics = spark.createDataFrame([("q", "cat dog")], "qid string, query string")
    run = lexical.bm25(lexical.build_index(bm25_corpus(spark), stop_words=stop), topics, k=10, keys=("qid",))
    assert [r["docno"] for r in run.collect()] == ["a"]


def test_search_in_chunks_and_beyond_the_bound(spark):
    q = spark.createDataFrame([(i, [[float(i), 1.0]]) for i in range(9)], "qid long, vecs array<array<double>>")
    d = spark.createDataFrame([(i, [[1.0, float(i)], [0.5, 0.5]]) for i in range(30)], "docno long, vecs array<array<double>>")
    one = sorted(map(tuple, dense.exact_search(q, d, 4, ("qid",)).collect()))
    assert one == sorted(map(tuple, dense.exact_search(q, d, 4, ("qid",), max_bytes=100).collect()))
