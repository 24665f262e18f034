"""JSON corpora, result files, observed counts, deep top k, the large BM25 grid, keys of the analysis."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import analysis as A
from rankloom.operators import evaluate as ev
from rankloom.operators import lexical, tuning
from rankloom.plans import sizing
from rankloom.plans import workspace as wsmod
from rankloom.sources import jsoncorpus, results

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def w(spark):
    return wsmod.workspace(spark, SF_SMALL)


# ---- S1 ----------------------------------------------------------------------------

LINES = ['{"docno": "a", "title": "T", "abstract": "A"}', '{"docno": "b", "title": null, "extra": [1]}', '{"docno": "c", "title": "x"', "not json", '{"title": "no docno"}',
         '{"docno": {"n": 1}, "title": "object"}', "", '{"docno": "d", "abstract": "line\\nfeed \\u00e9"}', "[1, 2]"]


def test_json_corpus_keeps_broken_lines_apart(spark, tmp_path):
    (tmp_path / "one.json").write_text("\n".join(LINES[:5]))
    (tmp_path / "two.json").write_text("\n".join(LINES[5:]))
    good, rejected = jsoncorpus.read_json_corpus(spark, str(tmp_path))
    assert good.columns == ["docno", "title", "abstract"]
    rows = {r["docno"]: (r["title"], r["abstract"]) for r in good.collect()}
    bad = {r["line"]: os.path.basename(r["file"]) for r in rejected.collect()}
    assert {"a", "b", "d"} <= set(rows) and rows["a"] == ("T", "A") and rows["b"] == (None, None) and rows["d"] == (None, "line\nfeed é")
    assert {LINES[2]: "one.json", LINES[3]: "one.json", LINES[4]: "one.json", LINES[8]: "two.json"}.items() <= bad.items()
    assert {r["name"]: r["n"] for r in jsoncorpus.load_counts(good, rejected).collect()} == {"documents": len(rows), "rejected": len(bad)}
    assert len(rows) + len(bad) == sum(bool(x) for x in LINES)


def test_pages_corpus(spark):
    html = "<html><head><title> A &lt;b&gt; &amp;amp;\n T</title><style>x{}</style></head><body><p>one</p><script>if (a<b) x()</script><!-- no -->two&quot;</body></html>"
    d = spark.createDataFrame([(1, html), (2, None), (3, "no markup"), (4, "")], "page_id long, html string")
    got = {r["docno"]: (r["title"], r["abstract"]) for r in jsoncorpus.corpus_from_pages(d).collect()}
    assert got == {1: ("A <b> &amp; T", 'one two"'), 2: ("", ""), 3: ("", "no markup"), 4: ("", "")}


# ---- S6-S8 ---------------------------------------------------------------------------

# Published results in the published file layout (an excerpt).
PUBLISHED = """{
    "BM25": {
        "RR@10": 0.8088888888888889,
        "nDCG@10": 0.6018465293180778,
        "AP@100": 0.07607961158827084,
        "mrt": 21.575595999999955
    },
    "BM25 >> TCT-ColBERT % 100": {
        "RR@10": 0.7818333333333334
    }
}
"""


def test_result_files_by_name(spark, tmp_path, w):
    (tmp_path / "published_results_title.json").write_text(PUBLISHED)
    (tmp_path / "notes.json").write_text("{}")
    got = {(r["variant"], r["method"], r["metric"]): r["value"] for r in results.read_results_json(spark, str(tmp_path)).collect()}
    assert got[("title", "BM25", "AP@100")] == 0.07607961158827084 and len(got) == 5
    long = spark.createDataFrame([("title", "X", "m", 1.0), ("narrative", "BM25 >> x", "RR@10", 0.25), ("narrative", "Y", "RR@10", 0.5)], "variant string, method string, metric string, value double")
    assert results.write_results_json(long, str(tmp_path), "published_results") == ["published_results_narrative.json"]  # the other is there
    assert json.loads((tmp_path / "published_results_narrative.json").read_text()) == {"BM25 >> x": {"RR@10": 0.25}, "Y": {"RR@10": 0.5}}
    assert (tmp_path / "published_results_title.json").read_text() == PUBLISHED
    assert results.read_results_json(spark, str(tmp_path)).count() == 7
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["notes.json", "published_results_narrative.json", "published_results_title.json"]


def test_counts_are_read_not_made(w):
    counts = w.counts()
    plan = counts._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "documents.parquet" not in plan and "split(" not in plan.split("InMemoryRelation")[0]
    got = {r["name"]: r["n"] for r in counts.collect()}
    assert got["documents"] == w.table("documents").count() and got["qrels"] == w.judged().count()
    assert got["postings"] == lexical.postings(w.prepared).count() and got["bm25_top100"] == w.bm25(100).count()
    assert got["topics"] == 3 * w.table("benchmark").count()


# ---- L6, L7 ----------------------------------------------------------------------------

def test_deep_cuts_keep_a_partial_limit(spark):
    rng = np.random.default_rng(4)
    rows = [(int(q), int(d), float(s)) for q, d, s in zip(rng.integers(0, 3, 6000), rng.integers(0, 10**6, 6000), np.round(rng.random(6000), 2) + rng.choice([0, 1e-8, 3e-7], 6000))]
    d = spark.createDataFrame(rows, "qid long, docno long, score double").dropDuplicates(["qid", "docno"]).cache()
    d.count()
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(name)
    try:
        for k in (1, 7, 500, 1500):
            spark.conf.set(name, "1000000")
            plain = sorted(map(tuple, lexical.ranked(d, ["qid"], k).collect()))
            spark.conf.set(name, str(min(1000, k - 1)))
            deep = lexical.ranked(d, ["qid"], k)
            plan = deep._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
            assert "MapInArrow" in plan and plan.index("Exchange hashpartitioning(qid") < plan.index("MapInArrow")  # below the exchange, printed after it
            assert sorted(map(tuple, deep.collect())) == plain
        kept = lexical.partial_top(d.repartition(4), ["qid"], 50).count()
        assert 150 <= kept < 4 * 3 * 50 * 1.5
    finally:
        spark.conf.set(name, old)


def test_partial_top_lets_go_when_it_holds_much(spark, monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 100)
    d = spark.createDataFrame([(q, i, float(i % 13)) for q in range(40) for i in range(60)], "qid long, docno long, score double").coalesce(1)
    want = sorted(map(tuple, lexical.ranked(d, ["qid"], 20).collect()))
    assert sorted(map(tuple, lexical.ranked(lexical.partial_top(d, ["qid"], 20), ["qid"], 20).collect())) == want


# ---- M12 ----------------------------------------------------------------------------------

def test_large_grid_equals_single_runs(spark, w):
    k1s, bs, k3s = (0.3, 1.2, 2.0), (0.0, 0.75, 1.0), (0.5, 8.0, 20.0)
    scan = {(r["variant"], r["k1"], r["b"], r["k3"]): r["map"] for r in tuning.bm25_large_grid(w.index, w.topics, w.qrels, k1s, bs, k3s, k=100).collect()}
    assert len(scan) == 3 * 27
    for k1, b, k3 in ((0.3, 0.0, 0.5), (1.2, 0.75, 8.0), (2.0, 1.0, 20.0), (0.3, 1.0, 8.0)):
        run = lexical.bm25(w.index, w.topics, 100, lexical.BM25Params(k1, b, k3))
        for r in ev.evaluate(run, w.qrels, ["map"], keys=("variant",)).collect():
            assert abs(scan[(r["variant"], k1, b, k3)] - r["value"]) < 1e-9
    ranks = {(r["variant"], r["qid"], r["docno"]): r["rank"] for r in tuning.bm25_grid_ranks(w.index, w.topics, w.qrels, (1.2,), (0.75,), (8.0,)).collect()}
    run = {(r["variant"], r["qid"], r["docno"]): r["rank"] for r in lexical.bm25(w.index, w.topics, None).collect()}
    assert ranks and all(run[k] == n for k, n in ranks.items())
    chunks = tuning.bm25_grid_ranks(w.index, w.topics, w.qrels, (1.2,), (0.75,), (8.0,), max_bytes=80).collect()
    assert {(r["variant"], r["qid"], r["docno"]): r["rank"] for r in chunks} == ranks  # queries in many chunks


def test_hits_that_cross_batches_are_added_up():
    import pyarrow as pa

    cols = {"_q": [1, 1, 1, 2, 2], "docno": [5, 5, 6, 5, 5], "tf": [1, 2, 1, 3, 1], "dl": [4, 4, 9, 4, 4], "df": [2.0, 1.0, 2.0, 1.0, 2.0], "n_docs": [10.0] * 5, "avgdl": [5.0] * 5, "qtf": [1, 2, 1, 1, 1]}
    t = pa.table(cols)
    whole = list(tuning._score_vectors(t.to_batches(), (1.2,), (0.5,), (8.0,)))  # noqa: SLF001
    parts = list(tuning._score_vectors(t.to_batches(max_chunksize=1), (1.2,), (0.5,), (8.0,)))  # noqa: SLF001
    flat = lambda x: [(int(a), int(b), round(float(c[0]), 12)) for q, d, v in x for a, b, c in zip(q, d, v)]
    assert flat(whole) == flat(parts) and [x[:2] for x in flat(parts)] == [(1, 5), (1, 6), (2, 5)]


def test_known_keys_count_zero(spark):
    run = spark.createDataFrame([("a", 1, 1, 1)], "method string, qid long, docno long, rank long")
    rel = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "qid long, docno long, rel long")
    known = spark.createDataFrame([("a",), ("b",)], "method string")
    got = {r["method"]: r["value"] for r in ev.evaluate(run, rel, ["RR@10"], keys=("method",), known=known).collect()}
    assert got == {"a": 0.5, "b": 0.0}


# ---- analysis per topic, hot keys -----------------------------------------------------------

def test_analysis_per_topic(spark):
    rows = [("t", q, m, "RR@10", v) for q, m, v in ((1, "BM25", 0.5), (1, "X", 1.0), (2, "BM25", 0.25), (2, "X", 0.25))]
    long = spark.createDataFrame(rows, "variant string, qid long, method string, metric string, value double")
    keys = ("variant", "qid")
    pct = {(r["qid"], r["method"]): r["pct"] for r in A.pct_vs_baseline(long, keys=keys).collect()}
    assert pct == {(1, "BM25"): 0.0, (1, "X"): 100.0, (2, "BM25"): 0.0, (2, "X"): 0.0}
    ranks = {(r["qid"], r["method"]): r["rank"] for r in A.rank_methods(long, keys).collect()}
    assert ranks == {(1, "X"): 1.0, (1, "BM25"): 2.0, (2, "BM25"): 1.5, (2, "X"): 1.5}
    norm = {(r["qid"], r["method"]): r["norm_value"] for r in A.minmax_across_methods(long, keys).collect()}
    assert norm == {(1, "BM25"): 0.0, (1, "X"): 1.0, (2, "BM25"): None, (2, "X"): None}
    assert A.improvements(long, keys=keys).columns == ["variant", "qid", "method", "metric", "pct"]


def test_hot_key_join(spark):
    large = spark.range(500).select(F.col("id").alias("docno"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("label"))
    small = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, 99)], "qid long, label long")
    rows = lambda df: sorted((r["qid"], r["docno"]) for r in df.collect())
    assert rows(sizing.join_hot(large, small, "label", "docno")) == rows(sizing.join_hot(large, small, "label", "docno", max_bytes=0)) == rows(large.join(small, "label"))
    sizing.release()


def test_blocks_score_as_the_joins_do(spark, monkeypatch):
    """Blocks of few documents and queries, docnos that repeat or are null, terms without a score: the rows of the hit joins."""
    from rankloom.operators import blocks

    monkeypatch.setattr(blocks, "QUERIES", 3)
    texts = ["a b", "a a c", "b", "c c d", "d e a", "a", "zz", "a b c d e f", "f f f", "b c", "a b"]
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (3, "a c"), (None, "b d"), (None, "e")], "docno long, text string")
    topics = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c c d", "e", "zz f", "none", "", "a b c d e f", "b b b"])], "qid long, query string")
    index = lexical.build_index(docs)
    for k in (1, 3, 100):
        key = lambda df: sorted((r["qid"], str(r["docno"]), r["rank"], round(r["score"], 6)) for r in df.collect())
        assert key(lexical.bm25(index, topics, k, keys=("qid",))) == key(lexical.bm25(index, topics, k, keys=("qid",), max_bytes=0))
    rel = spark.createDataFrame([(0, 10, 1), (1, 3, 1), (6, 7, 2), (6, 0, 1), (7, 9, 1)], "qid long, docno long, rel long")
    grid = [(k1, b, k3) for k1 in (0.3, 1.2) for b in (0.0, 0.75) for k3 in (0.5, 8.0)]
    maps = [{(r["k1"], r["b"], r["k3"]): round(r["map"], 9) for r in df.collect()} for df in (
        tuning.bm25_grid_scan(index, topics, rel, grid, k=5, keys=("qid",)), tuning.bm25_grid_scan(index, topics, rel, grid, k=5, keys=("qid",), max_bytes=0),
        tuning.bm25_large_grid(index, topics, rel, (0.3, 1.2), (0.0, 0.75), (0.5, 8.0), k=5, keys=("qid",)))]
    assert len(maps[0]) == 8 and maps[0] == maps[1] == maps[2]


def test_document_blocks_follow_documents_not_batches(monkeypatch):
    import pyarrow as pa

    from rankloom.operators import blocks

    monkeypatch.setattr(blocks, "DOCS", 2)
    t = pa.table({"docno": pa.array([None, None, "a", "b", "b", "b", "c"]), "_t": pa.array([0, 1, 0, 0, 1, 2, 1], pa.int32()), "tf": [1, 2, 3, 4, 5, 6, 7], "dl": [9] * 7})
    want = [([None, "a"], [0, 0, 1], [1, 2, 3]), (["b", "c"], [0, 0, 0, 1], [4, 5, 6, 7])]
    for size in (1, 2, 3, 7):
        assert [(d.to_pylist(), r.tolist(), tf.tolist()) for d, r, _, tf, _ in blocks.document_blocks(t.to_batches(max_chunksize=size))] == want


def test_no_row_is_made_for_a_hit_of_a_query(spark, w):
    run = lexical.bm25(w.index, w.topics, 20)
    plan = run._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "MapInArrow" in plan and "sum(" not in plan  # no aggregate by (query, document)


def test_field_postings_are_put_together_in_parts_of_a_fixed_size(spark, monkeypatch):
    from rankloom.operators import lexical

    rows = [(f"d{i}", f"red fox {i % 7}", "the fox and the hen " * (1 + i % 3)) for i in range(300)] + [("e", None, ""), ("f", "hen", None)]
    corpus = spark.createDataFrame(rows, "docno string, title string, abstract string")
    weights = {"title": 2.0, "abstract": 1.0}
    n_bytes = sum(len(t or "") + len(a or "") for _, t, a in rows)
    monkeypatch.setattr(lexical, "FIELD_BYTES", n_bytes // 60)
    index = lexical.field_index(corpus, weights)
    want = {}
    for docno, title, abstract in rows:
        words = [(w, 2.0) for w in (title or "").split()] + [(w, 1.0) for w in (abstract or "").split()]
        for w, x in words:
            want[docno, w] = want.get((docno, w), 0.0) + x
    length = {}
    for (docno, _), x in want.items():
        length[docno] = length.get(docno, 0.0) + x
    assert {(r.docno, r.term): (r.tf, r.dl) for r in index.postings.collect()} == {k: (x, length[k[0]]) for k, x in want.items()}
    plan = index.postings._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001 -- the plan's text
    assert "REPARTITION_BY_NUM" in plan and (", 60)" in plan or ", 61)" in plan)
    assert plan.split("Initial Plan")[-1].count("Exchange") == 2  # texts and lengths by docno, no exchange of postings
    assert index.coll_stats.first()["n_docs"] == len(rows)
