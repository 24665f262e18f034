"""BM25 over the stored documents' terms: the same runs as over joined postings, without an exchange or a table of postings."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import blocks, dense, feedback, lexical, tuning
from rankloom.sources import store

WORDS = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen"]


def collection(spark, key):
    """Documents of a few words, some under one docno, some without a docno or words; and topics."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 9))) for _ in range(120)]
    rows = [(None if i % 40 == 7 else i % 90, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "docno long, text string").repartition(5)
    if key == "once":
        docs = docs.filter("docno >= 30")
    topics = spark.createDataFrame([("a", i, " ".join(rng.choice([*WORDS, "none"], 4))) for i in range(9)], "variant string, qid long, query string")
    return docs, topics


def rows_of(run):
    return sorted((r["variant"], r["qid"], r["rank"], -1 if r["docno"] is None else r["docno"], round(r["score"], 6)) for r in run.collect())


@pytest.mark.parametrize("key", ["once", "repeated"])
def test_a_stored_index_is_searched_a_document_a_row(spark, tmp_path, key):
    docs, topics = collection(spark, key)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    parts = (str(tmp_path), key)
    stored, plain = lexical.store_index(docs, parts), lexical.build_index(docs)
    assert (stored.repeated.count() > 0) == (key == "repeated")
    for k in (3, 50):
        run = lexical.bm25(stored, topics, k)
        assert rows_of(run) == rows_of(lexical.bm25(plain, topics, k))
    plan = run._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001 -- the plan's text
    below = plan.split("MapInArrow")[-1].split("BroadcastExchange")[0]  # the rest is the queries' side
    if key == "once":  # no join, exchange or sort below the scores
        assert "Exchange" not in below and "Sort" not in below and "Join" not in below
    one = feedback.expansion_terms(run, stored).collect()
    assert sorted(map(str, one)) == sorted(map(str, feedback.expansion_terms(run, plain).collect()))
    assert not store.complete(spark, store.store_path(spark, "postings", parts))  # nothing above needs the table
    posts = lambda i: sorted((str(r["docno"]), r["term"], r["tf"], r["dl"]) for r in i.postings.collect())
    assert posts(stored) == posts(plain) and store.complete(spark, store.store_path(spark, "postings", parts))


def test_the_grid_counts_over_documents(spark, tmp_path):
    docs, topics = collection(spark, "repeated")
    docs = docs.filter("docno IS NOT NULL")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    qrels = spark.createDataFrame([(q, d, 1) for q in range(9) for d in (q, q + 30, q + 60)], "qid long, docno long, rel long")
    grid = [(0.9, 1.2), (0.3, 0.75), (2.0, 8.0)]
    ranks = lambda i: sorted(map(str, tuning.bm25_grid_ranks(i, topics, qrels, *grid).collect()))
    assert ranks(lexical.store_index(docs, (str(tmp_path), "grid"))) == ranks(lexical.build_index(docs))


def test_ties_go_to_the_larger_docno_in_any_order():
    best = blocks.Best(1, 2, 6)
    for d in ([5, 9], [None, 7], [1, 8]):
        best.add(np.zeros(2, np.int64), np.array([1.0, 1.0]), pa.array(d, pa.int64()))
        best.cut()
    assert sorted(best.cut()[2].to_pylist()) == [8, 9]


def test_codes_are_those_of_the_native_expression(spark):
    words = [["ant", "bee", "ant"], [], None, ["größe", "日本", "bee"], [f"w{i}" for i in range(400)]]
    df = spark.createDataFrame(list(enumerate(words)), "docno int, words array<string>")
    want = {r["docno"]: r["codes"] for r in df.withColumn("codes", F.array_distinct(dense.codes_of("words"))).collect()}
    assert {r["docno"]: r["codes"] for r in dense.with_codes(df, "words").collect()} == want
