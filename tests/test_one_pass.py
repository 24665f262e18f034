"""Work on all texts that is done once: term counts, both forward indexes, the look-up of anchors."""

import os

from pyspark.sql import functions as F

from rankloom.functions.text import tokens, with_term_counts
from rankloom.operators import dense, lexical
from rankloom.plans import methods as M
from rankloom.plans import workspace as wsmod
from rankloom.sources import containment, store

TEXTS = ["the Fox and the fox", "", None, "éa ÉA b2 b2 b2", "  one\ttwo\n\nthree ", "İ ΑΣ ß-ß 𝔘x", ".", "z y x z", "the one the two three four five"]


def _docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (3, "b2 again"), (None, "fox")], "docno long, text string")


def test_term_counts_of_batches(spark):
    docs = _docs(spark)
    toks = docs.select("docno", tokens("text").alias("_toks"))
    want = with_term_counts(toks, "_toks").select("docno", F.size("_toks").cast("long").alias("dl"), "terms")
    got = lexical.doc_terms(docs.coalesce(1))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001 -- no lambda a token


def test_vectors_and_words_are_those_of_two_passes(spark):
    docs = _docs(spark).filter("text is not null")
    vec = dense.hashed_vectors(docs, ["docno"])
    words = dense.with_codes(docs.select("docno", F.array_distinct(tokens("text")).alias("words")), "words")
    got = dense.vectors_and_words(docs, ["docno"])
    assert sorted(map(str, got.select("docno", "vec", "norm").collect())) == sorted(map(str, vec.collect()))
    assert sorted(map(str, got.select("docno", "words", "codes").collect())) == sorted(map(str, words.collect()))


def test_the_experiment_reads_the_texts_once_for_both_forward_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"stone {t or ''} fox number {i}\nbody {i} {t or ''}", "en", "s", 10) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "stone  fox number 1"), (2, "the one the two three four five fox")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    w = wsmod.Workspace(spark, str(tmp_path))
    runs = {name: sorted(map(str, run.collect())) for name, run in M.method_runs(w).items()}
    assert store.is_bucketed(spark, "forward-both", w._key("hashed", "codes"), "docno")  # noqa: SLF001
    assert not store.is_bucketed(spark, "forward", w._key("hashed"), "docno") and not store.is_bucketed(spark, "forward-terms", w._key("codes"), "docno")  # noqa: SLF001
    assert w.forward.columns == ["docno", "vec", "norm"] and w.forward_terms.columns == ["docno", "words", "codes"]
    os.makedirs(tmp_path / "again")
    for t in ("documents", "benchmark"):
        os.symlink(tmp_path / f"{t}.parquet", tmp_path / "again" / f"{t}.parquet")
    alone = wsmod.Workspace(spark, str(tmp_path / "again"))
    alone.forward, alone.forward_terms  # noqa: B018 -- each by itself, so they are not made again
    assert {name: sorted(map(str, run.collect())) for name, run in M.method_runs(alone).items()} == runs
    assert not store.is_bucketed(spark, "forward-both", alone._key("hashed", "codes"), "docno")  # noqa: SLF001
    w.release(), alone.release()


def test_anchors_are_looked_up_as_the_join_does(spark):
    texts = ["a b c d e", " a b  c\td ", "x b c d y b c d", "a b", "b c", None, "", "a b c e", "b c d e f", "the fox\nran off"]
    docs = spark.createDataFrame(list(enumerate(texts)), "docno long, text string")
    pats = spark.createDataFrame([(1, "a b c"), (2, "a b c d e"), (3, "x b c d y"), (4, "a b"), (5, "a b c"), (6, "he fox\nran"), (7, None), (8, ""), (None, "b c d e"), (9, "a  b")], "qid long, text string")
    got = sorted(map(tuple, containment.contains_pairs(docs, pats).collect()))
    assert got == sorted(map(tuple, containment.contains_pairs(docs, pats, max_bytes=1).collect()))
    pairs = [(q, d) for q, p in ((r.qid, r.text) for r in pats.collect()) for d, t in enumerate(texts) if q is not None and p and t and p in t]
    assert got == sorted(pairs)
    long = pats.filter("length(text) > 0").withColumn("inner", F.split("text", "[ \t\r\n]+")).withColumn("inner", F.expr("slice(inner, 2, greatest(size(inner) - 2, 0))")).filter("size(inner) > 0")
    plan = containment._by_anchor(docs, long, "docno", "qid", 1 << 20)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "MapInArrow" in plan and "Generate" not in plan  # no row for a shingle
