"""Every stage of the corpus pipeline against what its operator, or brute force, says of its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from rankloom.llm import pii, subwords, toxicity

from .test_pairs import op2_brute, op3_brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet").cache(), []
    for name, stage in P.STAGES:
        got = stage(spark, docs, DIR).cache()
        out.append((name, docs, got))
        docs = got
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_and_columns(kept):
    assert [n for n, _, _ in kept] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "subword_ids"]
    first = kept[0][1]
    assert all(got.columns == first.columns for _, _, got in kept[:-1])


def test_toxicity_stage(spark, kept):
    _, docs, got = kept[0]
    scored = toxicity.classify(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert ids(got) == ids(scored.filter("predicted = 0"))


def test_near_duplicate_stage(kept):
    _, docs, got = kept[1]
    want = op3_brute(sorted((r.doc_id, r.text) for r in docs.collect()), 5, 80)
    assert ids(got) == sorted(d for d, _, _, keep in want if keep)


def test_decontamination_stage(spark, kept):
    _, docs, got = kept[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = op2_brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert ids(got) == sorted(w[0] for w in want if not w[-1])


def test_personal_data_stage(kept):
    _, docs, got = kept[3]
    want = {r.doc_id: pii.redacted(r.text) for r in docs.collect()}
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert got.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert sum("<EMAIL>" in t for t in want.values()) > 0


def test_encoding_stage(kept):
    _, docs, got = kept[4]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    some = rows[:5]
    for r, (paths, _) in zip(some, subwords.encode_texts(subwords.MODEL, [text[r.doc_id] for r in some], 4), strict=True):
        assert r.n_pieces == len(paths[0][1]) and subwords.decode_ids(subwords.MODEL, paths[0][1].tolist()) == text[r.doc_id]


def test_null_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, None, None, None, None), (2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        d = stage(spark, d, DIR)
    assert d.count() == 3
