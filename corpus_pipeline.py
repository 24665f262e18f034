"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, subword ids.

Each stage works on all rows that its predecessor kept. The first four return
the columns of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, near_dup, pii, subwords, toxicity
from rankloom.llm.common import maybe_broadcast, settle, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from ``labels``.

    Null and empty texts and texts without a word of an example get the share
    of toxic ones among such examples; without labels all rows stay. Rows with
    null or repeated ids and extra columns stay as they are.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Rows with a null doc_id are in no group and stay; a repeated row stays once;
    null and empty texts are like nothing else.
    """
    groups = settle(near_dup.near_duplicates(docs, shingle=5, percent=80).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    gone = groups.filter("not kept").select("doc_id")
    kept = docs.join(maybe_broadcast(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    again = maybe_broadcast(groups.filter("kept and n > 1").select("doc_id"), 16)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("doc_id", "r.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of ten words of a benchmark item go, whatever their id; null and empty texts stay."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text; a null text stays null."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, n_pieces, scores, ids_sha256, round_trip) of every row; null texts have no pieces."""
    return subwords.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("subword_ids", encode_pieces),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
