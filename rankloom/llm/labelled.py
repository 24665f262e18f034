"""A bounded, fixed sample of labelled training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import id_bucket


def training_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y): at most ``most`` documents with a label in the learning rows.

    The rows are those with the smallest hash of their id, so the sample is the
    same on every run. Null labels and null ids are left out; a document whose
    labels disagree is left out; a repeated doc_id gives its smallest text.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    rows = rows.filter(id_bucket(F.col("doc_id"), modulus) != held_out)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    # Of rows with a text; the ids are at most twice the sample, so they can be broadcast.
    ids = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    found = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null")
    found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
