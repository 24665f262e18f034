"""The test collection: corpus, topics and relevance judgments.

The experiments need a corpus ``(docno, title, abstract)``, topics in
three wordings ``(qid, variant, query)`` and graded judgments
``(qid, docno, rel)``. These are derived here, with Spark, from the
driver's tables: ``documents`` is the corpus, ``benchmark`` the topic
set, and a document is judged relevant to a topic when it contains the
topic's whole text (grade 2, or 1 where ``labels.quality = 0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_tokens, strip_ws
from ..plans.sizing import BROADCAST_BYTES, measured
from .containment import contains_pairs

# The three query wordings and the number of leading
# tokens that make the short ("title") wording.
VARIANTS = ("title", "description", "narrative")
TITLE_TOKENS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table (Parquet, schema from the file footer)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """``(docno, title, abstract, lang, source)``.

    The title is the text before the first newline and the abstract the
    rest; a document without a newline has an empty abstract.
    """
    nl = F.instr("text", "\n")
    return documents.select(
        F.col("doc_id").alias("docno"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(nl > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise(F.lit("")).alias("abstract"),
        "lang",
        "source",
    )


def topics_from_benchmark(benchmark: DataFrame) -> DataFrame:
    """S3: long topics table ``(qid, variant, query)``.

    title = first five tokens, description = text before the first
    full stop (trimmed), narrative = the whole text. All three wordings
    come out of one scan (``stack``), not three.
    """
    wide = benchmark.select(
        F.col("item_id").alias("qid"),
        first_tokens("text", TITLE_TOKENS).alias("title"),
        strip_ws(F.split_part("text", F.lit("."), F.lit(1))).alias("description"),
        F.col("text").alias("narrative"),
    )
    return wide.select(
        "qid",
        F.expr("stack(3, 'title', title, 'description', description, 'narrative', narrative)")
        .alias("variant", "query"),
    )



def repair_query_column(topics: DataFrame, source_column: str = "description") -> DataFrame:
    """A topics frame without ``query`` takes it from a named column."""
    if "query" in topics.columns:
        return topics
    if source_column not in topics.columns:
        raise ValueError(f"topics have neither 'query' nor '{source_column}'")
    return topics.withColumn("query", F.col(source_column))


def qrels_from_containment(documents: DataFrame, benchmark: DataFrame,
                           labels: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(qid, docno, rel)``; rel 2, or 1 where the label's quality is 0."""
    pairs = contains_pairs(documents.select(F.col("doc_id").alias("docno"), "text"),
                           benchmark.select(F.col("item_id").alias("qid"), "text"))
    pairs, small = measured(pairs, max_bytes)
    # Only the labels of matched documents are needed: filter the label
    # scan by the (measured, broadcast) matched docnos before the join.
    matched = pairs.select("docno").distinct()
    lab = (labels.select(F.col("doc_id").alias("docno"), "quality")
           .join(F.broadcast(matched) if small else matched, "docno", "left_semi"))
    return (pairs.join(F.broadcast(lab) if small else lab, "docno", "left")
            .select("qid", "docno",
                    F.when(F.col("quality") == 0, F.lit(1)).otherwise(F.lit(2)).cast("long").alias("rel")))
