"""Text preparation and text attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws, tokens
from ..plans.sizing import BROADCAST_BYTES, measured


def _blank_to_null(c):
    return F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c))


def prepare_joined(corpus: DataFrame) -> DataFrame:
    """``(docno, text)``, non-empty title and abstract joined by one space."""
    return corpus.select(
        "docno",
        strip_ws(F.concat_ws(" ", _blank_to_null("title"), _blank_to_null("abstract"))).alias("text"))


def prepare_concat(corpus: DataFrame, sep: str = " ", drop_empty: bool = False,
                   id_col: str = "doc_id") -> DataFrame:
    """P2 (sep ' ', id renamed ``doc_id``), P3 (sep '\\n', empty dropped), P4.

    ``text = trim(title + sep + abstract)``; a missing abstract or title is ''.
    """
    out = corpus.select(
        F.col("docno").alias(id_col),
        strip_ws(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(sep),
                          F.coalesce(F.col("abstract"), F.lit("")))).alias("text"))
    return out.filter(F.col("text") != "") if drop_empty else out


def _lookup(corpus: DataFrame, candidates: DataFrame, cols, order_col: str | None,
            max_bytes: int) -> DataFrame:
    """Corpus rows whose docno is a candidate, one row per docno.

    The candidates' docnos are measured and broadcast into a semi-join,
    so the corpus is filtered during its scan and never shuffled.
    """
    cand, small = measured(candidates.select("docno").distinct(), max_bytes)
    lookup = corpus.filter(F.col("docno").isNotNull())
    if dict(corpus.dtypes).get("docno") == "string":
        lookup = lookup.filter(F.col("docno") != "")
    lookup = lookup.join(F.broadcast(cand) if small else cand, "docno", "left_semi")
    if order_col is not None:
        # A repeated docno keeps its last row in ``order_col`` order.
        lookup = (lookup.groupBy("docno")
                  .agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
                  .select("docno", *[F.col(f"_r.{c}").alias(c) for c in cols]))
    else:
        lookup = lookup.select("docno", *cols)
    return lookup


def candidate_texts(corpus: DataFrame) -> DataFrame:
    """P5 for the whole corpus: ``(docno, text)``, the abstract, else the title, else ''."""
    return corpus.select("docno", F.coalesce(_blank_to_null("abstract"), _blank_to_null("title"), F.lit("")).alias("text"))


def attach_text(candidates: DataFrame, corpus: DataFrame, order_col: str | None = None,
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """P5: ``text`` = abstract, else title, else '' (also for unknown docnos)."""
    lookup = _lookup(corpus, candidates, ["title", "abstract"], order_col, max_bytes)
    lookup = candidate_texts(lookup).withColumnRenamed("text", "_text")
    lookup, small = measured(lookup, max_bytes)
    base = candidates.drop("text") if "text" in candidates.columns else candidates
    return (base.join(F.broadcast(lookup) if small else lookup, "docno", "left")
            .withColumn("text", F.coalesce(F.col("_text"), F.lit(""))).drop("_text"))


def attach_field(candidates: DataFrame, corpus: DataFrame, field: str,
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach one stored field of the corpus (NULL when unknown)."""
    lookup, small = measured(_lookup(corpus, candidates, [field], None, max_bytes), max_bytes)
    base = candidates.drop(field) if field in candidates.columns else candidates
    return base.join(F.broadcast(lookup) if small else lookup, "docno", "left")


def ensure_text(df: DataFrame, text_field: str = "text") -> DataFrame:
    """No text column -> the query is the text; NULL text -> ''."""
    if text_field not in df.columns:
        df = df.withColumn(text_field, F.col("query"))
    return df.withColumn(text_field, F.coalesce(F.col(text_field), F.lit("")))


def truncate_tokens(text_col: str, n: int):
    """P10: the first ``n`` tokens of a text (as an array)."""
    return F.slice(tokens(text_col), 1, n)


def truncate_chars(text_col: str, n: int):
    """P10: the first ``n`` characters of a stored text."""
    return F.substring(F.col(text_col), 1, n)


def score_threshold(run: DataFrame, threshold: float) -> DataFrame:
    """Keep candidates scoring at least ``threshold``."""
    return run.filter(F.col("score") >= F.lit(float(threshold)))
