"""Pseudo-relevance feedback (D9 ranker, D10 reranker).

For every query the ``fb_docs`` best documents of a first-stage run are
taken as feedback. Their terms are ranked by how often they occur in the
feedback documents times their collection IDF; the ``fb_terms`` heaviest are
added to the query, each with the weight ``beta * idf``.

Document frequencies, N and the feedback documents' terms come from the index,
so nothing is tokenised here. A query's feedback set holds ``fb_docs``
documents and its expansion ``fb_terms`` terms, so every group is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import BROADCAST_BYTES, measured
from .lexical import BM25Params, Index, as_index, bm25_weighted, query_terms, ranked

# Feedback defaults.
FB_DOCS = 3
FB_TERMS = 10
BETA = 1.0


# Digits kept when term weights are compared.
WEIGHT_DIGITS = 9


def expansion_terms(run: DataFrame, source: Index | DataFrame, fb_docs: int = FB_DOCS,
                    fb_terms: int = FB_TERMS, keys=("variant", "qid"),
                    max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(*keys, term, weight, idf)``: the ``fb_terms`` heaviest feedback terms per query."""
    index = as_index(source)
    keys = [k for k in keys if k in run.columns]
    fb, small = measured(run.filter(F.col("rank") <= fb_docs).select(*keys, "docno"), max_bytes)
    terms = index.entries.join(F.broadcast(fb) if small else fb, "docno")
    counts = terms.groupBy(*keys, "term").agg(F.sum("tf").cast("double").alias("cnt"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1))
    weighted = (counts.join(index.term_stats, "term").crossJoin(F.broadcast(index.coll_stats.select("n_docs")))  # one row
                .withColumn("idf", idf).withColumn("weight", F.col("cnt") * F.col("idf")))
    w = Window.partitionBy(*keys).orderBy(F.round("weight", WEIGHT_DIGITS).desc(), F.col("term"))
    return (weighted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= fb_terms)
            .select(*keys, "term", "weight", "idf"))


def expanded_query_terms(topics: DataFrame, exp: DataFrame, beta: float = BETA,
                         keys=("variant", "qid")) -> DataFrame:
    """Original ``qtf`` plus ``beta * idf`` for each expansion term."""
    keys = [k for k in keys if k in topics.columns]
    qt = query_terms(topics, keys).withColumn("qtf", F.col("qtf").cast("double"))
    ex = exp.select(*keys, "term", (F.lit(float(beta)) * F.col("idf")).alias("qtf"))
    return qt.unionByName(ex).groupBy(*keys, "term").agg(F.sum("qtf").alias("qtf"))


def prf_ranker(source: Index | DataFrame, topics: DataFrame, first: DataFrame, k: int = 100,
               fb_docs: int = FB_DOCS, fb_terms: int = FB_TERMS, beta: float = BETA,
               params: BM25Params | None = None) -> DataFrame:
    """Retrieve again with the expanded query."""
    exp = expansion_terms(first, source, fb_docs, fb_terms)
    return bm25_weighted(source, expanded_query_terms(topics, exp, beta), k, params)


def prf_reranker(source: Index | DataFrame, topics: DataFrame, first: DataFrame,
                 fb_docs: int = FB_DOCS, fb_terms: int = FB_TERMS, beta: float = BETA,
                 params: BM25Params | None = None, keys=("variant", "qid")) -> DataFrame:
    """Rescore the same candidates, and only them, with the expanded query.

    Statistics are the collection's; a candidate without any expanded-query
    term scores 0.
    """
    keys = [k for k in keys if k in first.columns]
    exp = expansion_terms(first, source, fb_docs, fb_terms)
    rescored = bm25_weighted(source, expanded_query_terms(topics, exp, beta), None, params, within=first)
    out = (first.drop("score", "rank")
           .join(rescored.select(*keys, "docno", "score"), [*keys, "docno"], "left")
           .withColumn("score", F.coalesce(F.col("score"), F.lit(0.0))))
    return ranked(out, keys, None)
