"""Token-vector search: stored multi-vector index, feedback on embeddings.

The index holds a document a row, ``(docno, tokens ARRAY<STRUCT<pos, term,
vec>>)``, written once and bucketed by docno; searching, feedback and reranking
read it, and nothing encodes a text again.

Feedback takes the token vectors of a query's ``fb_docs`` best documents,
clusters them (k-means from fixed, evenly spaced starts and with a fixed number
of rounds, so every run gives the same centroids), names each centroid by the
token of its nearest vector, and adds the ``fb_embs`` centroids of the highest
IDF to the query, each with the weight ``beta * idf``. The expanded query is
scored by weighted MaxSim: against all documents (the ranker) or on the
candidates alone (the reranker). A group holds at most ``fb_docs`` documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import weighted_maxsim
from ..plans.sizing import BROADCAST_BYTES, measured
from .dense import exact_search, stored_rows
from .lexical import ranked

# Feedback defaults (documents, clusters, added vectors, weight), k-means rounds.
FB_DOCS = 3
FB_CLUSTERS = 24
FB_EMBS = 10
BETA = 1.0
ROUNDS = 5
# Digits kept when distances are compared, so that ties do not depend on the order of additions.
DISTANCE_DIGITS = 9


def token_name(vec):
    """A vector's token: its largest component, by size, with its sign (``17+``); the first of equal ones."""
    size = F.transform(vec, F.abs)
    at = F.array_position(size, F.array_max(size))
    return F.concat((at - 1).cast("string"), F.when(F.element_at(vec, at.cast("int")) < 0, "-").otherwise("+"))


def token_rows(embeddings: DataFrame, per_doc: int = 4) -> DataFrame:
    """D7 from a table ``(vec_id, embedding)``: each ``per_doc`` vectors in a row are one document's tokens."""
    vec = F.col("embedding").cast("array<double>")
    rows = embeddings.filter("vec_id is not null and embedding is not null").select(
        F.floor(F.col("vec_id") / per_doc).cast("long").alias("docno"), F.pmod("vec_id", F.lit(per_doc)).cast("long").alias("pos"), vec.alias("vec"))
    return tokens_of(rows.select("docno", "pos", token_name(F.col("vec")).alias("term"), "vec"))


def tokens_of(rows: DataFrame) -> DataFrame:
    """D7 from ``(docno, pos, term, vec)``: one row per document, tokens by position."""
    return rows.groupBy("docno").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "vec"))).alias("tokens"))


def token_stats(index: DataFrame) -> DataFrame:
    """``(term, idf)``: ln((N + 1) / (df + 1)) over the documents of the index."""
    n = index.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    df = index.select(F.explode(F.array_distinct(F.transform("tokens", lambda t: t["term"]))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)).alias("idf"))  # one row


def query_vectors(index: DataFrame, key: str = "qid") -> DataFrame:
    """Documents as queries: ``(key, vecs, weights)``, every token vector with the weight 1."""
    return index.select(F.col("docno").alias(key), F.transform("tokens", lambda t: t["vec"]).alias("vecs"),
                        F.transform("tokens", lambda t: F.lit(1.0)).alias("weights"))


def search(queries: DataFrame, index: DataFrame, k: int, qkeys=("qid",), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D6/D8 exact: weighted MaxSim of every query against every document, top k."""
    docs = index.select("docno", F.transform("tokens", lambda t: t["vec"]).alias("vecs"))
    return exact_search(queries, docs, k, qkeys, max_bytes=max_bytes)


def rerank(cands: DataFrame, queries: DataFrame, index: DataFrame, qkeys=("qid",), k: int | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Weighted MaxSim of candidates, looked up by docno; one without vectors scores 0."""
    qkeys = [c for c in qkeys if c in cands.columns]
    q, small = measured(queries.select(*qkeys, F.col("vecs").alias("_qv"), F.col("weights").alias("_qw")), max_bytes)
    docs = stored_rows(index.select("docno", F.transform("tokens", lambda t: t["vec"]).alias("_dv")), cands, _row_bytes(index), max_bytes)
    j = cands.select(*qkeys, "docno").join(docs, "docno", "left").join(F.broadcast(q) if small else q, qkeys, "left")
    out = j.select(*qkeys, "docno", F.coalesce(weighted_maxsim("_qv", "_qw", "_dv"), F.lit(0.0)).alias("score"))
    return ranked(out, qkeys, k)


def token_vectors(index: DataFrame) -> DataFrame:
    """``(docno, vec)``, a row for every token vector, to build cells over."""
    return index.select("docno", F.explode("tokens").alias("t")).select("docno", F.col("t.vec").alias("vec"))


def propose(queries: DataFrame, cells, per_vector: int, probe: int | None = None, qkeys=("qid",)) -> DataFrame:
    """D8 over tokens: ``(*qkeys, docno)``, the documents of the ``per_vector`` most similar tokens of each query vector.

    ``cells`` is built over ``token_vectors``; exact MaxSim (``rerank``) decides.
    """
    from . import cells as C

    each = queries.select(*qkeys, F.posexplode("vecs").alias("pos", "vec"))
    keys = (*qkeys, "pos")
    probe = probe or C.enough(cells, each, per_vector, qkeys=keys)
    return C.search(cells, each, per_vector, probe, qkeys=keys).select(*qkeys, "docno").distinct()


def _row_bytes(index: DataFrame) -> int:
    """The largest row of the index, so that a broadcast is bounded by the number of rows looked up."""
    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + 8 * F.size(t["vec"]) + F.octet_length(t["term"]) + 64)
    return index.agg(F.coalesce(F.max(size), F.lit(1)).alias("b")).first()["b"]


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows of ``x``: starts at rows ``i * n // k``, ties to the first, an empty cluster keeps its centroid."""
    k = min(k, len(x))
    c = x[np.arange(k) * len(x) // k].copy() if k else x[:0]
    for _ in range(rounds if k else 0):
        own = np.round(((x[:, None, :] - c[None]) ** 2).sum(axis=2), DISTANCE_DIGITS).argmin(axis=1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def centroids(run: DataFrame, index: DataFrame, fb_docs: int = FB_DOCS, clusters: int = FB_CLUSTERS, rounds: int = ROUNDS,
              qkeys=("qid",), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(*qkeys, cluster, term, vec)``: the centroids of each query's feedback documents and their nearest tokens."""
    qkeys = [c for c in qkeys if c in run.columns]
    fb = run.filter(F.col("rank") <= fb_docs).select(*qkeys, "docno")
    docs = stored_rows(index.select("docno", "tokens"), fb, _row_bytes(index), max_bytes)
    rows = fb.join(docs, "docno").select(*qkeys, "docno", F.explode("tokens").alias("t")).select(*qkeys, "docno", "t.pos", "t.term", "t.vec")
    schema = T.StructType([run.schema[c] for c in qkeys] + [T.StructField("cluster", T.LongType()), T.StructField("term", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def one(g):
        import pandas as pd

        g = g.sort_values(["docno", "pos"])
        x = np.stack(g["vec"].to_list()).astype(np.float64)
        c = kmeans(x, clusters, rounds)
        near = np.round(((c[:, None, :] - x[None]) ** 2).sum(axis=2), DISTANCE_DIGITS).argmin(axis=1)
        out = pd.DataFrame({"cluster": np.arange(len(c)), "term": g["term"].to_numpy()[near], "vec": list(c)})
        for i, name in enumerate(qkeys):
            out.insert(i, name, [g[name].iloc[0]] * len(c))
        return out

    return rows.groupBy(*qkeys).applyInPandas(one, schema)  # fb_docs documents a group


def expand(queries: DataFrame, run: DataFrame, index: DataFrame, fb_docs: int = FB_DOCS, clusters: int = FB_CLUSTERS, fb_embs: int = FB_EMBS,
           beta: float = BETA, rounds: int = ROUNDS, qkeys=("qid",), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The queries with at most ``fb_embs`` centroids more: ``(*qkeys, vecs, weights)``."""
    qkeys = [c for c in qkeys if c in queries.columns]
    stats, small = measured(token_stats(index), max_bytes)
    c = centroids(run, index, fb_docs, clusters, rounds, qkeys, max_bytes).join(F.broadcast(stats) if small else stats, "term")
    # At most `clusters` rows a query: the heaviest, ties to the first cluster.
    order = F.array_sort(F.collect_list(F.struct((-F.round("idf", DISTANCE_DIGITS)).alias("o"), "cluster", "idf", "vec")))
    best = c.groupBy(*qkeys).agg(F.slice(order, 1, fb_embs).alias("_b"))
    out = queries.join(best, qkeys, "left")
    more = F.coalesce(F.col("_b"), F.slice(F.col("_b"), 1, 0))
    vecs = F.when(F.col("_b").isNull(), F.col("vecs")).otherwise(F.concat("vecs", F.transform(more, lambda b: b["vec"])))
    weights = F.when(F.col("_b").isNull(), F.col("weights")).otherwise(F.concat("weights", F.transform(more, lambda b: F.lit(float(beta)) * b["idf"])))
    return out.select(*qkeys, vecs.alias("vecs"), weights.alias("weights"))


def feedback_ranker(queries: DataFrame, run: DataFrame, index: DataFrame, k: int, **how) -> DataFrame:
    """The expanded queries against all documents."""
    return search(expand(queries, run, index, **how), index, k, how.get("qkeys", ("qid",)))


def feedback_reranker(queries: DataFrame, run: DataFrame, index: DataFrame, **how) -> DataFrame:
    """The expanded queries on the run's own documents."""
    return rerank(run, expand(queries, run, index, **how), index, how.get("qkeys", ("qid",)))
