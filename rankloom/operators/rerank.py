"""Pointwise and pairwise rerankers and their cascade.

The defaults need no model weights:

- pointwise (X1): the share of the query's distinct tokens that occur in
  the candidate's text, ``|q & d| / |q|``;
- pairwise (X2): a candidate's new score is the sum over the other
  candidates of the same query of ``sigmoid(s_a - s_b)`` on the pointwise
  scores.

A model-backed scorer plugs in through ``score_pairs_with`` (mapInPandas,
model loaded once per worker, batched calls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..plans.sizing import BROADCAST_BYTES, measured
from .fusion import compose
from .lexical import cutoff, ranked

QKEYS = ("variant", "qid")


def _keys(df: DataFrame, keys) -> list[str]:
    return [k for k in keys if k in df.columns]


def coverage_score(df: DataFrame, text_field: str = "text", out_col: str = "pointwise") -> DataFrame:
    """X1 default: distinct query tokens found in the text / distinct query tokens."""
    q = F.array_distinct(tokens("query"))
    d = F.array_distinct(tokens(text_field))
    nq = F.size(q)
    return df.withColumn(out_col, F.when(nq > 0, F.size(F.array_intersect(q, d)) / nq)
                         .otherwise(F.lit(0.0)).cast("double"))


def coverage_of(run: DataFrame, topics: DataFrame, stored: DataFrame, out_col: str = "pointwise", keys=QKEYS,
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """X1 default on stored words ``(docno, words)``: each query and each document is tokenised once.

    Unknown documents score 0.
    """
    ks = _keys(run, keys)
    q, small = measured(topics.select(*ks, F.array_distinct(tokens("query")).alias("_qw")), max_bytes)
    words = stored.select("docno", "words")
    docnos, some = measured(run.select("docno").distinct(), max_bytes)
    if some:
        words = words.join(F.broadcast(docnos), "docno", "left_semi")
    words, light = measured(words, max_bytes) if some else (words, False)
    out = run.join(F.broadcast(words) if light else words, "docno", "left").join(F.broadcast(q) if small else q, ks, "left")
    n = F.size("_qw")
    share = F.when(n > 0, F.size(F.array_intersect("_qw", "words")) / n)
    return out.withColumn(out_col, F.coalesce(F.when(F.col("words").isNotNull(), share), F.lit(0.0)).cast("double")).drop("words", "_qw")


def pointwise(df: DataFrame, text_field: str = "text", keys=QKEYS, k: int | None = None, scorer=None) -> DataFrame:
    """Rescore every candidate independently and re-rank.

    ``scorer(df)`` adds ``pointwise``; the default is the coverage of the
    ``query`` by the candidate's text.
    """
    out = scorer(df) if scorer else coverage_score(df, text_field, "pointwise")
    out = out.withColumn("score", F.col("pointwise"))
    return ranked(out.drop("rank"), _keys(out, keys), k)


def pairwise(df: DataFrame, keys=QKEYS, score_col: str = "score", depth: int = 10, k: int | None = None) -> DataFrame:
    """score_a = sum over b != a of sigmoid(s_a - s_b), per query.

    Only the ``depth`` best of each query take part (the reference uses 10), so
    a query's scores, gathered by a window, are a bounded group and no pair
    rows are made.
    """
    ks = _keys(df, keys)
    df = ranked(df.drop("rank"), ks, depth)
    w = Window.partitionBy(*ks)
    peers = F.collect_list(F.struct(F.col("docno").alias("d"), F.col(score_col).alias("s"))).over(w)
    me_s, me_d = F.col(score_col), F.col("docno")
    pair_sum = F.aggregate(
        F.filter(F.col("_peers"), lambda p: p["d"] != me_d), F.lit(0.0),
        lambda acc, p: acc + F.lit(1.0) / (F.lit(1.0) + F.exp(-(me_s - p["s"]))))
    out = (df.withColumn("_peers", peers)
           .withColumn("pairwise", pair_sum)
           .drop("_peers")
           .withColumn("pointwise_score", F.col(score_col))
           .withColumn("score", F.col("pairwise")))
    return ranked(out.drop("rank"), ks, k)


def pairwise_with(df: DataFrame, scorer, text_field: str = "text", keys=QKEYS, depth: int = 10,
                  k: int | None = None, batch_size: int = 32) -> DataFrame:
    """X2 with a model: ``scorer(queries, texts_a, texts_b) -> scores`` of every ordered pair.

    ``scorer`` is a factory, called once per Python worker process. The
    ``depth`` best of each query meet in an equi-join on the query
    (depth x (depth - 1) rows), and a document's new score is the sum of its
    pair scores.
    """
    ks = _keys(df, keys)
    top = ranked(df.drop("rank"), ks, depth)
    other = top.select(*ks, F.col("docno").alias("_other"), F.col(text_field).alias("_text_b"))
    pairs = top.select(*ks, "docno", "query", F.col(text_field).alias("_text_a")).join(other, ks).filter("docno <> _other")
    schema = T.StructType([pairs.schema[c] for c in (*ks, "docno")] + [T.StructField("_pair", T.DoubleType())])
    name = f"{scorer.__module__}.{scorer.__qualname__}"

    def run(batches):
        import numpy as np

        from rankloom.operators.dense import _model

        fn = _model(name, scorer)
        for pdf in batches:
            cols = [pdf[c].fillna("").tolist() for c in ("query", "_text_a", "_text_b")]
            scores = []
            for i in range(0, len(pdf), batch_size):
                scores.extend(np.asarray(fn(*(c[i:i + batch_size] for c in cols)), dtype=float))
            out = pdf[[*ks, "docno"]].copy()
            out["_pair"] = scores
            yield out

    sums = pairs.mapInPandas(run, schema).groupBy(*ks, "docno").agg(F.sum("_pair").alias("pairwise"))
    out = top.drop("rank").join(sums, [*ks, "docno"], "left")
    return ranked(out.withColumn("score", F.coalesce("pairwise", F.lit(0.0))), ks, k)


def cascade(run: DataFrame, first_k: int = 100, second_k: int = 10, text_field: str = "text",
            keys=QKEYS, scorer=None) -> DataFrame:
    """First stage cut to ``first_k`` -> pointwise -> top ``second_k`` -> pairwise."""
    ks = _keys(run, keys)
    return compose(run, lambda d: cutoff(d, first_k, ks), lambda d: pointwise(d, text_field, ks, second_k, scorer),
                   lambda d: pairwise(d, ks, depth=second_k))


def score_pairs_with(df: DataFrame, scorer, text_field: str = "text", out_col: str = "model_score",
                     batch_size: int = 32) -> DataFrame:
    """X1 with a model: ``scorer(queries, texts) -> scores`` in Arrow batches.

    ``scorer`` is a zero-argument factory returning a callable; it runs
    once per Python worker process.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.DoubleType())])
    name = f"{scorer.__module__}.{scorer.__qualname__}"

    def run(batches):
        import numpy as np

        from rankloom.operators.dense import _model

        fn = _model(name, scorer)
        for pdf in batches:
            qs = pdf["query"].fillna("").tolist()
            ts = pdf[text_field].fillna("").tolist()
            scores = []
            for i in range(0, len(qs), batch_size):
                scores.extend(np.asarray(fn(qs[i:i + batch_size], ts[i:i + batch_size]), dtype=float))
            pdf[out_col] = scores
            yield pdf

    return df.mapInPandas(run, schema)
