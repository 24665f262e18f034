"""Evaluation of ranked runs against graded judgments.

Definitions (``rel >= 1`` is relevant, ``R`` = relevant judgments of the
query, ranks start at 1, order = rounded score desc, docno desc):

- RR@k: 1/rank of the first relevant hit with rank <= k, else 0.
- P@k: relevant hits in the top k, over k.
- R@k: relevant hits in the top k, over R.
- AP@k: sum over relevant hits with rank <= k of (relevant so far / rank), over R.
- nDCG@k: sum(rel / log2(rank + 1)) over the top k, over the same sum for
  the judged documents sorted by rel descending.
- The mean is over every query in the judgments: a query without results
  counts 0, a query without judgments is ignored, R = 0 gives 0.

All metrics of all runs (keys such as ``method`` and ``variant``) come out
of one pass over the run: it is joined with the relevant judgments, the hits
are numbered by rank within their query (the running count that AP needs) and
summed by query, and the sums are averaged. Every (run key, judged query) has
a row, also where the run has no judged query at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import BROADCAST_BYTES, measured

# The metric set of the main experiment and its names.
MAIN_METRICS = ("RR@10", "nDCG@10", "AP@100", "R@10", "R@25", "R@50")
TREC_NAMES = {"map": "AP", "recip_rank": "RR", "ndcg": "nDCG"}


@dataclass(frozen=True)
class Measure:
    name: str      # as requested, e.g. "nDCG@10" or "ndcg_cut.10"
    kind: str      # RR | P | R | AP | nDCG
    k: int | None  # None = no cutoff


def parse_measure(name: str) -> Measure:
    """Accept ``RR@10``, ``nDCG@10``, ``AP@100``, ``P@10``, ``R@25``,
    ``map``, ``recip_rank``, ``ndcg``, ``ndcg_cut.10``, ``P.10``,
    ``recall.10``, ``map_cut.100``."""
    m = re.fullmatch(r"(RR|nDCG|AP|P|R)@(\d+)", name)
    if m:
        return Measure(name, m.group(1), int(m.group(2)))
    if name in TREC_NAMES:
        return Measure(name, TREC_NAMES[name], None)
    m = re.fullmatch(r"(ndcg_cut|P|recall|map_cut|recip_rank)[._](\d+)", name)
    if m:
        kind = {"ndcg_cut": "nDCG", "P": "P", "recall": "R", "map_cut": "AP", "recip_rank": "RR"}[m.group(1)]
        return Measure(name, kind, int(m.group(2)))
    raise ValueError(f"unknown measure {name!r}")


def _within(k: int | None) -> Column:
    return F.lit(True) if k is None else F.col("rank") <= k


def per_query(run: DataFrame, qrels: DataFrame, measures=MAIN_METRICS,
              keys=("method", "variant"), max_bytes: int = BROADCAST_BYTES, known: DataFrame | None = None) -> DataFrame:
    """M8: ``(*keys, qid, <one column per measure>)`` for every key of the run
    and every judged query; 0 where the run has nothing for the query.

    ``known`` lists the keys where the caller has them (a grid, the methods);
    else they are found by an aggregate over the run.

    Only relevant hits take part (an inner join with the measured, broadcast
    judgments), so a query that retrieved a third of the corpus brings at most
    R rows to its group. The result has keys x judged queries rows.
    """
    ms = [parse_measure(m) if isinstance(m, str) else m for m in measures]
    keys = [k for k in keys if k in run.columns]
    if "rank" not in run.columns:
        from .lexical import ranked
        run = ranked(run, [*keys, "qid"], None)
    qrels, small = measured(qrels.select("qid", "docno", "rel"), max_bytes)
    rel_q = qrels.filter(F.col("rel") >= 1).withColumn("rel", F.col("rel").cast("double"))
    hits = run.select(*keys, "qid", "docno", "rank").join(F.broadcast(rel_q) if small else rel_q, ["qid", "docno"])
    deepest = None if any(m.k is None for m in ms) else max(m.k for m in ms)
    if deepest is not None:
        hits = hits.filter(F.col("rank") <= deepest)
    w = Window.partitionBy(*keys, "qid").orderBy("rank")
    hits = hits.withColumn("_c", F.row_number().over(w))
    sums = []
    for i, m in enumerate(ms):
        value = {"RR": F.lit(1.0) / F.col("rank"), "P": F.lit(1.0), "R": F.lit(1.0), "AP": F.col("_c") / F.col("rank"),
                 "nDCG": F.col("rel") / F.log2(F.col("rank") + 1)}[m.kind]
        value = F.when(_within(m.k), value).otherwise(F.lit(0.0))
        sums.append((F.max(value) if m.kind == "RR" else F.sum(value)).alias(f"_s{i}"))
    agg = hits.groupBy(*keys, "qid").agg(*sums)
    ideal = _ideal(qrels, ms)
    ideal = F.broadcast(ideal) if small else ideal
    # Every run key meets every judged query: the rows of the result.
    known = known.select(*keys) if known is not None else run.select(*keys).distinct()
    grid = known.crossJoin(ideal) if keys else ideal
    joined = grid.join(agg, [*keys, "qid"], "left")
    if any(m.kind == "P" and m.k is None for m in ms):
        joined = joined.join(run.groupBy(*keys, "qid").agg(F.count(F.lit(1)).alias("_n")), [*keys, "qid"], "left")
    outs = []
    for i, m in enumerate(ms):
        s, r = F.coalesce(F.col(f"_s{i}"), F.lit(0.0)), F.col("_R")
        if m.kind == "RR":
            v = F.when(r > 0, s)
        elif m.kind == "P":
            v = F.when(r > 0, s / F.lit(float(m.k))) if m.k else F.when((r > 0) & (F.col("_n") > 0), s / F.col("_n"))
        elif m.kind in ("R", "AP"):
            v = F.when(r > 0, s / r)
        else:
            v = F.when(F.col(f"_i{i}") > 0, s / F.col(f"_i{i}"))
        outs.append(F.coalesce(v, F.lit(0.0)).cast("double").alias(m.name))
    return joined.select(*keys, "qid", *outs)


def _ideal(qrels: DataFrame, ms) -> DataFrame:
    """Per judged query: ``_R`` and the ideal DCG of each nDCG measure.

    R is a plain aggregate. The ideal DCG ranks a query's judgments by
    grade; with a cutoff only the first k positions are kept, which Spark
    plans as a partial top-k before the shuffle, so a query holding a
    third of all judgments does not sort them in one task.
    """
    r = qrels.groupBy("qid").agg(
        F.sum(F.when(F.col("rel") >= 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("_R"))
    nd = [(i, m) for i, m in enumerate(ms) if m.kind == "nDCG"]
    if not nd:
        return r
    cut = None if any(m.k is None for _, m in nd) else max(m.k for _, m in nd)
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("docno").desc())
    q = qrels.filter(F.col("rel") > 0).withColumn("_pos", F.row_number().over(w))
    if cut is not None:
        q = q.filter(F.col("_pos") <= cut)
    cols = []
    for i, m in nd:
        within = F.lit(True) if m.k is None else F.col("_pos") <= m.k
        cols.append(F.sum(F.when(within, F.col("rel") / F.log2(F.col("_pos") + 1))
                          .otherwise(F.lit(0.0))).alias(f"_i{i}"))
    return r.join(q.groupBy("qid").agg(*cols), "qid", "left").fillna(0.0, [f"_i{i}" for i, _ in nd])


def evaluate(run: DataFrame, qrels: DataFrame, measures=MAIN_METRICS,
             keys=("method", "variant"), known: DataFrame | None = None) -> DataFrame:
    """``(*keys, metric, value)`` -- means over all judged queries."""
    keys = [k for k in keys if k in run.columns]
    names = [m if isinstance(m, str) else m.name for m in measures]
    pq = per_query(run, qrels, measures, keys, known=known)
    n_q = qrels.agg(F.countDistinct("qid").cast("double").alias("_nq"))
    sums = pq.groupBy(*keys).agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names])
    means = sums.crossJoin(F.broadcast(n_q))  # n_q is a single row
    long = means.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"),
                                     (F.col(f"`{n}`") / F.col("_nq")).alias("value")) for n in names]))
        .alias("mv"))
    return long.select(*keys, "mv.metric", "mv.value")
