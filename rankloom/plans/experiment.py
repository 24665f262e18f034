"""Running the experiment: metrics table and response times."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from . import methods as M
from .workspace import Workspace

# Published mean response times in ms, by wording and method.
PUBLISHED_MRT = {
    ("title", "BM25"): 21.575595999999955,
    ("title", "BM25 >> TCT-ColBERT % 100"): 131.015286,
    ("title", "BM25 >> MINILM % 100"): 99.55025200000001,
    ("title", "BM25 >> MonoT5 % 100"): 888.6038580000001,
    ("title", "BM25 >> TasB % 100"): 367.6267819999998,
    ("description", "BM25"): 24.533413999999993,
    ("description", "BM25 >> TCT-ColBERT % 100"): 133.21808799999985,
    ("description", "BM25 >> MINILM % 100"): 106.34471199999979,
    ("description", "BM25 >> MonoT5 % 100"): 966.7601299999998,
    ("description", "BM25 >> TasB % 100"): 385.89673599999963,
    ("narrative", "BM25"): 28.097226000000433,
    ("narrative", "BM25 >> TCT-ColBERT % 100"): 137.5471140000002,
    ("narrative", "BM25 >> MINILM % 100"): 112.58874000000048,
    ("narrative", "BM25 >> MonoT5 % 100"): 1043.9730500000003,
    ("narrative", "BM25 >> TasB % 100"): 399.8221840000002,
}

EXP_METRICS = list(ev.MAIN_METRICS)


def metrics_long(ws: Workspace, digits: int = 6) -> DataFrame:
    """``(method, variant, metric, value)``; values rounded so that equal
    metrics compare equal in the analysis steps (ties, 0/0)."""
    def build():
        res = ev.evaluate(M.experiment_run(ws), ws.qrels, EXP_METRICS, keys=("method", "variant"))
        return res.withColumn("value", F.round("value", digits))
    return ws.memo("metrics_long", build, settle=True)


def measure_mrt(ws: Workspace) -> DataFrame:
    """M7: ``(variant, method, mrt)`` -- ms per query of each method, end to end.

    Every method is timed for itself, for one wording, from the stored index:
    retrieval of the candidates and reranking, nothing kept from another
    method. A batch average over the topic set, so it is not comparable with a
    one-query-at-a-time latency.
    """
    def build():
        counts = {r["variant"]: r["n"] for r in
                  ws.topics.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each wording
        rows = []
        for variant, n in sorted(counts.items()):
            for name in M.METHODS:
                own = ws.only(variant, fresh=True)
                t0 = time.perf_counter()
                M.method_run(own, name).write.format("noop").mode("overwrite").save()
                rows.append((variant, name, 1000.0 * (time.perf_counter() - t0) / max(n, 1)))
                own.release()
        return ws.spark.createDataFrame(rows, "variant string, method string, mrt double")
    return ws.memo("mrt", build)


def published_names(long: DataFrame) -> DataFrame:
    """The metrics under the published labels of the methods' places in the experiment."""
    names = F.create_map(*[F.lit(x) for pair in M.PUBLISHED.items() for x in pair])
    return long.withColumn("method", F.coalesce(F.element_at(names, F.col("method")), F.col("method")))


def published_mrt(long: DataFrame) -> DataFrame:
    """``(variant, method, mrt)``: published response times of the methods and wordings in ``long``."""
    spark = long.sparkSession
    times = spark.createDataFrame([(v, m, t) for (v, m), t in PUBLISHED_MRT.items()], "variant string, method string, mrt double")
    return long.select("variant", "method").distinct().join(F.broadcast(times), ["variant", "method"])  # 15 rows


def comparison_long(ws: Workspace) -> DataFrame:
    """The metrics under published labels, with the published ``mrt`` as one more metric."""
    long = published_names(metrics_long(ws)).select("variant", "method", "metric", "value")
    mrt = published_mrt(long).select("variant", "method", F.lit("mrt").alias("metric"), F.col("mrt").alias("value"))
    return long.unionByName(mrt)
