"""Comparison of methods (A1-A14) on the long metrics table.

Input: ``(variant, method, metric, value)`` as written by the experiment
(M9/M10), possibly with ``qid`` or parameter columns; it grows with
methods x parameters x topics, so every step is a DataFrame job. Windows
are partitioned by ``(*keys, metric)``, ``keys`` being the wording unless a
table per topic or parameter needs more; a partition holds one row per
method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels used by the published comparison.
BASELINE = "BM25"
QUALITY_METRICS = ("RR@10", "nDCG@10", "AP@100")
RECALL_METRICS = ("R@10", "R@25", "R@50")
VARIANT_ORDER = ("title", "description", "narrative")
METHOD_RENAMES = {"BM25 >> MINILM % 100": "BM25 >> SBERT % 100"}
METRIC_RENAMES = {"mrt": "mrt (ms)"}
NAME_PREFIX = "BM25 >> "
NAME_SUFFIX = " % 100"


def _rename(col: str, mapping: dict) -> F.Column:
    out = F.col(col)
    for old, new in mapping.items():
        out = F.when(F.col(col) == old, F.lit(new)).otherwise(out)
    return out


def label(long: DataFrame) -> DataFrame:
    """A1: ``query_type`` = capitalised variant; method and metric renames."""
    return (long.withColumn("query_type", F.initcap("variant"))
            .withColumn("method", _rename("method", METHOD_RENAMES))
            .withColumn("metric", _rename("metric", METRIC_RENAMES)))


def variant_order(col: str = "variant") -> F.Column:
    m = F.create_map(*[x for i, v in enumerate(VARIANT_ORDER) for x in (F.lit(v), F.lit(i))])
    return F.element_at(m, F.col(col)).cast("long")


def pivot_metric(long: DataFrame, metric: str, methods) -> DataFrame:
    """A2: one row per variant (with its fixed order), one column per method."""
    methods = sorted(methods)
    return (long.filter(F.col("metric") == metric)
            .groupBy("variant").pivot("method", methods).agg(F.first("value"))
            .withColumn("variant_order", variant_order()))


def keep_variant(long: DataFrame, variant: str = "description") -> DataFrame:
    """A3."""
    return long.filter(F.col("variant") == variant)


def method_metric_table(long: DataFrame, metrics) -> DataFrame:
    """A5: ``(variant, method, <metric columns>)``."""
    return (long.filter(F.col("metric").isin(list(metrics)))
            .groupBy("variant", "method").pivot("metric", list(metrics)).agg(F.first("value")))


def unpivot_metrics(wide: DataFrame, metrics, ids=("variant", "method")) -> DataFrame:
    """Wide metric columns back to ``(ids, metric, value)``."""
    return wide.unpivot(list(ids), [f"`{m}`" for m in metrics], "metric", "value")


def minmax_across_methods(long: DataFrame, keys=("variant",)) -> DataFrame:
    """(v - min) / (max - min) across methods per (*keys, metric); 0/0 is NULL."""
    w = Window.partitionBy(*keys, "metric")
    mn, mx = F.min("value").over(w), F.max("value").over(w)
    return long.withColumn("norm_value", F.try_divide(F.col("value") - mn, mx - mn))


def rank_methods(long: DataFrame, keys=("variant",)) -> DataFrame:
    """1 = best per (*keys, metric); ties share the average of their ranks."""
    w = Window.partitionBy(*keys, "metric").orderBy(F.col("value").desc())
    peers = Window.partitionBy(*keys, "metric", "value")
    return long.withColumn("rank", F.rank().over(w).cast("double")
                           + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0))


def pct_vs_baseline(long: DataFrame, baseline: str = BASELINE, metrics=None, keys=("variant",)) -> DataFrame:
    """Percent change of every method against the baseline row.

    A join of the long table with its own baseline rows on (*keys, metric)
    -- one row per key on the baseline side.
    """
    base = long.filter(F.col("method") == baseline).select(*keys, "metric", F.col("value").alias("base_value"))
    out = long.join(base, [*keys, "metric"])
    if metrics is not None:
        out = out.filter(F.col("metric").isin(list(metrics)))
    return out.withColumn("pct", F.try_divide(F.col("value") - F.col("base_value"),
                                              F.col("base_value")) * F.lit(100.0))


def clean_names(df: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """A10: drop the baseline row; strip the first-stage prefix and cutoff suffix."""
    name = F.replace(F.replace(F.col("method"), F.lit(NAME_PREFIX), F.lit("")), F.lit(NAME_SUFFIX), F.lit(""))
    return df.filter(F.col("method") != baseline).withColumn("method", name)


def improvements(long: DataFrame, metrics=QUALITY_METRICS, baseline: str = BASELINE, keys=("variant",)) -> DataFrame:
    """``(*keys, method, metric, pct)`` for the non-baseline methods."""
    return clean_names(pct_vs_baseline(long, baseline, metrics, keys), baseline).select(*keys, "method", "metric", "pct")


def with_response_time(imp: DataFrame, mrt: DataFrame) -> DataFrame:
    """Attach ``mrt`` (ms per query) by (variant, cleaned method)."""
    m = clean_names(mrt.select("variant", "method", "mrt"))
    return imp.join(m, ["variant", "method"], "left")


def quality_vs_cost(long: DataFrame, mrt: DataFrame, metric: str = "nDCG@10") -> DataFrame:
    """``(variant, method, quality, mrt)`` ordered by quality."""
    q = long.filter(F.col("metric") == metric).select("variant", "method", F.col("value").alias("quality"))
    return q.join(mrt.select("variant", "method", "mrt"), ["variant", "method"], "left") \
        .orderBy("variant", F.col("quality").desc(), "method")


def metric_by_variant(long: DataFrame, metric: str, methods: DataFrame, keys=()) -> DataFrame:
    """``(*keys, method, title, description, narrative)`` for the methods in ``methods``."""
    present = long.join(methods.select("method").distinct(), "method", "left_semi")
    return (present.filter(F.col("metric") == metric)
            .groupBy(*keys, "method").pivot("variant", list(VARIANT_ORDER)).agg(F.first("value")))
