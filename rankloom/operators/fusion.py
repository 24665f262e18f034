"""Score fusion and composition.

Every per-query computation is a window partitioned by the query key
(``variant``, ``qid``), never a loop over queries. Note the two meanings
of alpha: F2 weights the dense side, F3 weights the lexical side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import ranked

QKEYS = ("variant", "qid")


def _keys(df: DataFrame, keys) -> list[str]:
    return [k for k in keys if k in df.columns]


def minmax_norm(df: DataFrame, col: str = "score", out_col: str = "bm25_norm",
                keys=QKEYS) -> DataFrame:
    """F1: (s - min) / (max - min) within a query; 1.0 when max = min."""
    w = Window.partitionBy(*_keys(df, keys))
    mn, mx = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out_col, F.when(mx > mn, (F.col(col) - mn) / (mx - mn)).otherwise(F.lit(1.0)))


def convex_fusion(df: DataFrame, dense_col: str, alpha: float = 0.2, lexical_col: str = "score",
                  keys=QKEYS, k: int | None = None) -> DataFrame:
    """F1+F2+F4+F6: ``score = (1 - alpha) * bm25_norm + alpha * dense``.

    Keeps ``bm25_score``, ``bm25_norm`` and the dense score beside the new
    score, and recomputes ``rank``.
    """
    out = minmax_norm(df.withColumn("bm25_score", F.col(lexical_col)), "bm25_score", "bm25_norm", keys)
    a = F.lit(float(alpha))
    out = out.withColumn("score", (F.lit(1.0) - a) * F.col("bm25_norm") + a * F.col(dense_col))
    return ranked(out.drop("rank"), _keys(out, keys), k)


def interpolate(df: DataFrame, dense_col: str, alpha: float = 0.2, lexical_col: str = "score",
                keys=QKEYS, k: int | None = None) -> DataFrame:
    """``score = alpha * lexical + (1 - alpha) * dense`` on raw scores."""
    a = F.lit(float(alpha))
    out = (df.withColumn("bm25_score", F.col(lexical_col))
           .withColumn("score", a * F.col("bm25_score") + (F.lit(1.0) - a) * F.col(dense_col)))
    return ranked(out.drop("rank"), _keys(out, keys), k)


def compose(df: DataFrame, *stages) -> DataFrame:
    """``a >> b >> c`` is ``df.transform(a).transform(b).transform(c)``."""
    return reduce(lambda acc, f: acc.transform(f), stages, df)
