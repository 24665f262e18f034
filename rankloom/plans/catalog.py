"""Registered queries: one Spark plan and one DuckDB oracle per operator id.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, sql | None)``.
Doubles in every output are rounded to 6 digits on both sides so that the
comparison does not depend on the order of floating-point additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import workspace

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE/FLOAT column (for engine-independent comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def ws(spark, sf_dir):
    return workspace(spark, sf_dir)


# Import the modules that register queries (order = catalogue order).
from . import q_collection  # noqa: E402,F401
from . import q_dense  # noqa: E402,F401
from . import q_tuning  # noqa: E402,F401
from . import q_analysis  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
from . import q_vectors  # noqa: E402,F401
from . import q_feedback  # noqa: E402,F401
from . import q_pages  # noqa: E402,F401
