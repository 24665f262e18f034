"""Size checks in front of every broadcast.

A side is broadcast only after its bytes have been measured against a bound.
Beyond the bound the plain DataFrame is returned and Spark plans a shuffle
join (AQE may still convert it at run time from real sizes). A measured side
is cached, since the measurement has already materialised it, and released
with the workspace (``release``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side that is broadcast unless a caller says otherwise.
BROADCAST_BYTES = 128 << 20

_MEASURED: list[DataFrame] = []


def release() -> None:
    """Unpersist the sides that earlier measurements cached."""
    while _MEASURED:
        _MEASURED.pop().unpersist()


def settled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where many stages have been stacked (the union of all methods'
    runs, the metrics table): a checkpointed table is a plain scan for
    the plans that read it, it survives the loss of the executors that
    computed it, and later plans stay shallow, which keeps planning time
    flat. Shallow small frames are only cached.
    """
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)  # read from the session; set only when unset
    return df.checkpoint(eager=True)


def _bytes_of(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(col) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.transform(col, lambda x: _bytes_of(x, kind.elementType)),
                               F.lit(16).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return F.size(col) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_bytes_of(col[f.name], f.dataType), F.lit(8)) for f in kind.fields), F.lit(8))
    return F.lit(8)


def measured(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Cache ``df``, add up its bytes once, and say whether it is within ``max_bytes``."""
    out = df.cache()
    _MEASURED.append(out)
    each = sum((F.coalesce(_bytes_of(F.col(f"`{f.name}`"), f.dataType), F.lit(8)).cast("long")
                for f in df.schema.fields), F.lit(16).cast("long"))
    total = out.agg(F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()["b"]
    return out, total <= max_bytes


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size is within ``max_bytes``, else ``df``."""
    out, small = measured(df, max_bytes)
    return F.broadcast(out) if small else out


SALTS = 32


def join_hot(large: DataFrame, small: DataFrame, key: str, salt_by: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """An inner join on a key of few values: ``small`` is broadcast if it is measured to be small, else both sides are salted.

    A salted key's rows of ``large`` go to ``SALTS`` tasks by ``salt_by``, each of
    which gets that key's rows of ``small``.
    """
    side, fits = measured(small, max_bytes)
    if fits:
        return large.join(F.broadcast(side), key)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def spread_small(df: DataFrame, max_rows: int = 2_000_000, key: str | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """Spread a small input over all cores before per-row heavy work.

    A small table often arrives as one file with one row group, i.e. one
    task. When the (metadata-cheap) row count is at most ``max_rows`` and, if
    that is many, the texts add up to at most ``max_bytes``, the rows are
    hash-partitioned (on ``key`` if given) over the default
    parallelism; the shuffle is small by construction. Larger inputs are
    returned unchanged: their scan is already split across many tasks,
    and shuffling them whole would cost more than it buys.
    """
    n = df.count()
    if n > max_rows:
        return df
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if n > 20_000 and wide:
        each = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in wide), F.lit(0).cast("long"))
        if (df.agg(F.sum(each).alias("b")).first()["b"] or 0) > max_bytes:
            return df
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, key) if key else df.repartition(parts)
