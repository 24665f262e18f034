"""Stored derived tables (S9): keyed by their inputs, published whole, extended by what was added.

A stored table lies below the shared folder under a key of its name, its
parameters and the fingerprint of its input files (their paths, sizes and
times, which a listing tells without reading them), so changed data is never
answered from an old table. A table is written to a side folder whose name Spark
does not read and renamed when it is complete; a writer that dies leaves no
table, and of two writers one wins.

``bucketed`` keeps a table hashed and sorted by a column, so a join on that
column reads it without an exchange.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A folder inside a stored table that readers of the table pass over: its number of rows.
COUNTS, COUNT = "_rows", "name string, n long"


def files_of(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, length, modified)`` of the data files below ``paths``, from a listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A short name of the present state of the files below ``paths``."""
    h = F.xxhash64("path", "length", "modified")
    r = files_of(spark, *paths).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 -- PySpark has no call for files of a store
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at ``path``: the committer's ``_SUCCESS`` is there."""
    mark, fs = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(mark)


def publish(spark: SparkSession, path: str, write) -> None:
    """``write(folder)`` to a side folder, which becomes ``path`` when it is complete."""
    parent, name = path.rsplit("/", 1)
    side = f"{parent}/_{name}-{uuid.uuid4().hex}"
    write(side)
    target, fs = file_system(spark, path)
    source, _ = file_system(spark, side)
    if not complete(spark, path):
        if fs.exists(target):
            fs.delete(target, True)  # what an earlier version of this store left unfinished
        fs.rename(source, target)
    if not complete(spark, path):
        raise OSError(f"could not publish {path}")
    if fs.exists(source):  # another writer was first
        fs.delete(source, True)


def store_path(spark: SparkSession, name: str, key_parts) -> str:
    key = hashlib.sha1(repr(tuple(key_parts)).encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/rankloom-store/{name}-{key}"


def materialize(df, name: str, key_parts, spark: SparkSession | None = None) -> DataFrame:
    """Compute once -- write ``df`` as Parquet under a key of its inputs
    and parameters, or read it back when that key was already written.

    ``df`` is a frame or a function that makes one (called only if needed).
    """
    spark = spark or df.sparkSession
    path = store_path(spark, name, key_parts)
    if not complete(spark, path):
        def write(side: str) -> None:
            rows, seen = (df() if callable(df) else df), Observation(f"rows-{uuid.uuid4().hex}")
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(side)
            count = spark.createDataFrame([(name, int(seen.get["n"]))], COUNT).coalesce(1)
            count.write.parquet(f"{side}/{COUNTS}")

        publish(spark, path, write)
    return spark.read.parquet(path)


def stored_count(spark: SparkSession, name: str, key_parts) -> DataFrame:
    """``(name, n)`` of a materialized table, as it was observed while the table was written; nothing is scanned."""
    return spark.read.schema(COUNT).parquet(f"{store_path(spark, name, key_parts)}/{COUNTS}")


def require(spark: SparkSession, path: str) -> DataFrame:
    """A build that must already exist is a clear error, not a silent rebuild."""
    if not complete(spark, path):
        raise FileNotFoundError(f"required stored table is missing: {path}")
    return spark.read.parquet(path)


def _bucketed_path(spark: SparkSession, name: str, key_parts, column: str, buckets: int) -> str:
    return store_path(spark, name, (*key_parts, column, buckets))


def is_bucketed(spark: SparkSession, name: str, key_parts, column: str) -> bool:
    """Whether ``bucketed`` would read the table and not make it."""
    return complete(spark, _bucketed_path(spark, name, key_parts, column, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bucketed(make, name: str, key_parts, spark: SparkSession, column: str, buckets: int | None = None) -> DataFrame:
    """As ``materialize``, in ``buckets`` hashed and sorted by ``column`` (the session's shuffle partitions unless given).

    The files are a table of the session's catalog, whose scan has that
    partitioning: a join on ``column`` exchanges the other side only.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _bucketed_path(spark, name, key_parts, column, buckets)
    if not complete(spark, path):
        def write(side: str) -> None:
            own = f"side_{uuid.uuid4().hex}"
            rows = make().repartition(buckets, column)
            rows.write.format("parquet").option("path", side).bucketBy(buckets, column).sortBy(column).saveAsTable(own)
            spark.sql(f"DROP TABLE {own}")  # the files stay

        publish(spark, path, write)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


# ---- growing inputs ---------------------------------------------------------------

MANIFEST = "segment long, path string, length long, modified timestamp"


def segments(spark: SparkSession, name: str, key_parts, *paths: str) -> list[tuple[int, list[str]]]:
    """The files below ``paths`` as numbered segments ``(number, files)``: those of the last call, and one of what was added.

    The list of a call is stored under its state, and the state before it in a
    chain, so a listing with files that an earlier state lacks takes over that
    state's segments. If a known file changed or went, all files are one new
    segment. Only names of files pass through the driver, as in every scan.
    """
    now = {(r["path"], r["length"], r["modified"]) for r in files_of(spark, *paths).collect()}  # one row a file
    root = store_path(spark, f"{name}-manifests", key_parts)
    known = _newest(spark, root)
    old = {(r["path"], r["length"], r["modified"]): r["segment"] for r in known.collect()} if known is not None else {}  # one row a file
    if not old or not set(old) <= now:
        rows = [(_number(now), *f) for f in sorted(now)]
    elif set(old) == now:
        rows = [(n, *f) for f, n in old.items()]
    else:
        rows = [(n, *f) for f, n in old.items()] + [(_number(now - set(old)), *f) for f in sorted(now - set(old))]
    if not old or set(old) != now:
        state = hashlib.sha1(repr(sorted(rows)).encode()).hexdigest()[:16]
        path = f"{root}/{_versions(spark, root) + 1:08d}-{state}"
        publish(spark, path, spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet)
    out: dict[int, list[str]] = {}
    for n, path, _, _ in rows:
        out.setdefault(n, []).append(path)
    return sorted((n, sorted(p)) for n, p in out.items())


def _number(files: set) -> int:
    """A segment's number: a hash of its files, so the same segment is the same table."""
    return int(hashlib.sha1(repr(sorted(files)).encode()).hexdigest()[:15], 16)


def _names(spark: SparkSession, root: str) -> list[str]:
    p, fs = file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith("_")) if fs.exists(p) else []


def _versions(spark: SparkSession, root: str) -> int:
    return max((int(n.split("-")[0]) for n in _names(spark, root)), default=0)


def _newest(spark: SparkSession, root: str) -> DataFrame | None:
    for n in reversed(_names(spark, root)):
        if complete(spark, f"{root}/{n}"):
            return spark.read.schema(MANIFEST).parquet(f"{root}/{n}")
    return None
