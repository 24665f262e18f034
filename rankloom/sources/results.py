"""Result sinks and sources (S6-S8, S10, S11; S9 is in ``store``).

All writes go below the shared folder named by ``spark.checkpoint.dir``
(see ``rankloom.session.checkpoint_dir``) unless a path is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .collection import VARIANTS
from .store import file_system, materialize, require  # noqa: F401 -- S9, part of this module's interface

RESULTS_SCHEMA = "map<string, map<string, double>>"


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/rankloom-{kind}/{uuid.uuid4().hex}"


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)`` -- one count aggregate per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_results_json(long: DataFrame, path: str, prefix: str = "results") -> list[str]:
    """One file per wording, ``<path>/<prefix>_<variant>.json``: ``{method: {metric: value}}``.

    A file that is there already is kept as it is. The names of the files
    written are returned. A wording's document has one entry per method and
    metric, so each group is bounded.
    """
    spark = long.sparkSession
    per_method = long.groupBy("variant", "method").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    per_variant = per_method.groupBy("variant").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("method", "m")))).alias("value"))
    side = f"{path}/_{prefix}-{uuid.uuid4().hex}"
    per_variant.select("variant", "value").write.partitionBy("variant").text(side)
    written = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(side).select("path", "variant").collect():  # one row a wording
        name = f"{prefix}_{r['variant']}.json"
        target, fs = file_system(spark, f"{path}/{name}")
        source, _ = file_system(spark, r["path"])
        if not fs.exists(target) and fs.rename(source, target):
            written.append(name)
    rest, fs = file_system(spark, side)
    fs.delete(rest, True)
    return sorted(written)


def read_results_json(spark: SparkSession, path: str, variants=VARIANTS) -> DataFrame:
    """The files of a folder as ``(variant, method, metric, value)``, the wording taken from each file's name.

    Files whose name has no known wording are left out; a file may be laid out
    over many lines. A folder that is partitioned by ``variant`` has the wording
    in its folders' names instead.
    """
    raw = spark.read.text(path, wholetext=True)
    if "variant" in raw.columns:
        named = F.when(F.col("variant").isin(*variants), F.col("variant"))
    else:
        raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        named = F.regexp_extract("_metadata.file_name", f"({'|'.join(variants)})", 1)
    nested = raw.select(named.alias("variant"), F.from_json("value", RESULTS_SCHEMA).alias("r")).filter("variant <> ''")
    per_method = nested.select("variant", F.explode("r").alias("method", "m"))
    return per_method.select("variant", "method", F.explode("m").alias("metric", "value"))


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A delimited text table with a header (TSV by default, CSV with ',')."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)


def trec_run_lines(run: DataFrame, tag: str, digits: int = 6) -> DataFrame:
    """``qid Q0 docno rank score tag``, one line per run row."""
    score = F.format_string(f"%.{digits}f", F.round("score", digits))
    return run.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"),
                                  F.col("docno").cast("string"), F.col("rank").cast("string"),
                                  score, F.lit(tag)).alias("line"))


def write_trec_run(run: DataFrame, path: str, tag: str) -> None:
    trec_run_lines(run, tag).write.mode("overwrite").text(path)
