"""Corpora from JSON lines and from web pages.

A JSON corpus is read with a stated schema and never inferred. Lines that are
no such document (broken JSON, values of another type, no docno) are kept apart
with their file, so a load can be counted: documents + rejected = lines. The
lines are parsed once; the parsed rows are a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fingerprint, materialize

CORPUS_SCHEMA = "docno string, title string, abstract string"
REJECTED = "_rejected"
# Character references of page titles and texts; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def read_json_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, key: str = "docno") -> tuple[DataFrame, DataFrame]:
    """``(documents, rejected)`` of a JSON lines corpus; ``rejected`` is ``(file, line)``."""
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField(REJECTED, T.StringType())])

    def parse() -> DataFrame:
        raw = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
        parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
        rows = raw.select("file", "value", parsed.alias("r"))
        bad = F.col("r").isNull() | F.col(f"r.{REJECTED}").isNotNull() | F.col(f"r.{key}").isNull()
        return rows.select("file", F.when(bad, F.col("value")).alias(REJECTED), *[F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in fields])

    rows = materialize(parse, "json-corpus", (path, fingerprint(spark, path), schema, key), spark)
    good = rows.filter(F.col(REJECTED).isNull()).select(*fields.names)
    return good, rows.filter(F.col(REJECTED).isNotNull()).select("file", F.col(REJECTED).alias("line"))


def load_counts(good: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(name, n)``: how many lines became documents and how many were rejected."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("documents", good), ("rejected", rejected))]
    return parts[0].unionByName(parts[1])


def _plain(c: Column) -> Column:
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(c, "[ \t\r\n]+", " "))


def corpus_from_pages(pages: DataFrame) -> DataFrame:
    """``(docno, title, abstract)``: a page's ``<title>``, and the text of its body without markup, scripts and styles."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)
    body = F.regexp_replace(html, "(?is)^.*?</head>", "")
    body = F.regexp_replace(body, "(?is)<script[ >].*?</script>|<style[ >].*?</style>|<!--.*?-->", " ")
    return pages.select(F.col("page_id").alias("docno"), _plain(title).alias("title"), _plain(F.regexp_replace(body, "<[^>]*>", " ")).alias("abstract"))
