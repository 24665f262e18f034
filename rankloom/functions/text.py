"""Column expressions for text: tokenising, trimming, term counts.

All of these are built-in Spark expressions, so they run JVM-side and
never move rows through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
# A token is a maximal run of letters and digits; text is lower-cased first.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# The characters stripped from both ends of prepared text.
WHITESPACE = " \t\n\r"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text) -> Column:
    """ARRAY<STRING> of lower-case tokens, empty strings removed."""
    return F.array_remove(F.split(F.lower(_c(text)), TOKEN_SPLIT), "")


def strip_ws(text) -> Column:
    """Trim spaces, tabs, carriage returns and newlines from both ends."""
    return F.trim(_c(text), F.lit(WHITESPACE))


def with_term_counts(df: DataFrame, toks_col: str, out_col: str = "terms") -> DataFrame:
    """Add ``out_col`` = ARRAY<STRUCT<term, tf>>, one entry per distinct token.

    The tokens are sorted inside the row and the runs of equal tokens are
    measured, so a document's term frequencies come out without exploding
    and shuffling every token occurrence. The sorted array and the run
    starts are separate projected columns: referenced from inside a
    lambda, an expression would otherwise be re-evaluated per element.
    """
    s, st = "_tc_sorted", "_tc_starts"
    out = df.withColumn(s, F.sort_array(F.col(toks_col)))
    n = F.size(F.col(s))
    out = out.withColumn(st, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i == 1) | (F.get(F.col(s), i - 1) != F.get(F.col(s), i - 2))))
    runs = F.transform(
        F.col(st),
        lambda p, j: F.struct(
            F.get(F.col(s), p - 1).alias("term"),
            (F.coalesce(F.get(F.col(st), j + 1), n + 1) - p).cast("long").alias("tf")))
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return out.withColumn(out_col, F.when(n > 0, runs).otherwise(empty)).drop(s, st)


def first_tokens(text, n: int) -> Column:
    """The first ``n`` tokens joined by single spaces."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")
