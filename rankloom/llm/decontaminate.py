"""Benchmark decontamination by a prefix-filtered set join.

An item window is a run of ``window`` words (a shorter item is one window);
its set elements are the shingles of ``shingle`` words inside it. Containment
of a window needs all its shingles, so the necessary prefix is one shingle:
the rarest by corpus count. Only that shingle is joined to the documents'
shingles. A match at document position p for a shingle at window offset o puts
the window at p - o; a start before the text or an end behind it is dropped
(positional and length bounds), and what is left is compared word by word.

Everything is DataFrame expressions; no Python code runs on executors.

Defined cases: null and empty texts have no words and give zero counts; an
item without words has no window; equal windows of several items, repeated
items and repeated document rows each give their own result; a row with a null
doc_id is checked like any other; an item with a null item_id hits words but is
not counted or listed; further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import ascii_lower, maybe_broadcast, settle, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle_hashes(tokens: str, k: int) -> Column:
    """64-bit hashes of the k-word shingles in order; empty if too few words."""
    toks = F.col(tokens)
    last = F.size(toks) - F.lit(k)
    at = lambda i: F.xxhash64(*[toks[i + F.lit(j)] for j in range(k)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(w, len, item_ids): distinct windows with the items that have them."""
    toks = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("toks")).filter(F.size("toks") > 0)
    n = F.size("toks")
    starts = toks.select("item_id", "toks", F.explode(F.sequence(F.lit(0), F.greatest(n - F.lit(window), F.lit(0)))).alias("s"))
    ws = starts.select("item_id", F.slice("toks", F.col("s") + 1, window).alias("w"))
    return ws.groupBy("w").agg(F.collect_set("item_id").alias("item_ids")).withColumn("len", F.size("w"))


def clean_rows(documents: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no window of an item."""
    found = decontaminate(documents, items, window, shingle, F.struct(*[F.col(f"`{c}`") for c in documents.columns]))
    return found.filter("not contaminated").select("carried.*")


def decontaminate(documents: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, carry: Column | None = None) -> DataFrame:
    """One row per document row: (doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, item_ids, hit_spans); ``hit_spans`` are the (start, len) of the
    occurrences. ``carry``, a column of ``documents``, comes along as ``carried``."""
    docs = documents.select("doc_id", "text")
    wins = settle(item_windows(items, window))
    # Shingles of a window shorter than `shingle` words are the window itself.
    ks = sorted(r[0] for r in wins.select(F.least("len", F.lit(shingle))).distinct().collect())  # at most `shingle` values
    grams = None
    for k in ks:
        part = wins.filter(F.least("len", F.lit(shingle)) == k).select("w", "len", "item_ids", F.posexplode(_shingle_hashes("w", k)).alias("off", "h"))
        grams = part if grams is None else grams.unionByName(part)
    tokens = docs.select("doc_id", words(F.col("text")).alias("toks"))
    if grams is None:
        cands = docs.select("doc_id").limit(0).withColumn("cands", F.array().cast("array<struct<start:int,w:array<string>,item_ids:array<string>>>"))
    else:
        hashes = F.concat(*[_shingle_hashes("toks", k) for k in ks]) if len(ks) > 1 else _shingle_hashes("toks", ks[0])
        # Rarity: corpus counts of the items' shingles, combined before the shuffle.
        wanted = maybe_broadcast(grams.select("h").distinct(), 16)
        counts = tokens.select(F.explode(hashes).alias("h")).join(wanted, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
        rarest = F.min_by(F.struct("h", "off"), F.struct("freq", "h", "off")).alias("p")
        complete = (F.count("freq") == F.count(F.lit(1))).alias("complete")  # a shingle that the corpus lacks rules the window out
        prefix = grams.join(counts, "h", "left").groupBy("w", "len", "item_ids").agg(rarest, complete).filter("complete")
        prefix = settle(prefix.select("w", "len", "item_ids", "p.h", "p.off"))
        hits = None
        for k in ks:
            own = maybe_broadcast(prefix.filter(F.least("len", F.lit(shingle)) == k), 400)
            part = tokens.select("doc_id", F.size("toks").alias("n"), F.posexplode(_shingle_hashes("toks", k)).alias("pos", "h")).join(own, "h")
            hits = part if hits is None else hits.unionByName(part)
        start = F.col("pos") - F.col("off")
        hits = hits.filter((start >= 0) & (start + F.col("len") <= F.col("n")))
        cands = hits.groupBy("doc_id").agg(F.collect_set(F.struct(start.alias("start"), "w", "item_ids")).alias("cands"))
        cands = settle(cands)
    cands = maybe_broadcast(cands.withColumnRenamed("doc_id", "id"), 4096)
    carried = [] if carry is None else ["carried"]
    rows = tokens if carry is None else documents.select("doc_id", words(F.col("text")).alias("toks"), carry.alias("carried"))
    found = rows.join(cands, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    toks = F.col("toks")
    same = lambda c: F.slice(toks, c["start"] + 1, F.size(c["w"])) == c["w"]
    found = found.select("doc_id", F.size("toks").cast("long").alias("n_words"), F.filter("cands", same).alias("hits"), *carried)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda c: F.struct(c["start"].alias("start"), F.size(c["w"]).alias("len")))))
    found = found.select("doc_id", "n_words", spans.alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["item_ids"])))).alias("item_ids"), *carried)
    union = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(s["start"] + s["len"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    n_hit = F.coalesce(union, F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        ids.alias("item_ids"), F.coalesce("hit_spans", F.array().cast("array<struct<start:int,len:int>>")).alias("hit_spans"), *carried,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + 9], ' ') AS win
             FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
     ls AS (SELECT DISTINCT l FROM win),
     g AS (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS win
           FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
     h AS (SELECT g.doc_id, g.s, g.l, win.item_id FROM g JOIN win ON g.win = win.win AND g.l = win.l),
     p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
           FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS pos FROM h) GROUP BY doc_id),
     i AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
           FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
