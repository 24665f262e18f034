"""Lexical index tables and BM25 retrieval.

The index is built once and searched many times (``Index``):

- ``docs`` (docno, dl, terms), a document's distinct terms with their counts a
  row, and ``repeated``, the docnos of more than one row;
- ``term_stats`` (term, df) and ``coll_stats`` (one row: n_docs, total_len,
  avgdl);
- ``postings`` (docno, term, tf, dl), sorted by term inside every file, so a
  lookup of few terms skips row groups; a frequent term is spread over all
  files and is never one task's work. They are stored when they are first asked
  for.

``build_index`` makes them in one pass in which each document's term
frequencies are counted inside its row; ``store_index`` keeps them as Parquet
in the shared folder. Plan shape of ``bm25`` on an index:

1. the tasks read the documents' rows as they lie and look their terms up among
   the queries' (measured, broadcast), so no posting is joined, exchanged or
   sorted;
2. only the rows of repeated docnos are brought together first; an index that is
   not stored has its postings joined, hash-partitioned and sorted on ``docno``;
3. with the query side broadcast, blocks of documents are scored against blocks
   of queries inside the tasks (``blocks``), which pass on each query's k best
   documents only; no row for a (query, document, term) hit is made. Beyond the
   byte bound, or without a cut, the query side is joined by term and the hits
   are summed by (query, document) (AQE splits frequent terms);
4. top-k per query is ``row_number() <= k``, which Spark plans as a partial
   ``WindowGroupLimit`` before the shuffle on the query key, so a query that
   matches a third of the corpus still ships only k rows per partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens, with_term_counts
from ..plans.sizing import BROADCAST_BYTES, measured
from . import blocks

# BM25 defaults of the surveyed search engine.
K1 = 1.2
B = 0.75
K3 = 8.0
# Digits kept when scores are compared, so that ranking does not depend
# on the order in which partial sums were added.
SCORE_DIGITS = 6


@dataclass(frozen=True)
class BM25Params:
    k1: float = K1
    b: float = B
    k3: float = K3
    idf: str = "rsj"  # or "plus_one"


def doc_terms(prepared: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: ``(docno, dl, terms ARRAY<STRUCT<term, tf>>)``, terms in byte order.

    As ``with_term_counts``, but the tokens of a batch are counted at once.
    """
    term = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = T.StructType([prepared.schema["docno"], T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(term))])

    def count(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, LOOKED_UP):
                b = whole.slice(lo, LOOKED_UP)
                toks = b.column(2)
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
                own = toks.flatten().dictionary_encode()
                order = pc.sort_indices(own.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                key, tf = np.unique(row * max(len(order), 1) + place[own.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                offsets = np.searchsorted(key, np.arange(b.num_rows + 1) * max(len(order), 1)).astype(np.int32)
                words = own.dictionary.take(pa.array(order[key % max(len(order), 1)]))
                terms = pa.StructArray.from_arrays([words, pa.array(tf.astype(np.int64))], names=["term", "tf"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), terms)], names=["docno", "dl", "terms"])

    toks = prepared.select("docno", tokens(text_col).alias("_toks"))
    return toks.select("docno", F.size("_toks").cast("long").alias("dl"), "_toks").mapInArrow(count, schema)


def explode_terms(df: DataFrame, *keep: str, keep_null_term: bool = False) -> DataFrame:
    """One row per ``terms`` entry: ``(*keep, term, tf)``.

    ``inline_outer`` is used on purpose: for the non-outer generator the
    optimizer infers a ``size(terms) > 0`` filter and pushes it below the
    projections, where it would re-evaluate the sort inside every lambda
    call. Empty arrays give one NULL row, removed here.
    """
    out = df.select(*keep, F.inline_outer("terms"))
    if keep_null_term:
        return out
    return out.filter(F.col("term").isNotNull())


def postings(prepared: DataFrame, text_col: str = "text") -> DataFrame:
    """L1: ``(docno, term, tf)``; a map-only job, no shuffle."""
    return explode_terms(doc_terms(prepared, text_col), "docno")


def doc_stats(prepared: DataFrame, text_col: str = "text") -> DataFrame:
    """L1: ``(docno, dl)`` with dl over all tokens."""
    return prepared.select("docno", F.size(tokens(text_col)).cast("long").alias("dl"))


def field_postings(corpus: DataFrame, fields=("title", "abstract"),
                   weights: dict | None = None) -> DataFrame:
    """L2: ``(docno, field, term, tf, weight)`` over several text fields.

    One scan produces all fields (``stack``); ``weighted_tf`` sums
    ``weight * tf`` per ``(docno, term)``.
    """
    weights = weights or {}
    n = len(fields)
    stack_args = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = corpus.select("docno", F.expr(f"stack({n}, {stack_args})").alias("field", "text"))
    w = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(float(weights.get(f, 1.0))))])
    toks = long.select("docno", "field", tokens("text").alias("_toks"))
    return (explode_terms(with_term_counts(toks, "_toks"), "docno", "field")
            .withColumn("weight", F.element_at(w, F.col("field"))))


def weighted_tf(fp: DataFrame) -> DataFrame:
    """L2: ``(docno, term, tf)`` with tf = sum of weight * per-field tf."""
    return fp.groupBy("docno", "term").agg(F.sum(F.col("weight") * F.col("tf")).alias("tf"))


def collection_stats(prepared: DataFrame, text_col: str = "text") -> DataFrame:
    """L3: one row ``(n_docs, total_len, avgdl, n_terms)``.

    ``n_terms`` (distinct terms) needs one aggregation over distinct
    (term) keys; the rest is a single global aggregate.
    """
    dt = doc_terms(prepared, text_col)
    sizes = doc_stats(prepared, text_col).agg(F.count(F.lit(1)).alias("n_docs"),
                                                   F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"),
                                                   F.avg("dl").cast("double").alias("avgdl"))
    nterms = (explode_terms(dt).select("term").distinct()
              .agg(F.count(F.lit(1)).alias("n_terms")))
    return sizes.crossJoin(nterms)  # two single-row tables


def query_terms(topics: DataFrame, keys=("variant", "qid")) -> DataFrame:
    """``(*keys, term, qtf)`` from ``topics(*keys, query)``."""
    keys = [k for k in keys if k in topics.columns]
    return (topics.select(*keys, F.explode_outer(tokens("query")).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("long").alias("qtf")))


def _idf(n: Column, df: Column, kind: str) -> Column:
    ratio = (n - df + F.lit(0.5)) / (df + F.lit(0.5))
    if kind == "rsj":
        return F.log2(ratio)
    if kind == "plus_one":
        return F.log(F.lit(1.0) + ratio)
    raise ValueError(f"unknown idf {kind!r}")


def ranked(df: DataFrame, keys, k: int | None, score: str = "score",
           docno: str = "docno") -> DataFrame:
    """``rank`` = 1.. per ``keys`` by rounded score desc, docno desc.

    With ``k`` given only the first k rows per key are kept; Spark turns
    ``row_number() <= k`` into a partial + final ``WindowGroupLimit``, up to a
    limit of the session (1000). A deeper cut gets its partial top k from
    ``partial_top``.
    """
    if k is not None and k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        df = partial_top(df, keys, k, score, docno)
    w = Window.partitionBy(*keys).orderBy(F.round(score, SCORE_DIGITS).desc(), F.col(docno).desc())
    out = df.withColumn("rank", F.row_number().over(w).cast("long"))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out


#: Rows that a task holds before it lets go of what cannot be among the best.
HELD = 1 << 20


def partial_top(df: DataFrame, keys, k: int, score: str = "score", docno: str = "docno") -> DataFrame:
    """``df`` without rows that k others of their key and partition come before; a map-only step.

    Works on Arrow batches in numpy. A task holds at most about ``HELD`` rows:
    if that many survive, they are passed on and it starts anew, so the result
    may have more than k rows a key and partition, never fewer than it should.
    Ranking rounds scores, so a margin below the k-th score stays as well.
    """
    keys = list(keys)
    names = df.columns
    rows = df.withColumn("_k", F.xxhash64(*keys))

    def best(t: pa.Table) -> pa.Table:
        key, s = t.column("_k").to_numpy(), t.column(score).to_numpy().astype(np.float64)
        place = np.unique(t.column(docno).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        s = np.where(np.isnan(s), -np.inf, s)
        order = np.lexsort((-place, -s, key))
        key, s = key[order], s[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at = np.repeat(start, np.diff(np.append(start, len(key))))
        rank = np.arange(len(key)) - at
        kth = np.where(np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key)))) >= k, s[np.minimum(at + k - 1, len(s) - 1)], -np.inf)
        equal = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (s[1:] != s[:-1])))
        among = np.arange(len(key)) - np.repeat(equal, np.diff(np.append(equal, len(key))))
        return t.take(pa.array(order[(rank < k) | (s >= kth - 2 * 10.0 ** -SCORE_DIGITS) & (among < k)]))

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n > 2 * HELD:
                t = best(pa.concat_tables(held))
                if t.num_rows > HELD:
                    yield from t.drop_columns(["_k"]).to_batches()
                    t = t.slice(0, 0)
                held, n = [t], t.num_rows
        if held:
            yield from best(pa.concat_tables(held)).drop_columns(["_k"]).to_batches()

    return rows.mapInArrow(run, df.select(*names).schema)


def cutoff(run: DataFrame, k: int, keys=("variant", "qid")) -> DataFrame:
    """``% k`` -- keep the top k of every query, ranks recomputed."""
    keys = [c for c in keys if c in run.columns]
    return ranked(run.drop("rank") if "rank" in run.columns else run, keys, k)


@dataclass(frozen=True)
class Index:
    """A searchable index: see the module's description."""

    #: Makes the postings, or reads them where they are stored; called when they are first asked for.
    find_postings: Callable[[], DataFrame]
    term_stats: DataFrame
    coll_stats: DataFrame
    #: A stored index also has its documents' terms, a document a row, and the docnos of more than one row.
    docs: DataFrame | None = None
    repeated: DataFrame | None = None

    @cached_property
    def postings(self) -> DataFrame:
        return self.find_postings()

    @property
    def entries(self) -> DataFrame:
        """The rows of the postings, from the documents' terms where these are stored, so that no postings are made for them."""
        return self.postings if self.docs is None else _postings_of(self.docs, None)

    def entries_of(self, docnos: DataFrame) -> DataFrame:
        """The entries of some documents; the others' terms are not made rows."""
        return self.postings.join(docnos, "docno", "left_semi") if self.docs is None else _postings_of(self.docs.join(docnos, "docno", "left_semi"), None)

    @property
    def docno(self) -> T.StructField:
        return (self.postings if self.docs is None else self.docs).schema["docno"]


def _postings_of(doc_terms_: DataFrame, stop_words: DataFrame | None) -> DataFrame:
    out = explode_terms(doc_terms_, "docno", "dl")
    if stop_words is not None:  # a stated list of words, measured like every broadcast
        words, small = measured(stop_words.select("term").distinct())
        out = out.join(F.broadcast(words) if small else words, "term", "left_anti")
    return out.select("docno", "term", "tf", "dl")


def _term_stats(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))


def _coll_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"),
                     F.avg("dl").cast("double").alias("avgdl"))


def build_index(prepared: DataFrame, text_col: str = "text", stop_words: DataFrame | None = None) -> Index:
    """The index as derived frames, nothing stored (small collections, tests).

    Document lengths count all tokens; ``stop_words`` (term) are left out of
    the postings only.
    """
    dt = doc_terms(prepared, text_col)
    post = _postings_of(dt, stop_words)
    return Index(lambda: post, _term_stats(post), _coll_stats(doc_stats(prepared, text_col).select("dl")))


def store_index(prepared: DataFrame, key_parts, text_col: str = "text", stop_words: DataFrame | None = None) -> Index:
    """The index under the key of its inputs, built where it is missing.

    The texts are tokenised once: a table of each document's term counts is
    stored first, and the postings and statistics are made from it. The postings
    are stored when they are first asked for; a search reads the documents' terms.
    """
    from ..sources.store import materialize

    spark = prepared.sparkSession
    docs = materialize(lambda: doc_terms(prepared, text_col), "doc-terms", key_parts, spark)
    terms = materialize(lambda: _term_stats(_postings_of(docs, stop_words)), "term-stats", key_parts, spark)
    coll = materialize(lambda: _coll_stats(docs.select("dl")), "coll-stats", key_parts, spark)

    def post() -> DataFrame:
        return materialize(lambda: _postings_of(docs, stop_words).sortWithinPartitions("term", "docno"), "postings", key_parts, spark)

    if stop_words is not None:
        return Index(post, terms, coll)
    return Index(post, terms, coll, docs, materialize(lambda: _repeated(docs), "doc-repeats", key_parts, spark))


def _repeated(docs: DataFrame) -> DataFrame:
    """The docnos that more than one row has."""
    return docs.groupBy("docno").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("docno")


def merged(parts: list[Index], key_parts, spark) -> Index:
    """One index from those of separate sets of documents; only the statistics are added up and stored."""
    if len(parts) == 1:
        return parts[0]
    from ..sources.store import materialize

    def union(name: str) -> DataFrame:
        out = getattr(parts[0], name)
        for p in parts[1:]:
            out = out.unionByName(getattr(p, name))
        return out

    terms = materialize(lambda: union("term_stats").groupBy("term").agg(F.sum("df").alias("df")), "term-stats", key_parts, spark)
    sums = union("coll_stats").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    coll = materialize(lambda: sums.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs"))), "coll-stats", key_parts, spark)
    if any(p.docs is None for p in parts):
        return Index(lambda: union("postings"), terms, coll)
    docs = union("docs")
    return Index(lambda: union("postings"), terms, coll, docs, materialize(lambda: _repeated(docs), "doc-repeats", key_parts, spark))


def store_segments(spark, paths, prepare, key_parts, text_col: str = "text") -> Index:
    """The stored index of all files below ``paths``; files added since the last call are indexed on their own.

    ``prepare`` makes prepared texts from a list of files. Changed or removed
    files give a new index of everything.
    """
    from ..sources.store import segments

    found = segments(spark, "index", key_parts, *paths)
    parts = [store_index(prepare(files), (*key_parts, number), text_col) for number, files in found]
    return merged(parts, (*key_parts, *[number for number, _ in found]), spark)


def as_index(source: Index | DataFrame, text_col: str = "text") -> Index:
    """An index as it is; prepared texts as an index that is not stored."""
    return source if isinstance(source, Index) else build_index(source, text_col)


#: Bytes of text whose field postings one task puts together.
FIELD_BYTES = 8 << 20


def _field_parts(corpus: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``(docno, term, tf, dl)`` and ``(docno, dl)`` over several fields.

    The documents are dealt by docno once, in as many parts as their bytes ask
    for, so the sums of a document and its length meet without a shuffle of
    postings, and a task's memory does not grow with the collection.
    """
    fields = list(weights)
    size = sum((F.coalesce(F.octet_length(f).cast("long"), F.lit(0)) for f in fields), F.lit(0).cast("long"))
    total = corpus.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    spark = corpus.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / FIELD_BYTES))
    w = sum((F.lit(float(weights[f])) * F.size(F.coalesce(tokens(f), F.array().cast("array<string>"))) for f in fields), F.lit(0.0))
    sizes = corpus.select("docno", w.alias("dl"))
    post = weighted_tf(field_postings(corpus.select("docno", *fields).repartition(parts, "docno"), fields, weights))
    return post.join(sizes.repartition(parts, "docno").hint("merge"), "docno"), sizes


def field_index(corpus: DataFrame, weights: dict[str, float]) -> Index:
    """L2: an index over several fields; tf and dl are weighted sums over the fields."""
    post, sizes = _field_parts(corpus, weights)
    return Index(lambda: post, _term_stats(post), _coll_stats(sizes))


def store_field_index(corpus, weights: dict[str, float], key_parts, spark) -> Index:
    """The same under the key of its inputs, built where it is missing; ``corpus`` is called only then."""
    from ..sources.store import materialize

    key = (*key_parts, *sorted(weights.items()))
    post = materialize(lambda: _field_parts(corpus(), weights)[0].sortWithinPartitions("term", "docno"), "field-postings", key, spark)
    terms = materialize(lambda: _term_stats(post), "field-term-stats", key, spark)
    coll = materialize(lambda: _coll_stats(_field_parts(corpus(), weights)[1]), "field-coll-stats", key, spark)
    return Index(lambda: post, terms, coll)


def bm25_features(source: Index | DataFrame, topics: DataFrame | None, text_col: str = "text",
                  keys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES,
                  qterms: DataFrame | None = None, within: DataFrame | None = None):
    """Parameter-free BM25 inputs, one row per (query, document, term) hit.

    Returns ``(feats, qkeys, bc)``: ``feats`` is ``(_q, docno, term, tf, dl,
    df, n_docs, avgdl, qtf)``, ``qkeys`` maps ``(*keys) -> _q`` and ``bc``
    is the broadcast hint that the size check allowed. Any BM25 parameter
    setting (or a grid of them, M12) is a projection plus one aggregate
    over these rows. ``qterms`` (keys, term, qtf) may be given directly, e.g.
    an expanded query with fractional weights (D9); ``within`` (keys, docno)
    restricts the hits to those pairs before anything is scored (D10).
    """
    keys = list(keys)
    index = as_index(source, text_col)
    # The query side is measured once; vocabulary, query keys and query
    # weights have at most as many rows as the query terms.
    qt, small = measured(qterms if qterms is not None else query_terms(topics, keys), max_bytes)
    bc = F.broadcast if small else (lambda d: d)
    # The heavy join, aggregate and window hash and compare one long instead
    # of the keys.
    q = F.xxhash64(*keys).alias("_q")
    qkeys = qt.select(*keys, q).distinct()
    vocab = bc(qt.select("term").distinct())
    dfs = index.term_stats.join(vocab, "term", "left_semi")
    qside = bc(qt.select(q, "term", "qtf").join(bc(dfs), "term").crossJoin(F.broadcast(index.coll_stats.select("n_docs", "avgdl"))))  # one row
    if within is not None:
        pairs = within.select(F.xxhash64(*keys).alias("_q"), "docno").distinct()
        docnos, few = measured(pairs.select("docno").distinct(), max_bytes)
        hits = index.entries_of(F.broadcast(docnos) if few else docnos).join(vocab, "term", "left_semi").repartition("docno")
        return hits.join(qside, "term").join(pairs, ["docno", "_q"], "left_semi"), qkeys, bc
    hits = index.entries.join(vocab, "term", "left_semi")
    return hits.repartition("docno").join(qside, "term"), qkeys, bc


def bm25_contribution(p: BM25Params) -> Column:
    """One hit's share of the score, from ``bm25_features`` columns."""
    return bm25_contribution_of(F.lit(float(p.k1)), F.lit(float(p.b)), F.lit(float(p.k3)), p.idf)


def bm25_contribution_of(k1: Column, b: Column, k3: Column, idf: str = "rsj") -> Column:
    """The same with the parameters as columns (a parameter grid, M12)."""
    qweight = _idf(F.col("n_docs"), F.col("df"), idf) * ((k3 + 1) * F.col("qtf") / (k3 + F.col("qtf")))
    kk = k1 * ((F.lit(1.0) - b) + b * F.col("dl") / F.col("avgdl"))
    return qweight * ((k1 + 1) * F.col("tf") / (kk + F.col("tf")))


def bm25_scores(source: Index | DataFrame, topics: DataFrame | None, params: BM25Params | None = None,
                text_col: str = "text", keys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES,
                qterms: DataFrame | None = None, within: DataFrame | None = None):
    """``(_q, docno, score)`` of every match, the ``(*keys, _q)`` table and its broadcast hint."""
    feats, qkeys, bc = bm25_features(source, topics, text_col, keys, max_bytes, qterms, within)
    scores = feats.groupBy("_q", "docno").agg(F.sum(bm25_contribution(params or BM25Params())).alias("score"))
    return scores, qkeys, bc


@dataclass(frozen=True)
class QuerySide:
    """The query side as arrays, a row a (query, term), ordered by query.

    ``queries`` are the ``_q`` of the query numbers ``at``, ``terms`` the words
    of the term numbers ``term``.
    """

    queries: np.ndarray
    terms: pa.Array
    at: np.ndarray
    term: np.ndarray
    df: np.ndarray
    qtf: np.ndarray
    n_docs: float
    avgdl: float

    def only(self, which: np.ndarray) -> QuerySide:
        """The queries that ``which`` marks."""
        rows = which[self.at]
        term, number = np.unique(self.term[rows], return_inverse=True)
        return QuerySide(self.queries[which], self.terms.take(pa.array(term)), (np.cumsum(which) - 1)[self.at[rows]], number.astype(np.int32), self.df[rows], self.qtf[rows],
                         self.n_docs, self.avgdl)

    def idf(self, kind: str) -> np.ndarray:
        ratio = (self.n_docs - self.df + 0.5) / (self.df + 0.5)
        if kind not in ("rsj", "plus_one"):
            raise ValueError(f"unknown idf {kind!r}")
        return np.log2(ratio) if kind == "rsj" else np.log(1.0 + ratio)


def query_side(index: Index, qt: DataFrame, keys) -> tuple[QuerySide, DataFrame]:
    """``qt`` (keys, term, qtf), measured to be small, with its terms' statistics; and ``(*keys, _q)``."""
    spark = qt.sparkSession
    t = qt.select(*keys, F.xxhash64(*keys).alias("_q"), "term", F.col("qtf").cast("double").alias("qtf")).toArrow().sort_by([("_q", "ascending"), ("term", "ascending")])  # at most the measured bytes
    queries, first, at = np.unique(t.column("_q").to_numpy(), return_index=True, return_inverse=True)
    qkeys = spark.createDataFrame(t.select([*keys, "_q"]).take(pa.array(first)), qt.select(*keys, F.lit(0).cast("long").alias("_q")).schema)
    words = t.column("term").combine_chunks().dictionary_encode()
    vocab = spark.createDataFrame(pa.table({"term": words.dictionary}), "term string")
    stats = index.term_stats.join(F.broadcast(vocab), "term", "left_semi").toArrow()  # at most a row a query term
    where = pc.index_in(words.dictionary, stats.column("term").combine_chunks())
    there = where.is_valid().to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, bool)
    where = where.fill_null(0).to_numpy(zero_copy_only=False)
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)[there]
    df = stats.column("df").to_numpy()[where[term]] if len(term) else np.zeros(0)
    coll = index.coll_stats.first()
    return QuerySide(queries, words.dictionary, at[there], term, df, t.column("qtf").to_numpy()[there], coll["n_docs"], coll["avgdl"]), qkeys


def numbered_hits(index: Index, side: QuerySide, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, Callable]:
    """The query side's terms in the documents, and the function that makes ``(docno, _t, tf, dl)`` batches of a task's rows.

    Terms are numbered as in ``side``, and the rows of a docno lie together. A
    stored index is read a document a row as it lies, without a join, an exchange
    or a sort; only the rows of repeated docnos are brought together. Else the
    postings are joined, exchanged and sorted by docno.
    """
    if index.docs is not None:
        return _together(index, max_bytes), document_hits
    names = pa.table({"term": side.terms, "_t": pa.array(np.arange(len(side.terms), dtype=np.int32))})
    vocab = index.postings.sparkSession.createDataFrame(names, "term string, _t int")
    hits = index.postings.join(F.broadcast(vocab), "term").select("docno", "_t", "tf", "dl")  # the measured vocabulary
    return hits.repartition("docno").sortWithinPartitions("docno"), lambda batches, terms: batches


def _together(index: Index, max_bytes: int) -> DataFrame:
    """The documents' rows, those of one docno one after the other in one partition."""
    docs = index.docs.select("docno", "dl", "terms")
    if index.repeated.isEmpty():
        return docs
    twice, small = measured(index.repeated.select(F.col("docno").alias("_twice")), max_bytes)
    twice, same = F.broadcast(twice) if small else twice, F.col("docno").eqNullSafe(F.col("_twice"))
    again = docs.join(twice, same, "left_semi").repartition("docno").sortWithinPartitions("docno")
    return docs.join(twice, same, "left_anti").unionByName(again)


#: Documents whose terms a task looks up at a time.
LOOKED_UP = 1024


def document_hits(batches, terms: pa.Array):
    """``(docno, _t, tf, dl)`` of batches ``(docno, dl, terms)``: the documents' terms among ``terms``, by their numbers."""
    known = terms.cast(pa.string())
    for whole in batches:
        for lo in range(0, whole.num_rows, LOOKED_UP):
            b = whole.slice(lo, LOOKED_UP)
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            term, tf = lists.flatten().flatten()
            number = pc.index_in(term.cast(pa.string()), known)
            there = number.is_valid()
            at = pa.array(row).filter(there)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), number.filter(there), tf.filter(there), b.column(1).take(at)], names=["docno", "_t", "tf", "dl"])


def top_scores(index: Index, qt: DataFrame, settings, k: int, keys, idf: str = "rsj") -> tuple[DataFrame, DataFrame]:
    """``(_s, _q, docno, score)``: every setting's and query's k best documents of each partition; and ``(*keys, _q)``.

    ``settings`` are (k1, b, k3); ``_s`` is a setting's number.
    """
    side, qkeys = query_side(index, qt, keys)
    spark = qt.sparkSession
    kind = T.StructField("docno", index.docno.dataType)
    schema = T.StructType([T.StructField("_s", T.IntegerType()), T.StructField("_q", T.LongType()), kind, T.StructField("score", T.DoubleType())])
    if not len(side.term):
        return spark.createDataFrame([], schema), qkeys
    # The matrix of a (k1, b) serves all its k3.
    k3s = sorted({k3 for _, _, k3 in settings})
    points = [(k1, b, [k3s.index(x) for x in {c: 0 for a, d, c in settings if (a, d) == (k1, b)}]) for k1, b in {(s[0], s[1]): 0 for s in settings}]
    number = np.array([settings.index((k1, b, k3s[i])) for k1, b, own in points for i in own], np.int32)
    held = spark.sparkContext.broadcast((side, k3s, points, number))

    rows, hits = numbered_hits(index, side)

    def run(batches):
        side, k3s, points, number = held.value
        n = len(side.queries)
        found = blocks.query_blocks(n, side.at, side.term, side.idf(idf), side.qtf, k3s)
        for s, q, score, docno in blocks.top_rows(hits(batches, side.terms), found, points, n, k, side.avgdl, SCORE_DIGITS):
            yield pa.RecordBatch.from_arrays([pa.array(number[s]), pa.array(side.queries[q]), docno.cast(to_arrow_type(kind.dataType)), pa.array(score)], names=schema.names)

    return rows.mapInArrow(run, schema), qkeys


def bm25(source: Index | DataFrame, topics: DataFrame, k: int | None = 1000,
         params: BM25Params | None = None, text_col: str = "text",
         keys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Run ``(*keys, docno, score, rank)``, top ``k`` per query.

    ``source`` is an index, or prepared texts (indexed on the fly). ``k=None``
    returns every matching document (no cutoff). Ranking runs on the surrogate
    query key; the keys are joined back to the (at most k rows per query)
    result.
    """
    keys = [c for c in keys if c in topics.columns]
    return bm25_weighted(source, query_terms(topics, keys), k, params, text_col, keys, max_bytes)


def bm25_weighted(source: Index | DataFrame, qterms: DataFrame, k: int | None = 1000,
                  params: BM25Params | None = None, text_col: str = "text",
                  keys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES,
                  within: DataFrame | None = None) -> DataFrame:
    """BM25 for explicit ``(*keys, term, qtf)`` query terms (qtf may be fractional)."""
    keys = [c for c in keys if c in qterms.columns]
    index, p = as_index(source, text_col), params or BM25Params()
    qt, small = measured(qterms, max_bytes)
    if small and k is not None and within is None:
        scores, qkeys = top_scores(index, qt, [(float(p.k1), float(p.b), float(p.k3))], k, keys, p.idf)
        scores, bc = scores.drop("_s"), F.broadcast
    else:
        scores, qkeys, bc = bm25_scores(index, None, p, text_col, keys, max_bytes, qt, within)
    top = ranked(scores, ["_q"], k)
    return top.join(bc(qkeys), "_q").select(*keys, "docno", "score", "rank")
