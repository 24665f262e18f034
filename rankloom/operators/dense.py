"""Dense vectors and vector scoring.

The default encoder needs no weights: a text's vector is the signed
feature-hashing of its tokens into ``dim`` buckets. Tokens are cut in the JVM
and folded into vectors in Arrow batches, row by row, so encoding is map-only.

Real models plug in as ``Encoder`` factories run by ``mapInPandas``
(``encode_with``): a model is loaded once per Python worker process and called
on Arrow batches.

Search over all documents (``exact_knn``) scores blocks: the queries are a
stated set, cut into chunks that are broadcast one after the other, and a task
multiplies a batch of documents with a chunk and keeps the k best of each
query. One function serves single vectors, several vectors per document (MAXP)
and token vectors (MaxSim).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws, tokens
from ..functions.vectors import as_lists, dot, maxsim
from ..plans.sizing import BROADCAST_BYTES, measured
from .lexical import SCORE_DIGITS, ranked

# The default encoder's width and hash (first 32 bits of md5).
DIM = 64


def term_hash(term) -> Column:
    """Unsigned 32-bit hash of a term: the first 8 hex digits of its md5."""
    t = F.col(term) if isinstance(term, str) else term
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")


def _bucket(term: str, dim: int, known: dict) -> tuple[int, int]:
    got = known.get(term)
    if got is None:
        h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
        got = known[term] = (h % dim, 1 if h // dim % 2 == 0 else -1)
        if len(known) > 200_000:
            known.clear()
    return got


def hashed_vectors(df: DataFrame, keys, text_col: str = "text", dim: int = DIM) -> DataFrame:
    """``(*keys, vec ARRAY<DOUBLE>, norm DOUBLE)``, raw signed counts.

    bucket = h mod dim; the sign is + when (h div dim) is even. ``vec`` is
    not normalised (its entries are integers); ``norm`` is its L2 norm.
    Rows without tokens get the zero vector. A map-only job: each distinct
    term of a batch is hashed once, all its tokens are counted at once.
    """
    keys = list(keys)

    def fold(batches):
        known: dict = {}
        for b in batches:
            toks = b.column(len(keys))
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
            terms = toks.flatten().dictionary_encode()
            place = np.array([_bucket(t, dim, known) for t in terms.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
            own = place[terms.indices.to_numpy(zero_copy_only=False)]
            mat = np.bincount(row * dim + own[:, 0], weights=own[:, 1], minlength=b.num_rows * dim).reshape(b.num_rows, dim)
            cols = [*(b.column(i) for i in range(len(keys))), as_lists(mat), pa.array(np.sqrt((mat * mat).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "vec", "norm"])

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("norm", T.DoubleType())])
    return df.select(*keys, tokens(text_col).alias("_toks")).mapInArrow(fold, schema)


def normalized(vecs: DataFrame) -> DataFrame:
    """Unit-length ``vec`` (a zero vector stays zero)."""
    return vecs.withColumn(
        "vec", F.when(F.col("norm") > 0, F.transform("vec", lambda x: x / F.col("norm")))
        .otherwise(F.col("vec")))


def vectors_long(vecs: DataFrame, keys) -> DataFrame:
    """``(*keys, dim, value)`` for the non-zero entries of ``vec``."""
    out = vecs.select(*keys, F.posexplode_outer("vec").alias("dim", "value"))
    out = out.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    return out.withColumn("dim", F.col("dim").cast("long"))


class Encoder:
    """Texts -> matrix. Subclasses load a model lazily, once per worker."""

    dim: int = DIM

    def encode(self, texts: list[str]):  # -> numpy array (n, dim)
        raise NotImplementedError


ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, factory: Callable[[], Encoder]) -> None:
    """Make an encoder available by name."""
    ENCODERS[name] = factory


def encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise KeyError(f"no encoder registered as {name!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[name]()


#: Models of this Python worker process, by encoder name or factory.
_LOADED: dict = {}


def _model(key, factory: Callable[[], Encoder]) -> Encoder:
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def encode_with(df: DataFrame, enc: str | Callable[[], Encoder], keys, text_col: str = "text",
                batch_size: int = 32) -> DataFrame:
    """D1/D2 with a model: ``(*keys, vec ARRAY<FLOAT>, norm DOUBLE)`` via mapInPandas.

    ``enc`` is a registered name or a factory; the model is made in the worker
    process, once, and stays for its later tasks. Arrow batches are re-cut into
    ``batch_size`` model calls (X4).
    """
    keys = list(keys)
    factory = ENCODERS[enc] if isinstance(enc, str) else enc
    name = enc if isinstance(enc, str) else f"{enc.__module__}.{enc.__qualname__}"
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("vec", T.ArrayType(T.FloatType())),
                                        T.StructField("norm", T.DoubleType())])

    def run(batches):
        from rankloom.operators.dense import _model as loaded  # the worker's own cache

        model = loaded(name, factory)
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            mats = [np.asarray(model.encode(texts[i:i + batch_size]), dtype=np.float32)
                    for i in range(0, len(texts), batch_size)]
            mat = np.vstack(mats) if mats else np.zeros((0, model.dim), dtype=np.float32)
            out = pdf[keys].copy()
            out["vec"] = list(mat)
            out["norm"] = np.linalg.norm(mat.astype(np.float64), axis=1) if len(mat) else []
            yield out

    return df.select(*keys, text_col).mapInPandas(run, schema)


def _with_query_vectors(cands: DataFrame, qvecs: DataFrame, qkeys, max_bytes: int) -> DataFrame:
    qv, small = measured(qvecs.select(*qkeys, F.col("vec").alias("qvec"), F.col("norm").alias("qnorm")),
                         max_bytes)
    return cands.join(F.broadcast(qv) if small else qv, list(qkeys), "left")


def _with_doc_vectors(cands: DataFrame, dvecs: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    dv, small = measured(dvecs.select("docno", F.col("vec").alias("dvec"), F.col("norm").alias("dnorm")),
                         max_bytes)
    return cands.join(F.broadcast(dv) if small else dv, "docno", "left")


def candidate_vectors(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """Vectors of the distinct candidate documents only.

    ``texts`` is ``(docno, text)`` for the candidates (e.g. from P5); each
    document is encoded once however many queries retrieved it.
    """
    return hashed_vectors(texts.select("docno", "text").dropDuplicates(["docno"]), ["docno"],
                          "text", dim)


def score_vectors(cands: DataFrame, qvecs: DataFrame, dvecs: DataFrame, how: str = "cosine",
                  qkeys=("variant", "qid"), out_col: str = "dense_score",
                  max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``out_col`` = cosine or dot of query and document vectors.

    cosine = dot / (|q| |d|), 0 when either norm is 0 or a vector is missing.
    """
    qkeys = [k for k in qkeys if k in cands.columns]
    return _scored(_with_doc_vectors(_with_query_vectors(cands, qvecs, qkeys, max_bytes), dvecs, max_bytes), how, out_col)


def _scored(j: DataFrame, how: str, out_col: str) -> DataFrame:
    """``out_col`` from the joined vectors and norms, which go."""
    j = j.withColumn("_dot", dot(F.col("qvec"), F.col("dvec")))
    d = F.col("_dot")
    if how == "cosine":
        s = F.when((F.col("qnorm") > 0) & (F.col("dnorm") > 0), d / (F.col("qnorm") * F.col("dnorm")))
    elif how == "dot":
        s = d
    else:
        raise ValueError(how)
    return j.withColumn(out_col, F.coalesce(s, F.lit(0.0))).drop("qvec", "qnorm", "dvec", "dnorm", "_dot")


def stored_rows(stored: DataFrame, cands: DataFrame, row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of a stored forward index that a join of candidates on docno needs.

    Few distinct candidates (counted) are looked up by a broadcast semi-join
    and their rows broadcast; else the index is returned as it is, and its
    buckets meet the exchanged candidates without an exchange of their own.
    """
    docnos = cands.select("docno").distinct()
    docnos, _ = measured(docnos, max_bytes)
    if docnos.count() * row_bytes > max_bytes:
        return stored
    return F.broadcast(stored.join(F.broadcast(docnos), "docno", "left_semi"))


def score_stored(cands: DataFrame, qvecs: DataFrame, stored: DataFrame, how: str = "cosine", qkeys=("variant", "qid"),
                 out_col: str = "dense_score", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D3/D4 on a stored forward index ``(docno, vec, norm)``; nothing is encoded here."""
    rows = stored_rows(stored.select("docno", F.col("vec").alias("dvec"), F.col("norm").alias("dnorm")), cands, DIM * 8 + 32, max_bytes)
    qkeys = [k for k in qkeys if k in cands.columns]
    # The vectors of few queries come last: until then a candidate is a narrow row.
    j = _with_query_vectors(cands.join(rows, "docno", "left"), qvecs, qkeys, max_bytes)
    return _scored(j, how, out_col)


def rerank_by(cands: DataFrame, score_col: str, keys=("variant", "qid"), k: int | None = None) -> DataFrame:
    """the new score becomes ``score``; ranks recomputed per query."""
    keys = [c for c in keys if c in cands.columns]
    out = cands.drop("rank").withColumn("score", F.col(score_col))
    return ranked(out, keys, k)


def passages(corpus_text: DataFrame, text_col: str = "text") -> DataFrame:
    """D5 input: ``(docno, psg, text)``, one row per non-blank line."""
    return (corpus_text.select("docno", F.posexplode_outer(F.split(text_col, "\n")).alias("psg", "text"))
            .filter(F.col("text").isNotNull() & (strip_ws(F.col("text")) != ""))
            .withColumn("psg", F.col("psg").cast("long")))


def maxp_scores(cands: DataFrame, qvecs: DataFrame, psg_vecs: DataFrame, qkeys=("variant", "qid"),
                out_col: str = "dense_score", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Forward-index MAXP -- max over a document's passages of the cosine.

    ``psg_vecs`` is ``(docno, psg, vec, norm)`` for the candidates'
    documents. Candidates x passages is an equi-join on docno; the max is
    one aggregate by (query, docno). A candidate without passages scores 0.
    """
    qkeys = [k for k in qkeys if k in cands.columns]
    # Candidates first meet the passages on docno (a stored index needs no exchange there), then the queries' vectors.
    pairs, small = measured(cands.select(*qkeys, "docno"), max_bytes)
    pv = psg_vecs.select("docno", F.col("vec").alias("pvec"), F.col("norm").alias("pnorm"))
    j = _with_query_vectors(pv.join(F.broadcast(pairs) if small else pairs, "docno"), qvecs, qkeys, max_bytes)
    j = j.withColumn("_dot", dot(F.col("qvec"), F.col("pvec")))
    cos = F.when((F.col("qnorm") > 0) & (F.col("pnorm") > 0),
                 F.col("_dot") / (F.col("qnorm") * F.col("pnorm"))).otherwise(0.0)
    scored = j.groupBy(*qkeys, "docno").agg(F.max(cos).alias(out_col))
    return (cands.join(scored, [*qkeys, "docno"], "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0.0))))


# ---- late interaction (D6, D7) ---------------------------------------------

def codes_of(toks, dim: int = DIM) -> Column:
    """The codes of an array of tokens: twice the hash bucket, and one more for a positive sign."""
    def code(t):
        return (term_hash(t) % dim) * 2 + F.when(F.floor(term_hash(t) / dim) % 2 == 0, 1).otherwise(0)
    return F.transform(F.col(toks) if isinstance(toks, str) else toks, code)


def with_codes(df: DataFrame, words: str, dim: int = DIM) -> DataFrame:
    """``df`` with ``codes``, the distinct codes of its array of words by first place; a map-only job.

    As ``array_distinct(codes_of(words))``, but each distinct word of a batch is hashed once.
    """
    at = df.columns.index(words)

    def code(batches):
        known: dict = {}
        for b in batches:
            lists = b.column(at)
            own = lists.flatten().dictionary_encode()
            place = np.array([_bucket(t, dim, known) for t in own.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            key = row * (2 * dim) + (place[:, 0] * 2 + (place[:, 1] > 0))[own.indices.to_numpy(zero_copy_only=False)]
            key = key[np.sort(np.unique(key, return_index=True)[1])]
            offsets = np.searchsorted(key // (2 * dim), np.arange(b.num_rows + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key % (2 * dim)), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([*b.columns, codes], names=[*b.schema.names, "codes"])

    return df.mapInArrow(code, T.StructType([*df.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))


#: Texts whose words are numbered at a time.
AT_ONCE = 4096


def vectors_and_words(df: DataFrame, keys, text_col: str = "text", dim: int = DIM) -> DataFrame:
    """``(*keys, vec, norm, words, codes)``: as ``hashed_vectors`` and ``with_codes`` of the distinct words, the text cut into tokens once."""
    keys = list(keys)

    def fold(batches):
        known: dict = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(lo, AT_ONCE)
                toks = b.column(len(keys))
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
                terms = toks.flatten().dictionary_encode()
                place = np.array([_bucket(t, dim, known) for t in terms.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
                at = terms.indices.to_numpy(zero_copy_only=False)
                mat = np.bincount(row * dim + place[at, 0], weights=place[at, 1], minlength=b.num_rows * dim).reshape(b.num_rows, dim)

                def firsts(row, value, n, rows=b.num_rows):
                    n = max(n, 1)
                    key = pc.unique(pa.array(row * n + value)).to_numpy()  # by first place, so still by row
                    return pa.array(np.searchsorted(key // n, np.arange(rows + 1)).astype(np.int32)), key // n, key % n

                null = toks.is_null() if toks.null_count else None
                offsets, row, own = firsts(row, at, len(place))
                words = pa.ListArray.from_arrays(offsets, terms.dictionary.take(pa.array(own)), mask=null)
                offsets, _, own = firsts(row, (place[:, 0] * 2 + (place[:, 1] > 0))[own], 2 * dim)
                codes = pa.ListArray.from_arrays(offsets, pa.array(own), mask=null)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), as_lists(mat), pa.array(np.sqrt((mat * mat).sum(axis=1))), words, codes], names=schema.names)

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("norm", T.DoubleType()),
                                                          T.StructField("words", T.ArrayType(T.StringType())), T.StructField("codes", T.ArrayType(T.LongType()))])
    return df.select(*keys, tokens(text_col).alias("_toks")).mapInArrow(fold, schema)


def token_codes(df: DataFrame, keys, text_col: str = "text", dim: int = DIM,
                max_tokens: int | None = None, distinct: bool = False) -> DataFrame:
    """Per row, the token vectors of the default token encoder.

    Each token's vector is the signed one-hot vector of its hash bucket,
    stored compactly as the code ``2 * bucket + (sign > 0)``. ``(*keys,
    codes ARRAY<BIGINT>)``; ``max_tokens`` keeps the first n tokens (P10),
    ``distinct`` keeps each code once (documents: the max over equal
    vectors is the same).
    """
    toks = tokens(text_col)
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    codes = codes_of(toks, dim)
    if distinct:
        codes = F.array_distinct(codes)
    return df.select(*keys, codes.alias("codes"))


def maxsim_codes(cands: DataFrame, qcodes: DataFrame, dcodes: DataFrame, qkeys=("variant", "qid"),
                 out_col: str = "li_score", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """MaxSim = sum over query tokens of the max over document tokens.

    For signed one-hot token vectors the max has a closed form: 1 when the
    document has the same code, else 0 when it has a token in another
    bucket, else -1. So no (query token x document token) pairs are formed;
    each candidate costs |q| membership tests on its document's code set.
    """
    qkeys = [k for k in qkeys if k in cands.columns]
    qc, small = measured(qcodes.select(*qkeys, F.col("codes").alias("qc")), max_bytes)
    # The documents' codes first (at most 2 * dim a document), so a stored index is read without an exchange.
    dc = stored_rows(dcodes.select("docno", F.col("codes").alias("dc")), cands, 16 * DIM + 32, max_bytes)
    j = cands.join(dc, "docno", "left").join(F.broadcast(qc) if small else qc, qkeys, "left")

    def one(c):
        other = F.exists(F.col("dc"), lambda d: F.floor(d / 2) != F.floor(c / 2))
        return F.when(F.array_contains(F.col("dc"), c), 1.0).when(other, 0.0).otherwise(-1.0)

    s = F.aggregate(F.transform(F.col("qc"), one), F.lit(0.0), lambda a, x: a + x)
    valid = F.col("qc").isNotNull() & F.col("dc").isNotNull() & (F.size("dc") > 0)
    return j.withColumn(out_col, F.when(valid, s).otherwise(F.lit(0.0))).drop("qc", "dc")


def grouped_vectors(vecs: DataFrame, keys) -> DataFrame:
    """``(*keys, vecs ARRAY<ARRAY<DOUBLE>>)`` by position: the vectors of one text, which are few."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("vec").cast("array<double>").alias("vec"))))
    return vecs.groupBy(*keys).agg(F.transform(rows, lambda r: r["vec"]).alias("vecs"))


def maxsim_dense(cands: DataFrame, qtok: DataFrame, dtok: DataFrame, qkeys=("variant", "qid"),
                 out_col: str = "li_score", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D6 for arbitrary token vectors ``(*keys, pos, vec)`` / ``(docno, pos, vec)``.

    A text's vectors stay one array, so a candidate is one row and the maxima
    are taken inside it; no token pairs are shuffled.
    """
    qkeys = [k for k in qkeys if k in cands.columns]
    q, small = measured(grouped_vectors(qtok, qkeys).withColumnRenamed("vecs", "_qv"), max_bytes)
    d = grouped_vectors(dtok, ["docno"]).withColumnRenamed("vecs", "_dv")
    out = cands.join(F.broadcast(q) if small else q, qkeys, "left").join(d, "docno", "left")
    return out.withColumn(out_col, F.coalesce(maxsim("_qv", "_dv"), F.lit(0.0))).drop("_qv", "_dv")


# ---- end-to-end dense retrieval (D5, D6, D8) --------------------------------

def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k best rows, ties (and all but equal scores) by ``order``."""
    if len(scores) <= k:
        return np.arange(len(scores))
    # A little below the k-th score, as the final ranking rounds.
    at = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 2 * 10.0 ** -SCORE_DIGITS)
    if len(at) > k:
        at = at[np.lexsort((order[at], np.round(scores[at], SCORE_DIGITS)))[::-1][:k]]
    return at


def exact_search(queries: DataFrame, docs: DataFrame, k: int, qkeys=("variant", "qid"), cosine: bool = False,
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every query against every document, top k: ``(*qkeys, docno, score, rank)``.

    Both sides carry ``vecs ARRAY<ARRAY<DOUBLE>>``. The score is the sum over a
    query's vectors of the largest product with a document's vector: a dot
    product (or cosine) for single vectors, MAXP for a single query vector,
    MaxSim in general; ``weights`` of the queries, if there, weigh each of
    a query's vectors. The queries go in chunks of at most ``max_bytes``, so any
    number of them works the same way.
    """
    qkeys = list(qkeys)
    spark = docs.sparkSession
    weighted = "weights" in queries.columns
    q = queries.select(*qkeys, "vecs", *(["weights"] if weighted else []))
    size = q.agg(F.coalesce(F.sum(F.aggregate("vecs", F.lit(0).cast("long"), lambda a, v: a + F.size(v) * 8 + 64)), F.lit(0)).alias("b")).first()["b"]
    chunks = max(1, math.ceil(size / max_bytes))
    schema = T.StructType([q.schema[c] for c in qkeys] + [docs.schema["docno"], T.StructField("score", T.DoubleType())])
    out = None
    for c in range(chunks):
        rows = q.filter(F.pmod(F.xxhash64(*qkeys), F.lit(chunks)) == c).collect()  # one chunk: at most about max_bytes
        rows = [r for r in rows if r["vecs"]]
        if not rows:
            continue
        mat = np.concatenate([np.array(r["vecs"], dtype=np.float64) for r in rows])
        first = np.cumsum([0] + [len(r["vecs"]) for r in rows])[:-1]
        weight = np.concatenate([np.array(r["weights"], dtype=np.float64) for r in rows])[:, None] if weighted else None
        held = spark.sparkContext.broadcast(([tuple(r[x] for x in qkeys) for r in rows], first, _unit(mat) if cosine else mat, weight))

        def run(batches):
            import pandas as pd

            names, first, mat, weight = held.value
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) > 0 for v in pdf["vecs"]]]
                if not len(pdf):
                    continue
                d = np.concatenate([np.stack(v).astype(np.float64) for v in pdf["vecs"]])
                d = _unit(d) if cosine else d
                at = np.cumsum([0] + [len(v) for v in pdf["vecs"]])[:-1]
                docno = pdf["docno"].to_numpy()
                order = np.unique(docno, return_inverse=True)[1]
                step = max(1, (4 << 20) // max(1, len(d)))  # queries at a time, for bounded memory
                found = []
                for lo in range(0, len(names), step):
                    hi = min(len(names), lo + step)
                    own = slice(first[lo], first[hi] if hi < len(names) else len(mat))
                    best = np.maximum.reduceat(mat[own] @ d.T, at, axis=1)
                    best = best if weight is None else best * weight[own]
                    scores = np.add.reduceat(best, first[lo:hi] - first[lo], axis=0)
                    for i in range(hi - lo):
                        top = _best(scores[i], order, k)
                        found += [(*names[lo + i], docno[j], float(scores[i, j])) for j in top]
                yield pd.DataFrame(found, columns=[*qkeys, "docno", "score"])

        part = docs.select("docno", "vecs").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, qkeys, k)


def _single(vecs: DataFrame, keys) -> DataFrame:
    return vecs.select(*keys, F.array(F.col("vec").cast("array<double>")).alias("vecs"))


def exact_knn(qvecs: DataFrame, dvecs: DataFrame, k: int, qkeys=("variant", "qid"),
              max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D8 exact: cosine of every query with every document, top k per query."""
    return exact_search(_single(qvecs, list(qkeys)), _single(dvecs, ["docno"]), k, qkeys, True, max_bytes)


def ivf_knn(qvecs: DataFrame, dvecs: DataFrame, k: int, n_cells: int | None = None, nprobe: int | None = None,
            seed: int = 7, qkeys=("variant", "qid"), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D8 approximate: the ``nprobe`` nearest cells of each query (see ``cells``), rescored exactly, top k.

    Unless given, ``n_cells`` grows with the square root of the collection and
    ``nprobe`` is the smallest number with enough recall, measured on a sample
    of the queries; probing all cells is exact.
    """
    from . import cells

    found = cells.build(dvecs, n_cells, seed)
    nprobe = nprobe or cells.enough(found, qvecs, k, qkeys=qkeys)
    return cells.search(found, qvecs, k, nprobe, qkeys=qkeys, max_bytes=max_bytes)
