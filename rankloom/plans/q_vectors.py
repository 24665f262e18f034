"""Dense retrieval on given vectors (D3, D5, D6, D8), and the deep rerank, field and depth queries.

``embeddings`` gives one vector per document (``vectors``) and, in fours, token
vectors of longer documents (``tok_vectors``). Query vectors are every 100th
vector, query groups every 25th document; a document is relevant to a query
vector when it has the same label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, lexical
from ..operators import evaluate as ev
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws
from .sizing import join_hot
from .q_dense import CAND, RUN, VEC_SCORES, rerank_sql

W = Q.with_
K = 10
FIELD_WEIGHTS = {"title": 2.0, "abstract": 1.0}

VECTORS = """vectors AS (SELECT vec_id AS docno, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings),
tok AS (SELECT docno // 4 AS docno, docno % 4 AS pos, vec FROM vectors)"""


def _top(name: str, src: str, k: int = K) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT qid, docno, s AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, docno DESC)::BIGINT AS rank
    FROM {src}) x WHERE rank <= {k})"""


KNN = """sims AS (
  SELECT q.docno AS qid, d.docno,
         list_dot_product(q.vec, d.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(d.vec, d.vec))) AS s
  FROM vectors q CROSS JOIN vectors d WHERE q.docno % 100 = 0)"""
OUT = "SELECT qid, docno, round(score, 6) AS score, rank FROM r"


def _vectors(spark, sf_dir):
    e = ws(spark, sf_dir).table("embeddings")
    vec = F.col("embedding").cast("array<double>")
    # In double, number by number: the norm of each vector.
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return e.select(F.col("vec_id").alias("docno"), vec.alias("vec"), norm.alias("norm"), "label")


def _queries(vectors):
    return vectors.filter(F.col("docno") % 100 == 0).withColumnRenamed("docno", "qid")


def _groups(vectors):
    four = vectors.select((F.col("docno") / 4).cast("long").alias("docno"), (F.col("docno") % 4).alias("pos"), "vec")
    return dense.grouped_vectors(four, ["docno"])


def _same_label(q, v):
    """The judged pairs: by definition all vectors of a query's label, one of ten."""
    return join_hot(v.select("docno", "label"), q.select("qid", "label"), "label", "docno").filter("qid <> docno")


@register("d8_vectors_knn_top10", W(VECTORS, KNN, _top("r", "sims")) + OUT)
def d8_vectors_knn_top10(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(dense.exact_knn(_queries(v), v, K, ("qid",)))


@register("d8_vectors_all_cells", W(VECTORS, KNN, _top("r", "sims")) + OUT)
def d8_vectors_all_cells(spark, sf_dir):
    """The approximate index with every cell probed: the exact result."""
    v = _vectors(spark, sf_dir)
    return rounded(dense.ivf_knn(_queries(v), v, K, n_cells=8, nprobe=8, qkeys=("qid",)))


@register("d3_vectors_rerank", W(VECTORS, """dots AS (
  SELECT q.docno AS qid, d.docno, list_dot_product(q.vec, d.vec) AS s
  FROM vectors q JOIN vectors d ON d.label = q.label AND d.docno <> q.docno WHERE q.docno % 100 = 0)""", _top("r", "dots")) + OUT)
def d3_vectors_rerank(spark, sf_dir):
    """Candidates: the judged documents of each query vector; reranked by dot product."""
    v = _vectors(spark, sf_dir)
    q = _queries(v)
    cands = _same_label(q, v).select("qid", "docno", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    scored = dense.score_vectors(cands, q, v, "dot", ("qid",))
    return rounded(dense.rerank_by(scored, "dense_score", ("qid",), K).select("qid", "docno", "score", "rank"))


@register("d5_vectors_maxp", W(VECTORS, """sims AS (
  SELECT q.docno AS qid, d.docno, max(list_dot_product(q.vec, d.vec)) AS s
  FROM tok q CROSS JOIN tok d WHERE q.docno % 25 = 0 AND q.pos = 0 GROUP BY q.docno, d.docno)""", _top("r", "sims")) + OUT)
def d5_vectors_maxp(spark, sf_dir):
    """One query vector against the best of a document's vectors."""
    g = _groups(_vectors(spark, sf_dir))
    q = g.filter(F.col("docno") % 25 == 0).select(F.col("docno").alias("qid"), F.slice("vecs", 1, 1).alias("vecs"))
    return rounded(dense.exact_search(q, g, K, ("qid",)))


@register("d6_vectors_maxsim", W(VECTORS, """best AS (
  SELECT q.docno AS qid, q.pos, d.docno, max(list_dot_product(q.vec, d.vec)) AS m
  FROM tok q CROSS JOIN tok d WHERE q.docno % 25 = 0 GROUP BY q.docno, q.pos, d.docno),
sims AS (SELECT qid, docno, sum(m) AS s FROM best GROUP BY qid, docno)""", _top("r", "sims")) + OUT)
def d6_vectors_maxsim(spark, sf_dir):
    """Every vector of the query group with its best match, summed."""
    g = _groups(_vectors(spark, sf_dir))
    return rounded(dense.exact_search(g.filter(F.col("docno") % 25 == 0).withColumnRenamed("docno", "qid"), g.select("docno", "vecs"), K, ("qid",)))


_LABELS = "vq AS (SELECT q.docno AS qid, d.docno, 1::BIGINT AS rel FROM vectors q JOIN vectors d ON d.label = q.label AND d.docno <> q.docno WHERE q.docno % 100 = 0)"


@register("m8_vectors_metrics", W(VECTORS, KNN, _top("r", "sims"), _LABELS, Q.metric_ctes("r", [], ["RR@10", "nDCG@10", "P@10", "AP@10"], "ev", "vq"))
          + "SELECT metric, round(value, 6) AS value FROM ev")
def m8_vectors_metrics(spark, sf_dir):
    """Dense retrieval judged by labels (a query's own vector is not relevant)."""
    v = _vectors(spark, sf_dir)
    q = _queries(v)
    rel = _same_label(q, v).select("qid", "docno", F.lit(1).alias("rel"))
    return rounded(ev.evaluate(dense.exact_knn(q, v, K, ("qid",)), rel, ["RR@10", "nDCG@10", "P@10", "AP@10"], keys=()))


# ---- M8: methods without a judged query -----------------------------------------

@register("m8_unjudged_method", W(*Q.BASE, Q.bm25_ctes(depth=100), Q.QRELS, """two AS (
  SELECT 'BM25' AS method, variant, qid, docno, rank FROM bm25
  UNION ALL SELECT 'unjudged', variant, qid, docno, rank FROM bm25 WHERE qid NOT IN (SELECT qid FROM qrels))""",
            Q.metric_ctes("two", ["method", "variant"], ["RR@10", "nDCG@10", "AP@100", "R@50"]))
          + "SELECT method, variant, metric, round(value, 6) AS value FROM ev")
def m8_unjudged_method(spark, sf_dir):
    """A method whose run has no judged query counts 0 for all of them."""
    w = ws(spark, sf_dir)
    run = w.bm25(100).select("variant", "qid", "docno", "rank")
    other = run.join(w.qrels.select("qid").distinct(), "qid", "left_anti").select("variant", "qid", "docno", "rank")
    two = run.withColumn("method", F.lit("BM25")).unionByName(other.withColumn("method", F.lit("unjudged")))
    return rounded(ev.evaluate(two, w.qrels, ["RR@10", "nDCG@10", "AP@100", "R@50"], keys=("method", "variant")))


# ---- L7: the deep first stage reranked, cut afterwards ---------------------------

@register("l7_rerank_depth1000", W(*Q.BASE, Q.bm25_ctes(depth=1000), CAND, VEC_SCORES, rerank_sql("vscored", "cosv", "r", 100))
          + f"SELECT {RUN} FROM r")
def l7_rerank_depth1000(spark, sf_dir):
    scored = M.cosine_scored(ws(spark, sf_dir), 1000)
    return rounded(dense.rerank_by(scored, "dense_score", M.QKEYS, 100).select(*M.RUN_COLS))


# ---- L2: BM25 over several weighted fields ----------------------------------------

@register("l2_bm25_fields", W(Q.CORPUS, Q.TOPICS, f"""ftoks AS (
  SELECT docno, 'title' AS field, {Q.tok('title')} AS toks FROM corpus
  UNION ALL SELECT docno, 'abstract', {Q.tok('abstract')} FROM corpus),
fw(field, w) AS (VALUES ('title', 2.0::DOUBLE), ('abstract', 1.0::DOUBLE)),
fpost AS (
  SELECT docno, term, sum(w) AS tf
  FROM (SELECT docno, field, unnest(toks) AS term FROM ftoks) x JOIN fw USING (field) GROUP BY docno, term),
flen AS (SELECT docno, sum(w * len(toks)) AS dl FROM ftoks JOIN fw USING (field) GROUP BY docno),
fcoll AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl) AS avgdl FROM flen),
fdf AS (SELECT term, count(*)::DOUBLE AS df FROM fpost GROUP BY term),
qt AS (
  SELECT variant, qid, term, count(*)::BIGINT AS qtf
  FROM (SELECT variant, qid, unnest({Q.tok('query')}) AS term FROM topics) x GROUP BY variant, qid, term),
fsc AS (
  SELECT q.variant, q.qid, p.docno,
         sum(log2((c.n_docs - d.df + 0.5) / (d.df + 0.5)) * (9.0::DOUBLE * q.qtf / (8.0::DOUBLE + q.qtf))
             * (2.2::DOUBLE * p.tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / c.avgdl) + p.tf))) AS score
  FROM qt q JOIN fpost p ON p.term = q.term JOIN fdf d ON d.term = q.term JOIN flen l ON l.docno = p.docno CROSS JOIN fcoll c
  GROUP BY q.variant, q.qid, p.docno)""") + """
SELECT variant, qid, docno, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 6) DESC, docno DESC)::BIGINT AS rank
  FROM fsc) x WHERE rank <= 100""")
def l2_bm25_fields(spark, sf_dir):
    w = ws(spark, sf_dir)
    index = lexical.store_field_index(lambda: w.corpus, FIELD_WEIGHTS, w.state("documents"), spark)
    return rounded(lexical.bm25(index, w.topics, 100))


# ---- S9: the stored index ----------------------------------------------------------

@register("s9_index_tables", W(*Q.BASE[:2], f"""toks AS (SELECT docno, {Q.tok('text')} AS toks FROM prepared),
post AS (SELECT DISTINCT docno, term FROM (SELECT docno, unnest(toks) AS term FROM toks) x)""") + """
SELECT 'postings' AS name, (SELECT count(*) FROM post)::BIGINT AS n
UNION ALL SELECT 'terms', (SELECT count(DISTINCT term) FROM post)::BIGINT
UNION ALL SELECT 'documents', (SELECT count(*) FROM toks)::BIGINT
UNION ALL SELECT 'tokens', (SELECT sum(len(toks)) FROM toks)::BIGINT""")
def s9_index_tables(spark, sf_dir):
    """Builds the index where it is missing; the sizes of its tables."""
    i = ws(spark, sf_dir).index
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    coll = i.coll_stats.select(F.explode(F.array(
        F.struct(F.lit("documents").alias("name"), F.col("n_docs").cast("long").alias("n")),
        F.struct(F.lit("tokens").alias("name"), F.col("total_len").alias("n")))).alias("x")).select("x.name", "x.n")
    return size(i.postings, "postings").unionByName(size(i.term_stats, "terms")).unionByName(coll)
