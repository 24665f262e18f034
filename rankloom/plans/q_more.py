"""Remaining preparation, field-index, passage, token-index, kNN and feedback
queries (P2-P13, L2, D5, D7-D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import dense, feedback, fusion, lexical, textprep
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws
from .q_dense import CAND_BASE, RUN, _codes, hashed_sql, rerank_sql

W = Q.with_
WS = Q.WS

# ---- P2-P4: text preparation variants --------------------------------------


@register("p2_concat_title_abstract", W(Q.CORPUS) + f"""
SELECT docno AS doc_id, trim(coalesce(title, '') || ' ' || coalesce(abstract, ''), {WS}) AS text FROM corpus""")
def p2_concat_title_abstract(spark, sf_dir):
    return textprep.prepare_concat(ws(spark, sf_dir).corpus, " ")


_P3 = f"trim(coalesce(title, '') || chr(10) || coalesce(abstract, ''), {WS})"


@register("p3_newline_nonempty", W(Q.CORPUS) + f"SELECT docno, {_P3} AS text FROM corpus WHERE {_P3} <> ''")
def p3_newline_nonempty(spark, sf_dir):
    return textprep.prepare_concat(ws(spark, sf_dir).corpus, "\n", drop_empty=True, id_col="docno")


@register("p4_newline_all", W(Q.CORPUS) + f"SELECT docno, {_P3} AS text FROM corpus")
def p4_newline_all(spark, sf_dir):
    return textprep.prepare_concat(ws(spark, sf_dir).corpus, "\n", drop_empty=False, id_col="docno")


# ---- P5, P6, P13: text and metadata attached to candidates ------------------

@register("p5_attach_text", W(*CAND_BASE) + "SELECT variant, qid, docno, text FROM cand")
def p5_attach_text(spark, sf_dir):
    return M.candidates(ws(spark, sf_dir)).select("variant", "qid", "docno", "text")


@register("p6_attach_title", W(*Q.BASE, Q.bm25_ctes(depth=100)) + """
SELECT b.variant, b.qid, b.docno, k.title FROM bm25 b LEFT JOIN corpus k ON k.docno = b.docno""")
def p6_attach_title(spark, sf_dir):
    w = ws(spark, sf_dir)
    return textprep.attach_field(w.bm25(100), w.corpus, "title").select("variant", "qid", "docno", "title")


@register("p13_top10_with_title", W(*Q.BASE, Q.bm25_ctes(depth=100)) + """
SELECT b.variant, b.qid, b.docno, b.rank, k.title FROM bm25 b LEFT JOIN corpus k ON k.docno = b.docno
WHERE b.rank <= 10""")
def p13_top10_with_title(spark, sf_dir):
    w = ws(spark, sf_dir)
    top = lexical.cutoff(w.bm25(100), 10)
    return textprep.attach_field(top, w.corpus, "title").select("variant", "qid", "docno", "rank", "title")


# ---- P10, P11 ----------------------------------------------------------------

@register("p10_length_limits", W(*Q.BASE[:2]) + f"""
SELECT docno, len({Q.tok('text')}[1:512])::BIGINT AS n_tokens_512,
       length(substr(text, 1, 4096))::BIGINT AS n_chars_4096 FROM prepared""")
def p10_length_limits(spark, sf_dir):
    p = ws(spark, sf_dir).prepared
    return p.select("docno", F.size(textprep.truncate_tokens("text", 512)).cast("long").alias("n_tokens_512"),
                    F.length(textprep.truncate_chars("text", 4096)).cast("long").alias("n_chars_4096"))


@register("p10_cut_texts", W(*Q.BASE[:2]) + f"""
SELECT docno, md5(array_to_string({Q.tok('text')}[1:512], ' ')) AS tokens_512, md5(substr(text, 1, 4096)) AS chars_4096,
       md5(substr(text, 1, 2048)) AS chars_2048 FROM prepared""")
def p10_cut_texts(spark, sf_dir):
    """The cut texts themselves, as hashes."""
    p = ws(spark, sf_dir).prepared
    return p.select("docno", F.md5(F.array_join(textprep.truncate_tokens("text", 512), " ")).alias("tokens_512"),
                    *[F.md5(textprep.truncate_chars("text", n)).alias(f"chars_{n}") for n in (4096, 2048)])


@register("p10_query_token_limit", W(Q.TOPICS) + f"""
SELECT variant, qid, len({Q.tok('query')}[1:36])::BIGINT AS n_tokens_36 FROM topics""")
def p10_query_token_limit(spark, sf_dir):
    t = ws(spark, sf_dir).topics
    return t.select("variant", "qid", F.size(F.slice(tokens("query"), 1, 36)).cast("long").alias("n_tokens_36"))


@register("p11_score_threshold", W(*Q.BASE, Q.bm25_ctes(depth=100)) + f"SELECT {RUN} FROM bm25 WHERE score >= 1.0")
def p11_score_threshold(spark, sf_dir):
    return rounded(textprep.score_threshold(ws(spark, sf_dir).bm25(100), 1.0))


# ---- L2: field postings ------------------------------------------------------

@register("l2_field_postings", W(Q.CORPUS) + f"""
SELECT docno, field, term, count(*)::BIGINT AS tf FROM (
  SELECT docno, 'title' AS field, unnest({Q.tok('title')}) AS term FROM corpus
  UNION ALL
  SELECT docno, 'abstract' AS field, unnest({Q.tok('abstract')}) AS term FROM corpus) x
GROUP BY docno, field, term""")
def l2_field_postings(spark, sf_dir):
    fp = lexical.field_postings(ws(spark, sf_dir).corpus)
    return fp.select("docno", "field", "term", "tf")


# ---- D5: forward index, MAXP, interpolation -----------------------------------

D5_SQL = W(*CAND_BASE, f"""cdocs AS (SELECT DISTINCT docno FROM cand),
psg AS (
  SELECT docno, unnest(string_split(text, chr(10))) AS ptext
  , generate_subscripts(string_split(text, chr(10)), 1) - 1 AS psg
  FROM (SELECT doc_id AS docno, text FROM documents WHERE doc_id IN (SELECT docno FROM cdocs)) x),
psg2 AS (SELECT docno, psg, ptext FROM psg WHERE trim(ptext, {WS}) <> ''),
{hashed_sql('pv', 'psg2', 'docno, psg', 'ptext')},
{hashed_sql('qv', 'topics', 'variant, qid', 'query')},
pdot AS (
  SELECT c.variant, c.qid, c.docno, p.psg, sum(q.value * p.value) AS dp
  FROM cand c JOIN qv q ON q.variant = c.variant AND q.qid = c.qid
  JOIN pv p ON p.docno = c.docno AND p.dim = q.dim
  GROUP BY c.variant, c.qid, c.docno, p.psg),
pcos AS (
  SELECT c.variant, c.qid, c.docno,
         max(CASE WHEN qn.norm > 0 AND pn.norm > 0 THEN coalesce(d.dp, 0.0) / (qn.norm * pn.norm) ELSE 0.0 END) AS maxp
  FROM cand c JOIN psg2 s ON s.docno = c.docno
  LEFT JOIN pdot d ON d.variant = c.variant AND d.qid = c.qid AND d.docno = c.docno AND d.psg = s.psg
  LEFT JOIN qv_norm qn ON qn.variant = c.variant AND qn.qid = c.qid
  LEFT JOIN pv_norm pn ON pn.docno = s.docno AND pn.psg = s.psg
  GROUP BY c.variant, c.qid, c.docno),
ff AS (
  SELECT c.*, coalesce(p.maxp, 0.0) AS maxp FROM cand c
  LEFT JOIN pcos p ON p.variant = c.variant AND p.qid = c.qid AND p.docno = c.docno)""",
           rerank_sql("ff", "0.2::DOUBLE * score + 0.8::DOUBLE * maxp", "r", 100)) + f"SELECT {RUN} FROM r"


@register("d5_maxp_interpolation", D5_SQL)
def d5_maxp_interpolation(spark, sf_dir):
    w = ws(spark, sf_dir)
    scored = dense.maxp_scores(w.bm25(100), M.query_vectors(w), w.forward_passages)
    return rounded(fusion.interpolate(scored, "dense_score", 0.2, k=100).select(*M.RUN_COLS))


# ---- D7: multi-vector (token) index ----------------------------------------------

@register("d7_token_index", W(*Q.BASE[:2]) + f"""
SELECT docno, (generate_subscripts(toks, 1) - 1)::BIGINT AS pos, unnest(toks) AS term,
       unnest({_codes('toks')})::BIGINT AS code
FROM (SELECT docno, {Q.tok('text')} AS toks FROM prepared) x""")
def d7_token_index(spark, sf_dir):
    p = ws(spark, sf_dir).prepared
    t = p.select("docno", F.posexplode_outer(tokens("text")).alias("pos", "term")).filter(F.col("term").isNotNull())
    code = (dense.term_hash("term") % dense.DIM) * 2 + F.when(F.floor(dense.term_hash("term") / dense.DIM) % 2 == 0, 1).otherwise(0)
    return t.select("docno", F.col("pos").cast("long"), "term", code.cast("long").alias("code"))


# ---- D8: end-to-end dense retrieval ------------------------------------------------

EXACT_KNN = W(*Q.BASE[:3], hashed_sql("dv", "prepared", "docno"),
                                   hashed_sql("qv", "topics", "variant, qid", "query"), """dotp AS (
  SELECT q.variant, q.qid, d.docno, sum(q.value * d.value) AS dp
  FROM qv q JOIN dv d ON d.dim = q.dim GROUP BY q.variant, q.qid, d.docno),
sc AS (
  SELECT t.variant, t.qid, p.docno,
         CASE WHEN qn.norm > 0 AND dn.norm > 0 THEN coalesce(x.dp, 0.0) / (qn.norm * dn.norm) ELSE 0.0 END AS nscore
  FROM topics t CROSS JOIN prepared p
  LEFT JOIN dotp x ON x.variant = t.variant AND x.qid = t.qid AND x.docno = p.docno
  LEFT JOIN qv_norm qn ON qn.variant = t.variant AND qn.qid = t.qid
  LEFT JOIN dv_norm dn ON dn.docno = p.docno),
r AS (
  SELECT * FROM (SELECT variant, qid, docno, nscore AS score,
    row_number() OVER (PARTITION BY variant, qid ORDER BY round(nscore, 6) DESC, docno DESC)::BIGINT AS rank
    FROM sc) y WHERE rank <= 10)""") + f"SELECT {RUN} FROM r"


@register("d8_exact_knn_top10", EXACT_KNN)
def d8_exact_knn_top10(spark, sf_dir):
    w = ws(spark, sf_dir)
    dv = dense.hashed_vectors(w.prepared, ["docno"])
    return rounded(dense.exact_knn(M.query_vectors(w), dv, 10))


@register("d8_ivf_knn_top10")
def d8_ivf_knn_top10(spark, sf_dir):
    w = ws(spark, sf_dir)
    dv = dense.hashed_vectors(w.prepared, ["docno"])
    return rounded(dense.ivf_knn(M.query_vectors(w), dv, 10))


# ---- D9, D10: pseudo-relevance feedback ------------------------------------------

FEEDBACK = """fb AS (SELECT variant, qid, docno FROM bm25 WHERE rank <= 3),
all_post AS (
  SELECT docno, term, count(*)::BIGINT AS tf
  FROM (SELECT docno, unnest(toks) AS term FROM bm25_docs) x GROUP BY docno, term),
all_df AS (SELECT term, count(*)::DOUBLE AS df FROM all_post GROUP BY term),
fb_terms AS (
  SELECT f.variant, f.qid, p.term, sum(p.tf)::DOUBLE AS cnt
  FROM fb f JOIN all_post p ON p.docno = f.docno GROUP BY f.variant, f.qid, p.term),
fb_w AS (
  SELECT t.variant, t.qid, t.term, ln((c.n_docs + 1) / (d.df + 1)) AS idf,
         row_number() OVER (PARTITION BY t.variant, t.qid
           ORDER BY round(t.cnt * ln((c.n_docs + 1) / (d.df + 1)), 9) DESC, t.term) AS r
  FROM fb_terms t JOIN all_df d ON d.term = t.term CROSS JOIN bm25_coll c),
eq AS (
  SELECT variant, qid, term, sum(qtf) AS qtf FROM (
    SELECT variant, qid, term, qtf::DOUBLE AS qtf FROM bm25_qt
    UNION ALL SELECT variant, qid, term, idf FROM fb_w WHERE r <= 10) x
  GROUP BY variant, qid, term),
ex_sc AS (
  SELECT q.variant, q.qid, p.docno,
         sum(log2((c.n_docs - d.df + 0.5) / (d.df + 0.5)) * (9.0::DOUBLE * q.qtf / (8.0::DOUBLE + q.qtf))
             * (2.2::DOUBLE * p.tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.dl / c.avgdl) + p.tf))) AS score
  FROM eq q JOIN all_post p ON p.term = q.term JOIN all_df d ON d.term = q.term
  JOIN bm25_dstat s ON s.docno = p.docno CROSS JOIN bm25_coll c
  GROUP BY q.variant, q.qid, p.docno)"""


@register("d9_prf_ranker", W(*Q.BASE, Q.bm25_ctes(depth=100), FEEDBACK) + """
SELECT variant, qid, docno, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 6) DESC, docno DESC)::BIGINT AS rank
  FROM ex_sc) x WHERE rank <= 100""")
def d9_prf_ranker(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(feedback.prf_ranker(w.index, w.topics, w.bm25(100), k=100))


@register("d10_prf_reranker", W(*Q.BASE, Q.bm25_ctes(depth=100), FEEDBACK) + """
SELECT variant, qid, docno, round(score, 6) AS score,
       row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 6) DESC, docno DESC)::BIGINT AS rank
FROM (SELECT b.variant, b.qid, b.docno, coalesce(e.score, 0.0) AS score
      FROM bm25 b LEFT JOIN ex_sc e ON e.variant = b.variant AND e.qid = b.qid AND e.docno = b.docno) x""")
def d10_prf_reranker(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(feedback.prf_reranker(w.index, w.topics, w.bm25(100)).select(*M.RUN_COLS))
