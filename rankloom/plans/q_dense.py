"""Dense, late-interaction, fusion, reranking and experiment queries
(D, F, X, M9, M10 ids)."""

from __future__ import annotations

from ..operators import dense, fusion, rerank
from ..operators import evaluate as ev
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws

W = Q.with_
RUN = "variant, qid, docno, round(score, 6) AS score, rank"


def _h(t: str) -> str:
    return f"('0x' || substr(md5({t}), 1, 8))::BIGINT"


def hashed_sql(name: str, src: str, keys: str, text: str = "text") -> str:
    """``{name}(keys, dim, value)`` raw signed counts and ``{name}_norm(keys, norm)``."""
    return f"""{name}_terms AS (
  SELECT {keys}, term, count(*)::BIGINT AS tf
  FROM (SELECT {keys}, unnest({Q.tok(text)}) AS term FROM {src}) x GROUP BY {keys}, term),
{name} AS (
  SELECT {keys}, ({_h('term')} % 64)::BIGINT AS dim,
         sum(CASE WHEN ({_h('term')} // 64) % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS value
  FROM {name}_terms GROUP BY {keys}, dim),
{name}_norm AS (SELECT {keys}, sqrt(sum(value * value)) AS norm FROM {name} GROUP BY {keys})"""


CAND = """cand AS MATERIALIZED (
  SELECT b.variant, b.qid, b.docno, b.score, b.rank, t.query,
         coalesce(nullif(k.abstract, ''), nullif(k.title, ''), '') AS text
  FROM bm25 b JOIN topics t ON t.variant = b.variant AND t.qid = b.qid
  LEFT JOIN corpus k ON k.docno = b.docno)"""

CAND_BASE = (*Q.BASE, Q.bm25_ctes(depth=100), CAND)

VEC_SCORES = f"""cdocs AS MATERIALIZED (SELECT DISTINCT docno, text FROM cand),
{hashed_sql('dv', 'cdocs', 'docno')},
{hashed_sql('qv', 'topics', 'variant, qid', 'query')},
dotp AS (
  SELECT c.variant, c.qid, c.docno, sum(q.value * d.value) AS dp
  FROM cand c JOIN qv q ON q.variant = c.variant AND q.qid = c.qid
  JOIN dv d ON d.docno = c.docno AND d.dim = q.dim
  GROUP BY c.variant, c.qid, c.docno),
vscored AS MATERIALIZED (
  SELECT c.*, coalesce(p.dp, 0.0) AS dotv,
         CASE WHEN qn.norm > 0 AND dn.norm > 0 THEN coalesce(p.dp, 0.0) / (qn.norm * dn.norm) ELSE 0.0 END AS cosv
  FROM cand c
  LEFT JOIN dotp p ON p.variant = c.variant AND p.qid = c.qid AND p.docno = c.docno
  LEFT JOIN qv_norm qn ON qn.variant = c.variant AND qn.qid = c.qid
  LEFT JOIN dv_norm dn ON dn.docno = c.docno)"""


def rerank_sql(src: str, score: str, name: str, k: int | None = 100, extra: str = "") -> str:
    cut = f"WHERE rank <= {k}" if k else ""
    return f"""{name}_r AS (
  SELECT *, {score} AS nscore FROM {src}),
{name} AS (
  SELECT * FROM (
    SELECT variant, qid, docno, nscore AS score{extra},
           row_number() OVER (PARTITION BY variant, qid ORDER BY round(nscore, 6) DESC, docno DESC)::BIGINT AS rank
    FROM {name}_r) x {cut})"""


FUSION = """fused_n AS (
  SELECT *, min(score) OVER (PARTITION BY variant, qid) AS mn, max(score) OVER (PARTITION BY variant, qid) AS mx
  FROM vscored),
fused_in AS (
  SELECT *, score AS bm25_score,
         CASE WHEN mx > mn THEN (score - mn) / (mx - mn) ELSE 1.0::DOUBLE END AS bm25_norm
  FROM fused_n)"""
FUSED = rerank_sql("fused_in", "(1 - 0.2::DOUBLE) * bm25_norm + 0.2::DOUBLE * cosv", "fused", 100,
                   ", bm25_score, bm25_norm, cosv AS dense_score")


def _codes(expr: str) -> str:
    return (f"list_transform({expr}, lambda t: ({_h('t')} % 64) * 2 + "
            f"CASE WHEN ({_h('t')} // 64) % 2 = 0 THEN 1 ELSE 0 END)")


LATE = f"""qcl AS (
  SELECT variant, qid, unnest({_codes(Q.tok('query'))}) AS code,
         generate_subscripts({_codes(Q.tok('query'))}, 1) AS qpos
  FROM topics),
dcl AS MATERIALIZED (SELECT DISTINCT docno, unnest({_codes(Q.tok('text'))}) AS code FROM (SELECT DISTINCT docno, text FROM cand) x),
dstat AS (SELECT docno, count(DISTINCT code // 2) AS nb, min(code // 2) AS b0 FROM dcl GROUP BY docno),
li_parts AS (
  SELECT c.variant, c.qid, c.docno,
         CASE WHEN d.code IS NOT NULL THEN 1.0::DOUBLE
              WHEN s.nb > 1 OR s.b0 <> q.code // 2 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS v
  FROM cand c JOIN qcl q ON q.variant = c.variant AND q.qid = c.qid
  JOIN dstat s ON s.docno = c.docno
  LEFT JOIN dcl d ON d.docno = c.docno AND d.code = q.code),
li_sum AS (SELECT variant, qid, docno, sum(v) AS li FROM li_parts GROUP BY variant, qid, docno),
li_scored AS (
  SELECT c.*, coalesce(l.li, 0.0::DOUBLE) AS li_score FROM cand c
  LEFT JOIN li_sum l ON l.variant = c.variant AND l.qid = c.qid AND l.docno = c.docno)"""

POINT = f"""pw_in AS (
  SELECT *, CASE WHEN len(list_distinct({Q.tok('query')})) > 0
                 THEN (len(list_intersect(list_distinct({Q.tok('query')}), list_distinct({Q.tok('text')})))
                       / len(list_distinct({Q.tok('query')})))::DOUBLE
                 ELSE 0.0::DOUBLE END AS pointwise
  FROM cand)"""
POINTED = rerank_sql("pw_in", "pointwise", "pointed", 100)

PAIR = """top10 AS (SELECT * FROM pointed WHERE rank <= 10),
pair_s AS (
  SELECT a.variant, a.qid, a.docno, a.score AS pointwise_score,
         coalesce(sum(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a.score - b.score)))), 0.0::DOUBLE) AS pairwise
  FROM top10 a LEFT JOIN top10 b ON b.variant = a.variant AND b.qid = a.qid AND b.docno <> a.docno
  GROUP BY a.variant, a.qid, a.docno, a.score)"""
PAIRED = rerank_sql("pair_s", "pairwise", "paired", None, ", pointwise_score")

METHODS_SQL = f"""{VEC_SCORES},
{FUSION},
{FUSED},
{LATE},
{rerank_sql('li_scored', 'li_score', 'li_run', 100)},
{POINT},
{POINTED},
{rerank_sql('vscored', 'dotv', 'dot_run', 100)},
exp_run AS MATERIALIZED (
  SELECT 'BM25' AS method, variant, qid, docno, score, rank FROM cand
  UNION ALL SELECT '{M.LATE}', variant, qid, docno, score, rank FROM li_run
  UNION ALL SELECT '{M.FUSED}', variant, qid, docno, score, rank FROM fused
  UNION ALL SELECT '{M.COVERED}', variant, qid, docno, score, rank FROM pointed
  UNION ALL SELECT '{M.DOTTED}', variant, qid, docno, score, rank FROM dot_run)"""


# ---- D1, D2: encoders -------------------------------------------------------

@register("d1_doc_vectors", W(*Q.BASE[:2], hashed_sql("dv", "prepared", "docno"))
          + "SELECT docno, dim, value FROM dv WHERE value <> 0")
def d1_doc_vectors(spark, sf_dir):
    v = dense.hashed_vectors(ws(spark, sf_dir).prepared, ["docno"])
    return dense.vectors_long(v, ["docno"])


@register("d1_doc_norms", W(*Q.BASE[:2], hashed_sql("dv", "prepared", "docno"))
          + "SELECT p.docno, round(coalesce(n.norm, 0.0), 6) AS norm FROM prepared p LEFT JOIN dv_norm n USING (docno)")
def d1_doc_norms(spark, sf_dir):
    v = dense.hashed_vectors(ws(spark, sf_dir).prepared, ["docno"])
    return rounded(v.select("docno", "norm"))


@register("d2_query_vectors", W(Q.TOPICS, hashed_sql("qv", "topics", "variant, qid", "query"))
          + "SELECT variant, qid, dim, value FROM qv WHERE value <> 0")
def d2_query_vectors(spark, sf_dir):
    v = M.query_vectors(ws(spark, sf_dir))
    return dense.vectors_long(v, ["variant", "qid"])


# ---- D3, D4, F1-F3: dense rerankers and fusion ------------------------------

@register("d3_cosine_rerank", W(*CAND_BASE, VEC_SCORES, rerank_sql("vscored", "cosv", "r", 100))
          + f"SELECT {RUN} FROM r")
def d3_cosine_rerank(spark, sf_dir):
    out = dense.rerank_by(M.cosine_scored(ws(spark, sf_dir)), "dense_score", M.QKEYS, 100)
    return rounded(out.select(*M.RUN_COLS))


@register("d4_dot_rerank", W(*CAND_BASE, VEC_SCORES, rerank_sql("vscored", "dotv", "r", 100))
          + f"SELECT {RUN} FROM r")
def d4_dot_rerank(spark, sf_dir):
    out = dense.rerank_by(M.dot_scored(ws(spark, sf_dir)), "dense_score", M.QKEYS, 100)
    return rounded(out.select(*M.RUN_COLS))


@register("f1_minmax_norm", W(*CAND_BASE, VEC_SCORES, FUSION)
          + "SELECT variant, qid, docno, round(bm25_norm, 6) AS bm25_norm FROM fused_in")
def f1_minmax_norm(spark, sf_dir):
    c = ws(spark, sf_dir).bm25(100)
    return rounded(fusion.minmax_norm(c, "score", "bm25_norm").select("variant", "qid", "docno", "bm25_norm"))


@register("f2_convex_fusion", W(*CAND_BASE, VEC_SCORES, FUSION, FUSED)
          + f"SELECT {RUN}, round(bm25_score, 6) AS bm25_score, round(bm25_norm, 6) AS bm25_norm, "
            "round(dense_score, 6) AS dense_score FROM fused")
def f2_convex_fusion(spark, sf_dir):
    out = fusion.convex_fusion(M.cosine_scored(ws(spark, sf_dir)), "dense_score", M.SBERT_ALPHA, k=100)
    return rounded(out.select(*M.RUN_COLS, "bm25_score", "bm25_norm", "dense_score"))


@register("f3_interpolation", W(*CAND_BASE, VEC_SCORES,
                                 rerank_sql("vscored", "0.2::DOUBLE * score + 0.8::DOUBLE * cosv", "r", 100))
          + f"SELECT {RUN} FROM r")
def f3_interpolation(spark, sf_dir):
    out = fusion.interpolate(M.cosine_scored(ws(spark, sf_dir)), "dense_score", 0.2, k=100)
    return rounded(out.select(*M.RUN_COLS))


# ---- D6: late interaction ---------------------------------------------------

@register("d6_late_interaction", W(*CAND_BASE, LATE, rerank_sql("li_scored", "li_score", "r", 100))
          + f"SELECT {RUN} FROM r")
def d6_late_interaction(spark, sf_dir):
    out = dense.rerank_by(M.late_interaction_scored(ws(spark, sf_dir)), "li_score", M.QKEYS, 100)
    return rounded(out.select(*M.RUN_COLS))


# ---- X1-X3: pointwise, pairwise, cascade ------------------------------------

def _pointwise(w, k):
    return rerank.pointwise(w.bm25(100), k=k, scorer=lambda d: M.covered(w, d))


@register("x1_pointwise", W(*CAND_BASE, POINT, POINTED) + f"SELECT {RUN} FROM pointed")
def x1_pointwise(spark, sf_dir):
    return rounded(_pointwise(ws(spark, sf_dir), 100).select(*M.RUN_COLS))


@register("x2_pairwise_top10", W(*CAND_BASE, POINT, POINTED, PAIR, PAIRED)
          + f"SELECT {RUN} FROM paired")
def x2_pairwise_top10(spark, sf_dir):
    pw = _pointwise(ws(spark, sf_dir), 10)
    return rounded(rerank.pairwise(pw).select(*M.RUN_COLS))


@register("x3_cascade", W(*CAND_BASE, POINT, POINTED, PAIR, PAIRED)
          + f"SELECT {RUN}, round(pointwise_score, 6) AS pointwise_score FROM paired")
def x3_cascade(spark, sf_dir):
    w = ws(spark, sf_dir)
    out = rerank.cascade(w.bm25(100), 100, 10, scorer=lambda d: M.covered(w, d))
    return rounded(out.select(*M.RUN_COLS, "pointwise_score"))


# ---- M9, M10: the experiment ------------------------------------------------

EXP_METRICS = list(ev.MAIN_METRICS)


@register("m9_experiment_description",
          W(*CAND_BASE, METHODS_SQL, Q.QRELS,
            "exp_d AS (SELECT * FROM exp_run WHERE variant = 'description')",
            Q.metric_ctes("exp_d", ["method"], EXP_METRICS))
          + "SELECT method, metric, round(value, 6) AS value FROM ev")
def m9_experiment_description(spark, sf_dir):
    w = ws(spark, sf_dir)
    run = M.experiment_run(w.only("description"))
    return rounded(ev.evaluate(run, w.qrels, EXP_METRICS, keys=("method",)))


@register("m10_experiment_all_variants",
          W(*CAND_BASE, METHODS_SQL, Q.QRELS, Q.metric_ctes("exp_run", ["method", "variant"], EXP_METRICS))
          + "SELECT method, variant, metric, round(value, 6) AS value FROM ev")
def m10_experiment_all_variants(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(ev.evaluate(M.experiment_run(w), w.qrels, EXP_METRICS, keys=("method", "variant")))
