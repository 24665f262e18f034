"""Tuning queries."""

from __future__ import annotations

from ..operators import tuning
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws
from .q_dense import CAND_BASE, VEC_SCORES

W = Q.with_

# The BM25 grid of the two-stage search (k1, b, k3).
BM25_GRID = tuple((k1, b, k3) for k1 in (0.9, 1.2) for b in (0.4, 0.75) for k3 in (0.75, 8.0))
N_FOLDS = 2

GRID = """agrid AS (SELECT (i::DOUBLE / 10.0::DOUBLE) AS alpha FROM range(0, 10) t(i))"""


def _scan_sql(src: str, name: str, qids: str = "TRUE") -> str:
    return f"""{name}_gs AS (
  SELECT v.variant, v.qid, v.docno, g.alpha, g.alpha * v.score + (1 - g.alpha) * v.cosv AS nscore
  FROM {src} v CROSS JOIN agrid g WHERE {qids}),
{name}_run AS (
  SELECT * FROM (
    SELECT variant, alpha, qid, docno,
           row_number() OVER (PARTITION BY variant, alpha, qid ORDER BY round(nscore, 6) DESC, docno DESC) AS rank
    FROM {name}_gs) x WHERE rank <= 100)"""


SCAN = _scan_sql("vscored", "sc")
BEST = """best AS (
  SELECT * FROM (
    SELECT variant, alpha, value,
           row_number() OVER (PARTITION BY variant ORDER BY round(value, 6) DESC, alpha ASC) AS r
    FROM ev) x WHERE r = 1)"""


@register("m13_grid_alpha_scan", W(*CAND_BASE, VEC_SCORES, Q.QRELS, GRID, SCAN,
                                    Q.metric_ctes("sc_run", ["variant", "alpha"], ["map"]))
          + "SELECT variant, round(alpha, 6) AS alpha, round(value, 6) AS map FROM ev")
def m13_grid_alpha_scan(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(tuning.alpha_scan(M.cosine_scored(w), w.qrels))


@register("m11_grid_alpha_best", W(*CAND_BASE, VEC_SCORES, Q.QRELS, GRID, SCAN,
                                    Q.metric_ctes("sc_run", ["variant", "alpha"], ["map"]), BEST)
          + "SELECT variant, round(alpha, 6) AS alpha, round(value, 6) AS map FROM best")
def m11_grid_alpha_best(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(tuning.best_row(tuning.alpha_scan(M.cosine_scored(w), w.qrels), ["alpha"]))


def _bm25_grid_sql() -> str:
    grid = " UNION ALL ".join(
        f"SELECT {float(k1)!r}::DOUBLE AS k1, {float(b)!r}::DOUBLE AS b, {float(k3)!r}::DOUBLE AS k3"
        for k1, b, k3 in BM25_GRID)
    return W(*Q.BASE, Q.bm25_ctes(depth=100), Q.QRELS, f"""g AS ({grid}),
feat AS (
  SELECT q.variant, q.qid, p.docno, q.qtf::DOUBLE AS qtf, p.tf::DOUBLE AS tf, f.df, s.dl::DOUBLE AS dl,
         c.n_docs, c.avgdl
  FROM bm25_qt q JOIN bm25_post p ON p.term = q.term JOIN bm25_dfs f ON f.term = q.term
  JOIN bm25_dstat s ON s.docno = p.docno CROSS JOIN bm25_coll c),
gsc AS (
  SELECT g.k1, g.b, g.k3, variant, qid, docno,
         sum(log2((n_docs - df + 0.5) / (df + 0.5)) * ((g.k3 + 1) * qtf / (g.k3 + qtf))
             * ((g.k1 + 1) * tf / (g.k1 * ((1 - g.b) + g.b * dl / avgdl) + tf))) AS score
  FROM feat CROSS JOIN g GROUP BY g.k1, g.b, g.k3, variant, qid, docno),
grun AS (
  SELECT * FROM (
    SELECT k1, b, k3, variant, qid, docno,
           row_number() OVER (PARTITION BY k1, b, k3, variant, qid ORDER BY round(score, 6) DESC, docno DESC) AS rank
    FROM gsc) x WHERE rank <= 100)""", Q.metric_ctes("grun", ["variant", "k1", "b", "k3"], ["map"])) + \
        "SELECT variant, k1, b, k3, round(value, 6) AS map FROM ev"


@register("m12_bm25_grid", _bm25_grid_sql())
def m12_bm25_grid(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(tuning.bm25_grid_scan(w.index, w.topics, w.qrels, BM25_GRID))


# The whole grid, 11 x 7 x 9 = 693 settings.
ALL_B = tuple(i / 10 for i in range(11))
ALL_K1 = (0.3, 0.6, 0.9, 1.2, 1.4, 1.6, 2.0)
ALL_K3 = (0.5, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 20.0)


@register("m12_bm25_grid_693")
def m12_bm25_grid_693(spark, sf_dir):
    """Every setting of the grid on every wording (tested against single runs: too slow in SQL)."""
    w = ws(spark, sf_dir)
    return rounded(tuning.bm25_large_grid(w.index, w.topics, w.qrels, ALL_K1, ALL_B, ALL_K3, k=100))


@register("m12_bm25_grid_693_best")
def m12_bm25_grid_693_best(spark, sf_dir):
    """The best setting of each wording."""
    w = ws(spark, sf_dir)
    scan = tuning.bm25_large_grid(w.index, w.topics, w.qrels, ALL_K1, ALL_B, ALL_K3, k=100)
    return rounded(tuning.best_row(scan, ["k1", "b", "k3"]))


def _grid_of_counts() -> tuple:
    return tuple(sorted({k1 for k1, _, _ in BM25_GRID})), tuple(sorted({b for _, b, _ in BM25_GRID})), tuple(sorted({k3 for _, _, k3 in BM25_GRID}))


@register("m12_bm25_grid_by_ranks", _bm25_grid_sql())
def m12_bm25_grid_by_ranks(spark, sf_dir):
    """The small grid, by the same counting of ranks."""
    w = ws(spark, sf_dir)
    return rounded(tuning.bm25_large_grid(w.index, w.topics, w.qrels, *_grid_of_counts(), k=100))


def _fold_sql() -> str:
    parts = [GRID]
    finals = []
    for f in range(N_FOLDS):
        parts.append(f"qr_tr{f} AS (SELECT * FROM qrels WHERE qid % {N_FOLDS} <> {f})")
        parts.append(f"qr_te{f} AS (SELECT * FROM qrels WHERE qid % {N_FOLDS} = {f})")
        parts.append(_scan_sql("vscored", f"tr{f}", f"v.qid % {N_FOLDS} <> {f}"))
        parts.append(_scan_sql("vscored", f"te{f}", f"v.qid % {N_FOLDS} = {f}"))
        parts.append(Q.metric_ctes(f"tr{f}_run", ["variant", "alpha"], ["map"], f"evtr{f}", f"qr_tr{f}"))
        parts.append(Q.metric_ctes(f"te{f}_run", ["variant", "alpha"], ["map"], f"evte{f}", f"qr_te{f}"))
        parts.append(f"""best{f} AS (
  SELECT * FROM (
    SELECT variant, alpha, value,
           row_number() OVER (PARTITION BY variant ORDER BY round(value, 6) DESC, alpha ASC) AS r
    FROM evtr{f}) x WHERE r = 1)""")
        finals.append(f"""SELECT b.variant, {f}::BIGINT AS fold, round(b.alpha, 6) AS alpha,
       round(b.value, 6) AS train_map, round(t.value, 6) AS test_map
FROM best{f} b JOIN evte{f} t ON t.variant = b.variant AND t.alpha = b.alpha""")
    return W(*CAND_BASE, VEC_SCORES, Q.QRELS, *parts) + "\nUNION ALL\n".join(finals)


@register("m14_fold_tuning", _fold_sql())
def m14_fold_tuning(spark, sf_dir):
    w = ws(spark, sf_dir)
    return rounded(tuning.fold_tuning(M.cosine_scored(w), w.qrels, N_FOLDS))
