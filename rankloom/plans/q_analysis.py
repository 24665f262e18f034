"""Analysis and result sink/source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..sources import results as R
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws
from .experiment import EXP_METRICS, PUBLISHED_MRT, comparison_long, measure_mrt, metrics_long, published_mrt, published_names
from .q_dense import CAND_BASE, METHODS_SQL

W = Q.with_

MT = (*CAND_BASE, METHODS_SQL, Q.QRELS, Q.metric_ctes("exp_run", ["method", "variant"], EXP_METRICS),
      "mt AS MATERIALIZED (SELECT method, variant, metric, round(value, 6) AS value FROM ev)")
METHOD_SET = sorted(M.METHODS)


def _long(spark, sf_dir):
    return metrics_long(ws(spark, sf_dir))


def _q(s: str) -> str:
    return s.replace("'", "''")


_names = " ".join(f"WHEN '{_q(a)}' THEN '{_q(b)}'" for a, b in M.PUBLISHED.items())
_times = ", ".join(f"('{v}', '{_q(m)}', {t!r}::DOUBLE)" for (v, m), t in PUBLISHED_MRT.items())
#: The metrics under published labels (mp), and with the published response times (mc).
MC = (*MT, f"""mp AS (SELECT variant, CASE method {_names} ELSE method END AS method, metric, value FROM mt),
times(variant, method, mrt) AS (VALUES {_times}),
mc AS MATERIALIZED (
  SELECT variant, method, metric, value FROM mp
  UNION ALL
  SELECT t.variant, t.method, 'mrt', t.mrt FROM times t
  JOIN (SELECT DISTINCT variant, method FROM mp) p ON p.variant = t.variant AND p.method = t.method)""")


# ---- A1-A5 ------------------------------------------------------------------

@register("a1_label_variants", W(*MC) + """
SELECT upper(substr(variant, 1, 1)) || substr(variant, 2) AS query_type, variant,
       CASE WHEN method = 'BM25 >> MINILM % 100' THEN 'BM25 >> SBERT % 100' ELSE method END AS method,
       CASE WHEN metric = 'mrt' THEN 'mrt (ms)' ELSE metric END AS metric, value
FROM mc""")
def a1_label_variants(spark, sf_dir):
    return A.label(comparison_long(ws(spark, sf_dir))).select("query_type", "variant", "method", "metric", "value")


_order = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(A.VARIANT_ORDER))
_pivot_cols = ", ".join(f"max(CASE WHEN method = '{_q(m)}' THEN value END) AS \"{m}\"" for m in METHOD_SET)


@register("a2_pivot_ap100", W(*MT) + f"""
SELECT variant, (CASE variant {_order} END)::BIGINT AS variant_order, {_pivot_cols}
FROM mt WHERE metric = 'AP@100' GROUP BY variant""")
def a2_pivot_ap100(spark, sf_dir):
    return A.pivot_metric(_long(spark, sf_dir), "AP@100", METHOD_SET)


@register("a3_description_only", W(*MT) + "SELECT method, variant, metric, value FROM mt WHERE variant = 'description'")
def a3_description_only(spark, sf_dir):
    return A.keep_variant(_long(spark, sf_dir), "description").select("method", "variant", "metric", "value")


@register("a4_unpivot_recall", W(*MT) + f"""
SELECT variant, method, metric, value FROM mt
WHERE variant = 'description' AND metric IN ({", ".join(f"'{m}'" for m in A.RECALL_METRICS)})""")
def a4_unpivot_recall(spark, sf_dir):
    wide = A.method_metric_table(A.keep_variant(_long(spark, sf_dir)), A.RECALL_METRICS)
    return A.unpivot_metrics(wide, A.RECALL_METRICS).orderBy("method")


_metric_cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS \"{m}\"" for m in A.QUALITY_METRICS)


@register("a5_method_metric_table", W(*MT) + f"SELECT variant, method, {_metric_cols} FROM mt GROUP BY variant, method")
def a5_method_metric_table(spark, sf_dir):
    return A.method_metric_table(_long(spark, sf_dir), A.QUALITY_METRICS)


# ---- A6-A11 -----------------------------------------------------------------

@register("a6_minmax_methods", W(*MT) + """
SELECT variant, method, metric, round((value - mn) / nullif(mx - mn, 0), 6) AS norm_value
FROM (SELECT *, min(value) OVER (PARTITION BY variant, metric) AS mn,
             max(value) OVER (PARTITION BY variant, metric) AS mx FROM mt) x""")
def a6_minmax_methods(spark, sf_dir):
    return rounded(A.minmax_across_methods(_long(spark, sf_dir)).select("variant", "method", "metric", "norm_value"))


@register("a7_rank_methods", W(*MT) + """
SELECT variant, method, metric,
       (rank() OVER (PARTITION BY variant, metric ORDER BY value DESC))::DOUBLE
       + (count(*) OVER (PARTITION BY variant, metric, value) - 1) / 2.0::DOUBLE AS rank
FROM mt""")
def a7_rank_methods(spark, sf_dir):
    return A.rank_methods(_long(spark, sf_dir)).select("variant", "method", "metric", "rank")


_PCT = """pct AS (
  SELECT m.variant, m.method, m.metric, m.value, b.value AS base_value,
         (m.value - b.value) / nullif(b.value, 0) * 100.0::DOUBLE AS pct
  FROM mc m JOIN mc b ON b.variant = m.variant AND b.metric = m.metric AND b.method = 'BM25')"""


@register("a8_pct_vs_baseline", W(*MC, _PCT) + "SELECT variant, method, metric, round(pct, 6) AS pct FROM pct")
def a8_pct_vs_baseline(spark, sf_dir):
    return rounded(A.pct_vs_baseline(comparison_long(ws(spark, sf_dir))).select("variant", "method", "metric", "pct"))


_QM = ", ".join(f"'{m}'" for m in A.QUALITY_METRICS)


@register("a9_pct_quality", W(*MC, _PCT) + f"SELECT variant, method, metric, round(pct, 6) AS pct FROM pct WHERE metric IN ({_QM})")
def a9_pct_quality(spark, sf_dir):
    out = A.pct_vs_baseline(comparison_long(ws(spark, sf_dir)), metrics=A.QUALITY_METRICS)
    return rounded(out.select("variant", "method", "metric", "pct"))


_CLEAN = f"replace(replace(method, '{A.NAME_PREFIX}', ''), '{A.NAME_SUFFIX}', '')"


@register("a10_clean_names", W(*MT) + f"SELECT DISTINCT method AS full_name, {_CLEAN} AS method FROM mt WHERE method <> 'BM25'")
def a10_clean_names(spark, sf_dir):
    names = _long(spark, sf_dir).select(F.col("method").alias("full_name"), "method").distinct()
    return A.clean_names(names).select("full_name", "method")


@register("a11_improvements_long", W(*MC, _PCT) + f"""
SELECT variant, {_CLEAN} AS method, metric, round(pct, 6) AS pct
FROM pct WHERE metric IN ({_QM}) AND method <> 'BM25'""")
def a11_improvements_long(spark, sf_dir):
    return rounded(A.improvements(comparison_long(ws(spark, sf_dir))))


# ---- M7: measured response time (rows only); A12, A13 on published times ----

@register("m7_mrt")
def m7_mrt(spark, sf_dir):
    return measure_mrt(ws(spark, sf_dir))


@register("a12_improvements_with_mrt", W(*MC, _PCT) + f"""
SELECT p.variant, {_CLEAN.replace("method", "p.method")} AS method, p.metric, round(p.pct, 6) AS pct, round(t.mrt, 6) AS mrt
FROM pct p LEFT JOIN times t ON t.variant = p.variant AND t.method = p.method
WHERE p.metric IN ({_QM}) AND p.method <> 'BM25'""")
def a12_improvements_with_mrt(spark, sf_dir):
    long = comparison_long(ws(spark, sf_dir))
    return rounded(A.with_response_time(A.improvements(long), published_mrt(long)))


@register("a13_quality_vs_cost", W(*MC) + """
SELECT p.variant, p.method, p.value AS quality, round(t.mrt, 6) AS mrt
FROM mp p LEFT JOIN times t ON t.variant = p.variant AND t.method = p.method WHERE p.metric = 'nDCG@10'""")
def a13_quality_vs_cost(spark, sf_dir):
    long = published_names(_long(spark, sf_dir))
    return rounded(A.quality_vs_cost(long, published_mrt(long)))


# ---- A14 --------------------------------------------------------------------

_var_cols = ", ".join(f"max(CASE WHEN variant = '{v}' THEN value END) AS {v}" for v in A.VARIANT_ORDER)


@register("a14_metric_by_variant", W(*MT) + f"""
SELECT method, {_var_cols} FROM mt
WHERE metric = 'nDCG@10' AND method IN (SELECT DISTINCT method FROM exp_run)
GROUP BY method""")
def a14_metric_by_variant(spark, sf_dir):
    w = ws(spark, sf_dir)
    present = M.experiment_run(w).select("method").distinct()
    return A.metric_by_variant(_long(spark, sf_dir), "nDCG@10", present)


# ---- S6-S11 -----------------------------------------------------------------

@register("s6_counts", W(*Q.BASE, Q.QRELS, Q.bm25_ctes(depth=100)) + f"""
SELECT 'documents' AS name, (SELECT count(*) FROM documents)::BIGINT AS n
UNION ALL SELECT 'topics', (SELECT count(*) FROM topics)::BIGINT
UNION ALL SELECT 'qrels', (SELECT count(*) FROM qrels)::BIGINT
UNION ALL SELECT 'postings', (SELECT count(*) FROM (SELECT DISTINCT docno, t FROM
    (SELECT docno, unnest({Q.tok('text')}) AS t FROM prepared) x) y)::BIGINT
UNION ALL SELECT 'bm25_top100', (SELECT count(*) FROM bm25)::BIGINT""")
def s6_counts(spark, sf_dir):
    return ws(spark, sf_dir).counts()


@register("s7_s8_results_json", W(*MT) + "SELECT variant, method, metric, value FROM mt")
def s7_s8_results_json(spark, sf_dir):
    path = R.scratch_path(spark, "results-json")
    R.write_results_json(_long(spark, sf_dir), path, "results")
    return R.read_results_json(spark, path).select("variant", "method", "metric", "value")


@register("s9_materialized_bm25", W(*Q.BASE, Q.bm25_ctes(depth=100))
          + "SELECT variant, qid, docno, round(score, 6) AS score, rank FROM bm25")
def s9_materialized_bm25(spark, sf_dir):
    return rounded(ws(spark, sf_dir).stored_run)


_tsv_cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS \"{m}\"" for m in EXP_METRICS)


@register("s10_tsv_table", W(*MT) + f"SELECT variant, method, {_tsv_cols} FROM mt GROUP BY variant, method")
def s10_tsv_table(spark, sf_dir):
    wide = A.method_metric_table(_long(spark, sf_dir), EXP_METRICS)
    path = R.scratch_path(spark, "tsv")
    R.write_table(wide, path, "\t")
    schema = "variant string, method string, " + ", ".join(f"`{m}` double" for m in EXP_METRICS)
    return R.read_table(spark, path, schema, "\t")


@register("s11_trec_run", W(*Q.BASE, Q.bm25_ctes(depth=100)) + """
SELECT concat_ws(' ', qid::VARCHAR, 'Q0', docno::VARCHAR, rank::VARCHAR, printf('%.6f', round(score, 6)), 'BM25') AS line
FROM bm25""")
def s11_trec_run(spark, sf_dir):
    path = R.scratch_path(spark, "trec")
    R.write_trec_run(ws(spark, sf_dir).bm25(100), path, "BM25")
    return spark.read.text(path).withColumnRenamed("value", "line")
