"""Sources, text preparation, lexical index and BM25 queries (S, P, L ids)."""

from __future__ import annotations

from ..operators import evaluate as ev
from ..operators import lexical
from . import sql as Q
from .catalog import register, rounded, ws

W = Q.with_


@register("s1_corpus", W(Q.CORPUS) + "SELECT docno, title, abstract, lang, source FROM corpus")
def s1_corpus(spark, sf_dir):
    return ws(spark, sf_dir).corpus


@register("s3_topics", W(Q.TOPICS) + "SELECT qid, variant, query FROM topics")
def s3_topics(spark, sf_dir):
    return ws(spark, sf_dir).topics


@register("s5_qrels", W(Q.QRELS) + "SELECT qid, docno, rel FROM qrels")
def s5_qrels(spark, sf_dir):
    return ws(spark, sf_dir).judged()


@register("p1_prepared_text", W(Q.CORPUS, Q.PREPARED) + "SELECT docno, text FROM prepared")
def p1_prepared_text(spark, sf_dir):
    return ws(spark, sf_dir).prepared


@register("l1_postings", W(*Q.BASE[:2]) + f"""
SELECT docno, term, count(*)::BIGINT AS tf
FROM (SELECT docno, unnest({Q.tok('text')}) AS term FROM prepared) x
GROUP BY docno, term""")
def l1_postings(spark, sf_dir):
    return lexical.postings(ws(spark, sf_dir).prepared)


@register("l1_doc_stats", W(*Q.BASE[:2]) + f"SELECT docno, len({Q.tok('text')})::BIGINT AS dl FROM prepared")
def l1_doc_stats(spark, sf_dir):
    return lexical.doc_stats(ws(spark, sf_dir).prepared)


@register("l3_collection_stats", W(*Q.BASE[:2]) + f"""
, d AS (SELECT docno, {Q.tok('text')} AS toks FROM prepared)
SELECT (SELECT count(*) FROM d)::BIGINT AS n_docs,
       (SELECT coalesce(sum(len(toks)), 0) FROM d)::BIGINT AS total_len,
       round((SELECT avg(len(toks)) FROM d)::DOUBLE, 6) AS avgdl,
       (SELECT count(DISTINCT t) FROM (SELECT unnest(toks) AS t FROM d) x)::BIGINT AS n_terms""".replace("\n, d AS", ",\nd AS"))
def l3_collection_stats(spark, sf_dir):
    return rounded(lexical.collection_stats(ws(spark, sf_dir).prepared))


_RUN_SQL = "SELECT variant, qid, docno, round(score, 6) AS score, rank FROM bm25"


@register("l4_bm25_top100", W(*Q.BASE, Q.bm25_ctes(depth=100)) + _RUN_SQL)
def l4_bm25_top100(spark, sf_dir):
    return rounded(ws(spark, sf_dir).bm25(100))


@register("l5_bm25_params", W(*Q.BASE, Q.bm25_ctes(k1=0.75, b=0.75, k3=0.75, depth=100)) + _RUN_SQL)
def l5_bm25_params(spark, sf_dir):
    return rounded(ws(spark, sf_dir).bm25(100, lexical.BM25Params(k1=0.75, b=0.75, k3=0.75)))


@register("l5_bm25_idf_plus_one", W(*Q.BASE, Q.bm25_ctes(idf="plus_one", depth=100)) + _RUN_SQL)
def l5_bm25_idf_plus_one(spark, sf_dir):
    return rounded(ws(spark, sf_dir).bm25(100, lexical.BM25Params(idf="plus_one")))


@register("l6_cutoff_top10", W(*Q.BASE, Q.bm25_ctes(depth=100)) + _RUN_SQL + " WHERE rank <= 10")
def l6_cutoff_top10(spark, sf_dir):
    return rounded(lexical.cutoff(ws(spark, sf_dir).bm25(100), 10))


@register("l7_bm25_depth1000", W(*Q.BASE, Q.bm25_ctes(depth=1000)) + _RUN_SQL)
def l7_bm25_depth1000(spark, sf_dir):
    return rounded(ws(spark, sf_dir).bm25(1000))


@register("l7_bm25_depth5000", W(*Q.BASE, Q.bm25_ctes(depth=5000)) + _RUN_SQL)
def l7_bm25_depth5000(spark, sf_dir):
    """Deeper than Spark's own partial limit goes."""
    return rounded(ws(spark, sf_dir).bm25(5000))


# ---- evaluation of the BM25 run (M1-M6, M8) --------------------------------

def _metric_query(name: str, measures: list[str]):
    sql = (W(*Q.BASE, Q.QRELS, Q.bm25_ctes(depth=100), Q.metric_ctes("bm25", ["variant"], measures))
           + "SELECT variant, metric, round(value, 6) AS value FROM ev")

    @register(name, sql)
    def build(spark, sf_dir):
        w = ws(spark, sf_dir)
        return rounded(ev.evaluate(w.bm25(100), w.qrels, measures, keys=("variant",)))

    return build


_metric_query("m1_rr10", ["RR@10"])
_metric_query("m2_ndcg10", ["nDCG@10"])
_metric_query("m3_ap100", ["AP@100"])
_metric_query("m4_map_recip_rank", ["map", "recip_rank", "ndcg"])
_metric_query("m5_p10", ["P@10"])
_metric_query("m6_recall", ["R@10", "R@25", "R@50"])
_metric_query("m8_bm25_all_metrics", list(ev.MAIN_METRICS) + ["P@10", "map", "recip_rank", "ndcg_cut.10"])
