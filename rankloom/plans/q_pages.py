"""Second corpora: JSON lines and web pages (S1), and retrieval over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_tokens
from ..operators import evaluate as ev
from ..operators import lexical, textprep
from ..sources import jsoncorpus
from ..sources import results as R
from . import sql as Q
from .catalog import register, rounded, ws

W = Q.with_
KNOWN_ITEM = 25  # every so many pages is looked for by its title

def _plain(x: str) -> str:
    for name, sign in jsoncorpus.ENTITIES.items():
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


_HTML = "coalesce(html, '')"
_BODY = (f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?is)^.*?</head>', ''), "
         "'(?is)<script[ >].*?</script>|<style[ >].*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")
PAGES = f"""pcorpus AS MATERIALIZED (
  SELECT page_id AS docno, {_plain(f"regexp_extract({_HTML}, '(?is)<title>(.*?)</title>', 1)")} AS title, {_plain(_BODY)} AS abstract FROM pages)"""
PPREP = f"pprep AS (SELECT docno, trim(concat_ws(' ', nullif(title, ''), nullif(abstract, '')), {Q.WS}) AS text FROM pcorpus)"
PTOPICS = f"""ptopics AS (
  SELECT docno AS qid, 'title' AS variant, array_to_string({Q.tok('title')}[1:5], ' ') AS query FROM pcorpus WHERE docno % {KNOWN_ITEM} = 0)"""


@register("s1_pages_corpus", W(PAGES) + "SELECT docno, title, abstract FROM pcorpus")
def s1_pages_corpus(spark, sf_dir):
    return jsoncorpus.corpus_from_pages(ws(spark, sf_dir).table("pages"))


@register("s1_json_corpus", W(Q.CORPUS) + "SELECT docno::VARCHAR AS docno, title, abstract FROM corpus WHERE docno IS NOT NULL")
def s1_json_corpus(spark, sf_dir):
    """The corpus written as JSON lines and read back by its schema."""
    path = R.scratch_path(spark, "json-corpus")
    ws(spark, sf_dir).corpus.select(F.col("docno").cast("string").alias("docno"), "title", "abstract").write.json(path)
    return jsoncorpus.read_json_corpus(spark, path)[0]


def _pages(spark, sf_dir):
    w = ws(spark, sf_dir)
    corpus = w.memo("pages corpus", lambda: jsoncorpus.corpus_from_pages(w.table("pages")))
    index = lexical.store_index(textprep.prepare_joined(corpus), (*w.state("pages"), "page text"))
    topics = corpus.filter(F.col("docno") % KNOWN_ITEM == 0).select(F.col("docno").alias("qid"), F.lit("title").alias("variant"), first_tokens("title", 5).alias("query"))
    return index, topics


_BM25 = (PAGES, PPREP, PTOPICS, Q.bm25_ctes(depth=100, topics="ptopics", prepared="pprep"))


@register("l4_pages_bm25", W(*_BM25) + "SELECT variant, qid, docno, round(score, 6) AS score, rank FROM bm25")
def l4_pages_bm25(spark, sf_dir):
    """The second corpus searched for known pages by their titles."""
    index, topics = _pages(spark, sf_dir)
    return rounded(lexical.bm25(index, topics, 100))


@register("m1_pages_known_item", W(*_BM25, "pq AS (SELECT qid, qid AS docno, 1::BIGINT AS rel FROM ptopics)", Q.metric_ctes("bm25", ["variant"], ["RR@10", "R@10"], qrels="pq"))
          + "SELECT variant, metric, round(value, 6) AS value FROM ev")
def m1_pages_known_item(spark, sf_dir):
    index, topics = _pages(spark, sf_dir)
    rel = topics.select("qid", F.col("qid").alias("docno"), F.lit(1).alias("rel"))
    return rounded(ev.evaluate(lexical.bm25(index, topics, 100), rel, ["RR@10", "R@10"], keys=("variant",)))
