"""Stored vector indexes, cells, and feedback on token vectors.

Queries are every 25th document of ``tok_vectors``; the first stage is MaxSim,
its ten best are the candidates and the three best the feedback. A document has
four token vectors here, so a query's twelve are cut into six clusters, of which
the three with the highest IDF are added.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, dense, multivector
from . import methods as M
from . import sql as Q
from .catalog import register, rounded, ws
from .q_more import EXACT_KNN
from .q_vectors import K, OUT, VECTORS, _top

W = Q.with_
CLUSTERS, ADDED, ROUNDS = 6, 3, 3
PER_VECTOR = 40  # similar tokens of each query vector, whose documents are ranked
HOW = {"fb_docs": 3, "clusters": CLUSTERS, "fb_embs": ADDED, "rounds": ROUNDS}

_ABS = "list_transform(vec, lambda x: abs(x))"
TERMS = f"""tt AS (
  SELECT docno, pos, vec, (list_position({_ABS}, list_max({_ABS})) - 1)::VARCHAR
         || CASE WHEN vec[list_position({_ABS}, list_max({_ABS}))] < 0 THEN '-' ELSE '+' END AS term FROM tok)"""
FIRST = """best AS (
  SELECT q.docno AS qid, q.pos, d.docno, max(list_dot_product(q.vec, d.vec)) AS m
  FROM tok q CROSS JOIN tok d WHERE q.docno % 25 = 0 GROUP BY q.docno, q.pos, d.docno),
sims AS (SELECT qid, docno, sum(m) AS s FROM best GROUP BY qid, docno)"""


def _gap(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(range(1, len({a}) + 1), lambda j: ({a}[j] - {b}[j]) * ({a}[j] - {b}[j]))), 9)"


def _round(i: int) -> str:
    return f"""own{i} AS MATERIALIZED (
  SELECT v.qid, v.i, v.vec, arg_min(c.c, ({_gap('v.vec', 'c.vec')}, c.c)) AS c FROM fbv v JOIN c{i} c USING (qid) GROUP BY v.qid, v.i, v.vec),
mean{i} AS (
  SELECT qid, c, list(x ORDER BY j) AS vec FROM (
    SELECT qid, c, j, avg(x) AS x FROM (SELECT qid, c, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM own{i}) u GROUP BY qid, c, j) y GROUP BY qid, c),
c{i + 1} AS MATERIALIZED (SELECT qid, c.c, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN mean{i} m USING (qid, c))"""


EXPANDED = f"""fbv AS MATERIALIZED (
  SELECT r.qid, t.vec, t.term, row_number() OVER (PARTITION BY r.qid ORDER BY t.docno, t.pos) - 1 AS i, count(*) OVER (PARTITION BY r.qid) AS n
  FROM r JOIN tt t ON t.docno = r.docno WHERE r.rank <= 3),
c0 AS MATERIALIZED (SELECT v.qid, g.c, v.vec FROM fbv v JOIN range({CLUSTERS}) g(c) ON g.c < v.n AND v.i = g.c * v.n // least({CLUSTERS}, v.n)),
{",".join(_round(i) for i in range(ROUNDS))},
stats AS (SELECT term, ln(((SELECT count(DISTINCT docno) FROM tt) + 1)::DOUBLE / (count(DISTINCT docno) + 1)) AS idf FROM tt GROUP BY term),
named AS (SELECT c.qid, c.c, c.vec, arg_min(v.term, ({_gap('c.vec', 'v.vec')}, v.i)) AS term FROM c{ROUNDS} c JOIN fbv v USING (qid) GROUP BY c.qid, c.c, c.vec),
added AS (
  SELECT * FROM (SELECT n.qid, n.c, n.vec, s.idf, row_number() OVER (PARTITION BY n.qid ORDER BY round(s.idf, 9) DESC, n.c) AS p FROM named n JOIN stats s USING (term)) x
  WHERE p <= {ADDED}),
eq AS MATERIALIZED (
  SELECT docno AS qid, pos, vec, 1.0::DOUBLE AS w FROM tok WHERE docno % 25 = 0
  UNION ALL SELECT qid, 1000 + p, vec, idf FROM added)"""


def _scored(docs: str) -> str:
    return f"""xbest AS (
  SELECT q.qid, q.pos, d.docno, max(q.w * list_dot_product(q.vec, d.vec)) AS m FROM eq q JOIN {docs} GROUP BY q.qid, q.pos, d.docno),
xsims AS (SELECT qid, docno, sum(m) AS s FROM xbest GROUP BY qid, docno)"""


def _first(spark, sf_dir):
    index = ws(spark, sf_dir).token_index
    queries = multivector.query_vectors(index.filter(F.col("docno") % 25 == 0))
    run = ws(spark, sf_dir).memo(("token run", K), lambda: multivector.search(queries, index, K))
    return queries, run, index


@register("d7_vector_index", W(VECTORS, TERMS) + "SELECT docno, pos, term, round(sqrt(list_dot_product(vec, vec)), 6) AS norm, round(vec[1], 6) AS head FROM tt")
def d7_vector_index(spark, sf_dir):
    """The stored rows, one per document, taken apart."""
    t = ws(spark, sf_dir).token_index.select("docno", F.explode("tokens").alias("t"))
    norm = F.sqrt(F.aggregate("t.vec", F.lit(0.0), lambda a, x: a + x * x))
    return rounded(t.select("docno", "t.pos", "t.term", norm.alias("norm"), F.col("t.vec")[0].alias("head")))


@register("d9_vector_feedback", W(VECTORS, TERMS, FIRST, _top("r", "sims"), EXPANDED, _scored("tok d ON true"), _top("x", "xsims")) + OUT.replace("FROM r", "FROM x"))
def d9_vector_feedback(spark, sf_dir):
    """Retrieval with the centroids of the best documents' token vectors added to the query."""
    queries, run, index = _first(spark, sf_dir)
    return rounded(multivector.feedback_ranker(queries, run, index, K, **HOW).select("qid", "docno", "score", "rank"))


@register("d10_vector_feedback", W(VECTORS, TERMS, FIRST, _top("r", "sims"), EXPANDED, _scored("r USING (qid) JOIN tok d ON d.docno = r.docno"), _top("x", "xsims")) + OUT.replace("FROM r", "FROM x"))
def d10_vector_feedback(spark, sf_dir):
    """The same expansion on the candidates alone."""
    queries, run, index = _first(spark, sf_dir)
    return rounded(multivector.feedback_reranker(queries, run, index, **HOW).select("qid", "docno", "score", "rank"))


@register("d6_vectors_rerank", W(VECTORS, FIRST, """dots AS (
  SELECT q.docno AS qid, d.docno, max(list_dot_product(q.vec, d.vec)) AS s
  FROM tok q CROSS JOIN tok d WHERE q.docno % 25 = 0 AND q.pos = 0 GROUP BY q.docno, d.docno)""", _top("p", "dots", 20),
                                "psims AS (SELECT s.qid, s.docno, s.s FROM sims s JOIN p USING (qid, docno))", _top("r", "psims")) + OUT)
def d6_vectors_rerank(spark, sf_dir):
    """MaxSim of the 20 candidates that the query's first vector finds, looked up in the stored index."""
    queries, _, index = _first(spark, sf_dir)
    one = queries.select("qid", F.slice("vecs", 1, 1).alias("vecs"), F.slice("weights", 1, 1).alias("weights"))
    cands = multivector.search(one, index, 20)
    return rounded(multivector.rerank(cands, queries, index, k=K).select("qid", "docno", "score", "rank"))


@register("s9_forward_tables", W(*Q.BASE[:2], f"""p5 AS (SELECT docno, coalesce(nullif(abstract, ''), nullif(title, ''), '') AS text FROM corpus),
lines AS (SELECT doc_id AS docno, unnest(string_split(text, chr(10))) AS line FROM documents)""") + f"""
SELECT 'vectors' AS name, (SELECT count(*) FROM p5)::BIGINT AS n
UNION ALL SELECT 'passages', (SELECT count(*) FROM lines WHERE trim(line, {Q.WS}) <> '')::BIGINT
UNION ALL SELECT 'words', (SELECT coalesce(sum(len(list_distinct({Q.tok('text')}))), 0) FROM p5)::BIGINT""")
def s9_forward_tables(spark, sf_dir):
    """Builds the forward indexes where they are missing; the sizes of their tables."""
    w = ws(spark, sf_dir)
    size = lambda df, n, name: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    return (size(w.forward, F.count(F.lit(1)), "vectors").unionByName(size(w.forward_passages, F.count(F.lit(1)), "passages"))
            .unionByName(size(w.forward_terms, F.sum(F.size("words")), "words")))


# ---- D8: cells -----------------------------------------------------------------------

FIRST_CELLS = 4  # cells of the exact search's first round


def _cells(w):
    v = w.memo("dvecs", lambda: dense.hashed_vectors(w.prepared, ["docno"]))
    return w.memo_value("cells", lambda: cells.build(v))


@register("d8_bounded_knn_top10", EXACT_KNN)
def d8_bounded_knn_top10(spark, sf_dir):
    """The exact result from cells: near ones first, then those whose bound reaches the tenth similarity."""
    w = ws(spark, sf_dir)
    return rounded(cells.search(_cells(w), M.query_vectors(w), K, FIRST_CELLS, exact=True))


@register("d8_cells_visited")
def d8_cells_visited(spark, sf_dir):
    """The share of cells that the bounds leave to each query."""
    w = ws(spark, sf_dir)
    q = M.query_vectors(w)
    run = w.memo("bounded", lambda: cells.search(_cells(w), q, K, FIRST_CELLS, exact=True), settle=True)
    return rounded(cells.visited(_cells(w), q, run, K, FIRST_CELLS))


@register("d8_token_cells_top10")
def d8_token_cells_top10(spark, sf_dir):
    """Token cells propose documents, exact MaxSim ranks them (its recall is tested)."""
    queries, _, index = _first(spark, sf_dir)
    w = ws(spark, sf_dir)
    found = w.memo_value("token cells", lambda: cells.build(multivector.token_vectors(index)))
    cands = multivector.propose(queries, found, PER_VECTOR)
    return rounded(multivector.rerank(cands, queries, index, k=K).select("qid", "docno", "score", "rank"))
