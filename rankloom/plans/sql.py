"""DuckDB SQL for the oracle side of every registered query.

These strings restate, in plain SQL over the driver's tables, what the
Spark operators compute. They are text builders only: nothing here runs
queries. Conventions shared with the Spark side: tokens split on
non-letters/digits after lower-casing; ranks by ``round(score, 6) DESC,
docno DESC``; doubles reported rounded to 6 digits.
"""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(13)"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


CORPUS = f"""corpus AS (
  SELECT doc_id AS docno,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract,
         lang, source
  FROM documents)"""

PREPARED = f"""prepared AS (
  SELECT docno, trim(concat_ws(' ', nullif(title, ''), nullif(abstract, '')), {WS}) AS text
  FROM corpus)"""

TOPICS = f"""topics AS (
  SELECT item_id AS qid, 'title' AS variant, array_to_string({tok('text')}[1:5], ' ') AS query FROM benchmark
  UNION ALL
  SELECT item_id AS qid, 'description' AS variant, trim(split_part(text, '.', 1), {WS}) AS query FROM benchmark
  UNION ALL
  SELECT item_id AS qid, 'narrative' AS variant, text AS query FROM benchmark)"""

QRELS = """qrels AS MATERIALIZED (
  SELECT b.item_id AS qid, d.doc_id AS docno,
         (CASE WHEN l.quality = 0 THEN 1 ELSE 2 END)::BIGINT AS rel
  FROM benchmark b
  JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def bm25_ctes(k1: float = 1.2, b: float = 0.75, k3: float = 8.0, depth: int | None = 100,
              idf: str = "rsj", topics: str = "topics", name: str = "bm25",
              prepared: str = "prepared") -> str:
    """CTEs ending in ``{name}(variant, qid, docno, score, rank)``."""
    if idf == "rsj":
        idf_e = "log2((c.n_docs - f.df + 0.5) / (f.df + 0.5))"
    else:
        idf_e = "ln(1 + (c.n_docs - f.df + 0.5) / (f.df + 0.5))"
    cut = f"WHERE rank <= {depth}" if depth is not None else ""
    d = lambda v: f"{float(v)!r}::DOUBLE"
    return f"""{name}_docs AS MATERIALIZED (SELECT docno, {tok('text')} AS toks FROM {prepared}),
{name}_dstat AS (SELECT docno, len(toks)::BIGINT AS dl FROM {name}_docs),
{name}_coll AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl)::DOUBLE AS avgdl FROM {name}_dstat),
{name}_qt AS MATERIALIZED (
  SELECT variant, qid, term, count(*)::BIGINT AS qtf
  FROM (SELECT variant, qid, unnest({tok('query')}) AS term FROM {topics}) x
  GROUP BY variant, qid, term),
{name}_post AS MATERIALIZED (
  SELECT docno, term, count(*)::BIGINT AS tf
  FROM (SELECT docno, unnest(toks) AS term FROM {name}_docs) x
  WHERE term IN (SELECT term FROM {name}_qt)
  GROUP BY docno, term),
{name}_dfs AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_post GROUP BY term),
{name}_scores AS (
  SELECT q.variant, q.qid, p.docno,
         sum({idf_e} * (({d(k3)} + 1) * q.qtf / ({d(k3)} + q.qtf))
             * (({d(k1)} + 1) * p.tf / ({d(k1)} * ((1 - {d(b)}) + {d(b)} * s.dl / c.avgdl) + p.tf))) AS score
  FROM {name}_qt q
  JOIN {name}_post p ON p.term = q.term
  JOIN {name}_dfs f ON f.term = q.term
  JOIN {name}_dstat s ON s.docno = p.docno
  CROSS JOIN {name}_coll c
  GROUP BY q.variant, q.qid, p.docno),
{name}_ranked AS (
  SELECT variant, qid, docno, score,
         row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 6) DESC, docno DESC)::BIGINT AS rank
  FROM {name}_scores),
{name} AS MATERIALIZED (SELECT variant, qid, docno, score, rank FROM {name}_ranked {cut})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (CORPUS, PREPARED, TOPICS)


def metric_ctes(run: str, keys: list[str], measures: list[str], name: str = "ev",
                qrels: str = "qrels") -> str:
    """CTEs ending in ``{name}(*keys, metric, value)`` -- means over judged queries.

    ``run`` has ``(*keys, qid, docno, rank)``; ``qrels`` must be defined.
    """
    from ..operators.evaluate import parse_measure

    ms = [parse_measure(m) for m in measures]
    kl = ", ".join(keys)
    kc = (kl + ", ") if keys else ""
    rk = ", ".join(f"r.{k}" for k in keys)
    rkc = (rk + ", ") if keys else ""
    part = f"PARTITION BY {kc}qid"
    sums, ideals, vals = [], [], []
    for i, m in enumerate(ms):
        w = "TRUE" if m.k is None else f"rank <= {m.k}"
        pw = "TRUE" if m.k is None else f"pos <= {m.k}"
        if m.kind == "RR":
            sums.append(f"max(CASE WHEN isrel > 0 AND {w} THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END) AS s{i}")
            vals.append(f"CASE WHEN R > 0 THEN s{i} ELSE 0.0::DOUBLE END")
        elif m.kind in ("P", "R"):
            sums.append(f"sum(CASE WHEN isrel > 0 AND {w} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s{i}")
            if m.kind == "P":
                vals.append(f"CASE WHEN R > 0 THEN s{i} / {float(m.k)!r}::DOUBLE ELSE 0.0::DOUBLE END")
            else:
                vals.append(f"CASE WHEN R > 0 THEN s{i} / R ELSE 0.0::DOUBLE END")
        elif m.kind == "AP":
            sums.append(f"sum(CASE WHEN isrel > 0 AND {w} THEN cumrel / rank ELSE 0.0::DOUBLE END) AS s{i}")
            vals.append(f"CASE WHEN R > 0 THEN s{i} / R ELSE 0.0::DOUBLE END")
        else:
            sums.append(f"sum(CASE WHEN {w} AND rel > 0 THEN rel / log2(rank + 1) ELSE 0.0::DOUBLE END) AS s{i}")
            ideals.append(f"sum(CASE WHEN {pw} AND rel > 0 THEN rel / log2(pos + 1) ELSE 0.0::DOUBLE END) AS i{i}")
            vals.append(f"CASE WHEN i{i} > 0 THEN s{i} / i{i} ELSE 0.0::DOUBLE END")
    ideal_cols = (",\n         " + ",\n         ".join(ideals)) if ideals else ""
    per_q = ",\n         ".join(f"({v})::DOUBLE AS m{i}" for i, v in enumerate(vals))
    group = f" GROUP BY {kl}" if keys else ""
    # Every run key with every judged query; what the run lacks counts 0.
    grid = f"(SELECT * FROM (SELECT DISTINCT {kl} FROM {run}) k CROSS JOIN {name}_ideal) g" if keys else f"{name}_ideal"
    filled = ", ".join(f"coalesce(s{i}, 0.0::DOUBLE) AS s{i}" for i in range(len(ms)))
    ideal_names = "".join(f", i{i}" for i, m in enumerate(ms) if m.kind == "nDCG")
    means = "\n    UNION ALL\n    ".join(
        f"SELECT {kc}'{m.name}' AS metric, sum(m{i}) / (SELECT n FROM {name}_nq) AS value FROM {name}_pq{group}"
        for i, m in enumerate(ms))
    return f"""{name}_judged AS (
  SELECT {rkc}r.qid, r.docno, r.rank, coalesce(q.rel, 0)::DOUBLE AS rel,
         CASE WHEN coalesce(q.rel, 0) >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS isrel
  FROM {run} r LEFT JOIN {qrels} q ON q.qid = r.qid AND q.docno = r.docno),
{name}_cum AS (
  SELECT *, sum(isrel) OVER ({part} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumrel
  FROM {name}_judged),
{name}_sums AS (
  SELECT {kc}qid,
         {(','+chr(10)+'         ').join(sums)}
  FROM {name}_cum GROUP BY {kc}qid),
{name}_ideal AS (
  SELECT qid, sum(CASE WHEN rel >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS R{ideal_cols}
  FROM (SELECT qid, docno, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docno DESC) AS pos FROM {qrels}) x
  GROUP BY qid),
{name}_pq AS (
  SELECT {kc}qid,
         {per_q}
  FROM (SELECT {kc}qid, R{ideal_names}, {filled}
        FROM {grid} LEFT JOIN {name}_sums USING ({kc}qid)) y),
{name}_nq AS (SELECT count(DISTINCT qid)::DOUBLE AS n FROM {qrels}),
{name} AS (
    {means})"""
