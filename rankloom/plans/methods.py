"""The experiment's methods as DataFrame -> DataFrame stages.

Every method starts from the same materialised first stage (BM25 top 100), so
BM25 runs once for all methods and all wordings; what the rerankers need of a
document is read from stored indexes, so no text travels with a candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, fusion, rerank, textprep
from .sizing import checked_broadcast
from .workspace import Workspace

QKEYS = ("variant", "qid")
# The methods, named by what they compute.
BM25 = "BM25"
LATE = "BM25 >> MaxSim of hashed tokens % 100"
FUSED = "BM25 >> cosine fusion % 100"
COVERED = "BM25 >> word coverage % 100"
DOTTED = "BM25 >> dot product % 100"
METHODS = (BM25, LATE, FUSED, COVERED, DOTTED)
# The published methods with the same place in the experiment
# (labels for comparisons with published numbers only), and the fusion weight.
PUBLISHED = {
    BM25: "BM25",
    LATE: "BM25 >> TCT-ColBERT % 100",
    FUSED: "BM25 >> MINILM % 100",
    COVERED: "BM25 >> MonoT5 % 100",
    DOTTED: "BM25 >> TasB % 100",
}
SBERT_ALPHA = 0.2
RUN_COLS = ["variant", "qid", "docno", "score", "rank"]


def candidates(ws: Workspace, k: int = 100) -> DataFrame:
    """BM25 % k, with ``query`` and P5 ``text`` attached (cached)."""
    def build():
        run = ws.bm25(k)
        with_q = run.join(checked_broadcast(ws.topics), ["variant", "qid"])
        return textprep.attach_text(with_q, ws.corpus)
    return ws.memo(("candidates", k), build)


def query_vectors(ws: Workspace) -> DataFrame:
    return ws.memo("qvecs", lambda: dense.hashed_vectors(ws.topics, QKEYS, "query"))


def cosine_scored(ws: Workspace, k: int = 100) -> DataFrame:
    """D3: the first stage with ``dense_score`` = cosine(query, P5 text), from the stored forward index."""
    return dense.score_stored(ws.bm25(k), query_vectors(ws), ws.forward, "cosine")


def dot_scored(ws: Workspace, k: int = 100) -> DataFrame:
    """The first stage with ``dense_score`` = dot(query, P5 text)."""
    return dense.score_stored(ws.bm25(k), query_vectors(ws), ws.forward, "dot")


def late_interaction_scored(ws: Workspace, k: int = 100) -> DataFrame:
    """The first stage with ``li_score`` = MaxSim over the stored token codes."""
    return dense.maxsim_codes(ws.bm25(k), dense.token_codes(ws.topics, QKEYS, "query"), ws.forward_terms)


def covered(ws: Workspace, run: DataFrame) -> DataFrame:
    """``run`` with ``pointwise``, from the stored words of the candidates' texts."""
    return rerank.coverage_of(run, ws.topics, ws.forward_terms)


_BUILD = {
    BM25: lambda ws, k: ws.bm25(k),
    LATE: lambda ws, k: dense.rerank_by(late_interaction_scored(ws, k), "li_score", QKEYS, k),
    FUSED: lambda ws, k: fusion.convex_fusion(cosine_scored(ws, k), "dense_score", SBERT_ALPHA, k=k),
    COVERED: lambda ws, k: rerank.pointwise(ws.bm25(k), keys=QKEYS, k=k, scorer=lambda d: covered(ws, d)),
    DOTTED: lambda ws, k: dense.rerank_by(dot_scored(ws, k), "dense_score", QKEYS, k),
}


def method_run(ws: Workspace, name: str, k: int = 100) -> DataFrame:
    """One method's run ``(variant, qid, docno, score, rank)``, cut at ``k``."""
    return _BUILD[name](ws, k)


def method_runs(ws: Workspace, k: int = 100) -> dict[str, DataFrame]:
    """M9: name -> run, for all methods."""
    ws.forward_at_once()
    return {name: method_run(ws, name, k) for name in METHODS}


def experiment_run(ws: Workspace, k: int = 100) -> DataFrame:
    """All methods in one run table ``(method, variant, qid, docno, score, rank)``.

    Checkpointed: it has at most methods x queries x k rows and is read by the
    evaluation more than once.
    """
    def build():
        runs = method_runs(ws, k)
        parts = [r.select(F.lit(name).alias("method"), *RUN_COLS) for name, r in runs.items()]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        return union
    return ws.memo(("experiment_run", k), build, settle=True)
