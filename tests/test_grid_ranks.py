"""Ranks of relevant documents under a grid: only documents that reach a floor are scored exactly."""

import numpy as np
import pyarrow as pa
import pytest

from rankloom.operators import lexical, ranks, tuning

GRID = ((0.3, 1.2, 2.0), (0.0, 0.4, 0.75, 1.0), (0.5, 8.0))


@pytest.fixture(scope="module")
def data(spark):
    """Copies, repeated and null docnos, terms of more than half of the documents, queries with repeated terms."""
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("w" + str(min(int(x), 40)) for x in rng.zipf(1.4, n))
    texts = [word(int(n)) for n in rng.integers(1, 40, 300)]
    docs = [*enumerate(texts), *((300 + i, texts[i % 5]) for i in range(60)), (7, "w1 w9"), (7, "w9 w9 w2"), (None, "w1 w2 w3"), (None, "w5")]
    topics = [(0, "w1"), (1, "w9 w12 w3"), (2, "w1 w2 w2 w5 w5 w5"), (3, texts[0]), (4, texts[3]), (5, "w17 w3 w1"), (6, "none")]
    rel = [(0, 3, 1), (0, 300, 2), (1, 7, 1), (1, 9, 1), (2, 40, 1), (2, 41, 0), (3, 0, 1), *((3, 300 + 5 * i, 1) for i in range(12)), (4, 303, 2), (4, 358, 1), (5, 250, 1), (5, 999, 1), (6, 1, 1)]
    index = lexical.build_index(spark.createDataFrame(docs, "docno long, text string"))
    return index, spark.createDataFrame(topics, "qid long, query string"), spark.createDataFrame(rel, "qid long, docno long, rel long")


def _rows(df):
    return {(r.qid, r.docno, r.k1, r.b, r.k3): r.rank for r in df.collect()}


def test_ranks_within_k_are_those_of_single_runs(data, monkeypatch):
    index, topics, rel = data
    whole = _rows(tuning.bm25_grid_ranks(index, topics, rel, *GRID, keys=("qid",)))
    pairs = {(r.qid, r.docno) for r in rel.filter("rel >= 1").collect()}
    for k1, b, k3 in ((0.3, 0.0, 0.5), (1.2, 0.75, 8.0), (2.0, 1.0, 8.0), (2.0, 0.4, 0.5)):
        run = {(r.qid, r.docno): r.rank for r in lexical.bm25(index, topics, None, lexical.BM25Params(k1, b, k3), keys=("qid",)).collect()}
        assert {k[:2]: n for k, n in whole.items() if k[2:] == (k1, b, k3)} == {k: n for k, n in run.items() if k in pairs}
    assert len({n for n in whole.values()}) > 10 and max(whole.values()) > 50
    for part in (64, 0.1):  # without floors of a part of the documents, and with those of few
        monkeypatch.setattr(tuning, "PART", part)
        for k in (1, 5, 20):
            assert _rows(tuning.bm25_grid_ranks(index, topics, rel, *GRID, keys=("qid",), k=k)) == {key: n for key, n in whole.items() if n <= k}


def _side(n_terms: int, queries: list[dict]):
    at, term, qtf = (np.array(x) for x in zip(*((i, t, c) for i, q in enumerate(queries) for t, c in sorted(q.items())), strict=True))
    df = np.linspace(5, 900, n_terms)  # some of more than half of the documents
    return lexical.QuerySide(np.arange(len(queries)) + 100, pa.array([f"t{i}" for i in range(n_terms)]), at, term.astype(np.int32), df[term], qtf.astype(float), 1000.0, 20.0)


@pytest.mark.parametrize("small", [False, True])
def test_pairs_that_reach_a_floor(monkeypatch, small):
    """All of them leave, with their hits, and few others; a task's cut keeps what is among its best k under a setting."""
    if small:
        monkeypatch.setattr(ranks, "PAIRS", 7)
        monkeypatch.setattr(ranks, "CELLS", 64)
        monkeypatch.setattr(ranks, "HELD", 50)
    rng = np.random.default_rng(2)
    n_terms, n_docs = 30, 200
    side = ranks.by_count(_side(n_terms, [{int(t): int(c) for t, c in zip(rng.choice(n_terms, 5, replace=False), rng.integers(1, 4, 5), strict=True)} for _ in range(9)] + [{29: 1}, {0: 1, 29: 2}]))
    docs = [(d, int(t), int(c), int(x)) for d in range(n_docs) for x in [rng.integers(5, 60)] for t, c in zip(rng.choice(n_terms, 8, replace=False), rng.integers(1, 6, 8), strict=True)]
    docs += [(199, 3, 2, 33), (199, 4, 1, 33)]  # another row of the last docno
    table = pa.table({"docno": [x[0] for x in docs], "_t": pa.array([x[1] for x in docs], pa.int32()), "tf": [x[2] for x in docs], "dl": [x[3] for x in docs]})
    values = tuple(np.array(x) for x in GRID)
    scores = np.full((n_docs, len(side.queries), *(len(x) for x in GRID)), -np.inf)
    for d, t, tf, dl in docs:
        for q, idf, qtf in zip(side.at[side.term == t], side.idf("rsj")[side.term == t], side.qtf[side.term == t], strict=True):
            k1, b, k3 = np.meshgrid(*values, indexing="ij")
            scores[d, q] = np.where(np.isneginf(scores[d, q]), 0, scores[d, q]) + idf * (k3 + 1) * qtf / (k3 + qtf) * (k1 + 1) * tf / (k1 * (1 - b + b * dl / 20.0) + tf)
    floor = np.sort(scores, axis=0)[-30]  # some are negative
    want = {(int(d), int(q)) for d, q in np.argwhere((scores >= floor - 2e-6).any(axis=(2, 3, 4)))}
    for k in (None, 10):
        grid = ranks.Grid(side, *values, 6, k)
        found = pa.concat_tables(ranks.reaching(table.to_batches(max_chunksize=11), grid, floor))
        got = [(d, q) for q, d in zip(found.column("q").to_pylist(), found.column("docno").to_pylist(), strict=True)]
        assert len(got) == len(set(got))
        if k is None:
            assert set(got) == want and len(want) < 0.6 * np.isfinite(scores[:, :, 0, 0, 0]).sum()
        best = np.argsort(np.lexsort((np.broadcast_to(-np.arange(n_docs)[:, None], (n_docs, scores[0].size)), -np.round(scores.reshape(n_docs, -1), 6)), axis=0), axis=0).reshape(scores.shape) < 10
        assert {(int(d), int(q)) for d, q in np.argwhere((best & np.isfinite(scores)).any(axis=(2, 3, 4)))} <= set(got)
        q0 = found.filter(pa.compute.equal(found.column("q"), 0))
        again = ranks.Group(q0, grid, side.idf("rsj"), True)
        for where, s in again.all_scores():
            for d, row in zip(q0.column("docno").to_pylist(), s, strict=True):
                assert np.abs(row - scores[d, 0][where].ravel()).max() < 1e-5
        if k is None:
            continue
        for d, least in ((10, ranks.kth_best(q0, grid, side.idf("rsj"), True)),):
            assert np.abs(least - np.sort(scores[:, 0], axis=0)[-d]).max() < 1e-5
    assert list(ranks.by_query(pa.table({"_q": [1, 1, 2, 2, 2, 3]}).to_batches(max_chunksize=2), "_q"))[1][1].num_rows == 3
