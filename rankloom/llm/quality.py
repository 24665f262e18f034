"""Quality by Bradley-Terry pairwise ranking.

Each document has a score s(x) = w . f(x) over shape features of its whole
text. Preference pairs (a document labelled 1 before one labelled 0) are drawn
from a bounded sample of labelled rows, and w minimises the logistic loss of
the feature differences. The cut is the quantile of the training scores at the
share of rejected documents; the reported score is a logistic of the distance
to the cut, with a slope fitted to the labels, and is 0.3 at the cut.

Defined cases: null and empty texts have the features of an empty text; without
both labels in the sample every document gets the share of label 1 (0.5 if
there is no label at all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import id_bucket, table
from rankloom.llm.labelled import training_sample
from rankloom.llm.wordhash import column_bytes, word_hashes

SAMPLE, PAIRS_EACH = 20_000, 8
THRESHOLD = 0.3

_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "pipe", "mark", "punct", "high")
_CLASS = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = _CLASSES.index(
        "high" if _i > 127 else "upper" if _c.isupper() else "lower" if _c.islower() else "digit" if _c.isdigit() else "newline" if _c == "\n"
        else "space" if _c.isspace() or _i < 32 else "stop" if _c in ".,;:?'\"()-" else "pipe" if _c in "|\\/<>[]{}=_" else "mark" if _c in "!#$%&*@^~+`" else "punct"
    )


def _text_features(counts: np.ndarray, words: np.ndarray, lines: list[str]) -> list[float]:
    n, n_words = max(1, int(counts.sum())), max(1, len(words))
    share = counts / n
    by = dict(zip(_CLASSES, share.tolist(), strict=True))
    letters = by["upper"] + by["lower"] + by["high"] + 1e-9
    distinct = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
    runs = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    lines = [x for x in lines if x.strip()]
    full = sum(1 for x in lines if x.rstrip()[-1:] in ".!?\"") / max(1, len(lines))
    pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
    base = [
        np.log1p(n), np.log1p(n_words), n / n_words / 10, by["upper"] / letters, by["digit"], by["pipe"], by["mark"], by["stop"], by["punct"], by["high"],
        len(distinct) / n_words, float(distinct.max()) / n_words, runs, len(np.unique(pairs)) / max(1, len(pairs)),
        1 - len(set(lines)) / max(1, len(lines)), full, np.log1p(len(lines)) / 5,
    ]
    some = [by["upper"] / letters, by["pipe"], by["mark"], runs, by["digit"], 1 - len(distinct) / n_words, 1 - len(np.unique(pairs)) / max(1, len(pairs))]
    cuts = [float(x > c) for x in some for c in (0.005, 0.02, 0.05, 0.15, 0.3, 0.5)]
    return [float(x) for x in base] + [float(np.sqrt(max(0.0, x))) for x in some] + cuts


def features(col: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    data, off = column_bytes(col)
    texts = col.to_pylist()
    out = []
    for row, stop, h, counts in word_hashes(col):
        ends = np.cumsum(counts)
        for i, a, b in zip(range(row, stop), ends - counts, ends, strict=True):
            hist = np.bincount(data[off[i] : off[i + 1]], minlength=256)
            out.append(_text_features(np.bincount(_CLASS, weights=hist, minlength=len(_CLASSES)), h[a:b], (texts[i] or "").split("\n")))
    return np.array(out).reshape(len(out), -1 if out else 0)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Weights, cut and slope from a sample; see the module's description."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    few, many, sign = (bad, good, -1.0) if len(bad) <= len(good) else (good, bad, 1.0)
    i = np.repeat(few, PAIRS_EACH)
    d = sign * (z[i] - z[rng.choice(many, len(i))])  # preferred minus other
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of the logistic loss with a small ridge
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).sum(axis=0) + 0.02 * len(d) * w / 10
        hess = (d * (p * (1 - p))[:, None]).T @ d + (0.02 * len(d) / 10) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, float((y == 0).mean())))
    a, b = 1.0, 0.0
    for _ in range(30):  # slope of the label's log odds in the score
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * s).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": max(0.05, float(a))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    far = ((x - model["mean"]) / model["scale"]) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * far + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _as_features(docs: DataFrame) -> DataFrame:
    def run(it):
        for b in it:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return docs.select("text", "y").mapInArrow(run, "y int, x array<double>")


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    got = _as_features(training_sample(documents, labels, "quality", modulus, held_out, sample)).toArrow()  # at most `sample` rows
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(len(y), -1 if len(y) else 0)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)
    model = documents.sparkSession.sparkContext.broadcast(fit(x[order], y[order]))

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": score(model.value, features(b.column("text")))})

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (id_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
