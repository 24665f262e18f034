"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows is the example set. The terms are all words of
the examples, and the word beginnings that toxic examples have more often; words
that no example has count as one further term. Texts become TF-IDF vectors of
unit length, in which a term weighs more the more its share among the toxic
examples exceeds its share among the others, and never nothing.

The examples lie in blocks. Terms of many examples are rows of weights, summed
for all examples at once; the others are in an inverted index with the highest
weight of each term in each block. A query adds those maxima to each block's
best sum of frequent terms, which bounds the block, reads the postings of the
most promising blocks, and goes on only to blocks whose bound reaches the k-th
best similarity; what comes near the k-th is computed again in double precision,
so its k neighbours are exact. Their labels vote with weights that
fall with distance; the vote's log odds are calibrated on the examples, each
one left out of its own vote. The neighbours are the evidence. The model is
fitted in one task (its sample is bounded) and passes through the driver as
bytes.

Defined cases: null and empty texts and texts without any word of an example
have no neighbour and get the share of toxic ones among such examples, or among
all if there are none; without labelled rows every score is 0; ties go to the
example with the smaller id.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import give_back, id_bucket, table
from rankloom.llm.labelled import training_sample

SAMPLE, NEIGHBOURS, BLOCK = 8_000, 15, 4
FREQUENT = 16  # terms of at least one in so many examples are kept as rows of weights
KNOWN, TOGETHER = 50_000, 32  # words whose terms a worker keeps, texts multiplied at a time
SLACK = 1e-4  # more than the error of a sum in single precision
FLOOR, TELLS = 0.05, 2.5  # the weight of a term that does not tell, and the z-score from which one does
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def excess(yes: np.ndarray, no: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The z-score of each term's share among ``n1`` toxic examples over that among ``n0`` others."""
    p = (yes + no + 1) / (n1 + n0 + 2)
    return (yes / n1 - no / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def telling_beginnings(texts: list[str], y: np.ndarray) -> list[str]:
    """The word beginnings that toxic examples have more often, by z-score; whole words are terms anyway."""
    n1, n0 = max(1, int(y.sum())), max(1, int((y == 0).sum()))
    yes: Counter = Counter()
    for t in (t for t, label in zip(texts, y.tolist(), strict=True) if label):
        yes.update({x for w in term_counts(t) for x in _terms(w)[1:]})
    yes = Counter({t: k for t, k in yes.items() if k >= 3})
    no: Counter = Counter()
    for t in (t for t, label in zip(texts, y.tolist(), strict=True) if not label):
        no.update({x for w in term_counts(t) for x in _terms(w)[1:] if x in yes})
    names = sorted(yes)
    k1, k0 = np.array([yes[t] for t in names], float), np.array([no[t] for t in names], float)
    keep = (k1 * n0 > 4 * k0 * n1) & (excess(k1, k0, n1, n0) > 2.5)
    return [t for t, ok in zip(names, keep, strict=True) if ok]


class Vectors:
    """Texts as sparse unit TF-IDF vectors; the last term stands for the words of no example."""

    def __init__(self, terms: list[str], idf: np.ndarray, tells: np.ndarray):
        self.idf, self.tells = idf, tells
        self._name(terms)

    def _name(self, terms: list[str]) -> None:
        self.terms = dict(zip(terms, range(len(terms)), strict=True))
        # The beginnings by their first letters, so that a word meets only those near it.
        self.beginnings: dict[str, list[tuple[str, int]]] = {}
        for i, t in enumerate(terms):
            if t.endswith("*"):
                self.beginnings.setdefault(t[: PREFIXES[0]], []).append((t[:-1], i))
        self.known: dict[str, tuple] = {}  # the terms of words met lately

    def __getstate__(self) -> tuple:
        """The terms as one string (they are letters and ``*``), so that a worker makes no list of a pickle's many strings."""
        return "\n".join(self.terms), self.idf, self.tells

    def __setstate__(self, state: tuple) -> None:
        names, self.idf, self.tells = state
        self._name(names.split("\n") if names else [])

    def counts(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, ascending, and how often it has them."""
        tf: dict[int, int] = {}
        known, terms, beginnings, first, rest = self.known, self.terms, self.beginnings, PREFIXES[0], 0
        if len(known) > KNOWN:
            known.clear()
        for w, n in words.items():
            own = known.get(w)
            if own is None:
                i, near = terms.get(w, -1), beginnings.get(w[:first], ())
                more = [j for b, j in near if w.startswith(b) and w != b]
                if i < 0 and not more:  # most new words: nothing to keep
                    rest += n
                    continue
                # A word's own term (or -1), the beginnings it has, and whether it counts as one of the rest.
                own = known[w] = i, more, not more and not self.tells[i]
            i, more, plain = own
            if i >= 0:
                tf[i] = n
            if plain:
                rest += n
            for j in more:
                tf[j] = tf.get(j, 0) + n
        if rest:
            tf[len(self.terms)] = rest
        at = np.fromiter(tf, np.int32, len(tf))
        n = np.fromiter(tf.values(), np.int32, len(tf))
        by = np.argsort(at)
        return at[by], n[by]

    def weigh(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[at] if len(at) else np.zeros(0)
        return at, w / max(1e-12, np.sqrt((w * w).sum()))

    def __call__(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*self.counts(words))


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one after the other, and the size of each range."""
    size = (stop - start).astype(np.int64)
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size), size


class Index:
    """Examples in blocks; dense weights of frequent terms, postings with block maxima of the others."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], weigh, y: np.ndarray, n_terms: int):
        # Examples with the same leading terms lie together, so block maxima are tight.
        lead = [tuple(at[np.argsort(-w, kind="stable")][:3].tolist()) for at, w in (weigh(*c) for c in counts)]
        self.order = np.array(sorted(range(len(counts)), key=lambda i: (lead[i], i)), dtype=np.int64)
        self.y = y[self.order]
        self.n, self.blocks = len(y), -(-len(y) // BLOCK)
        self.terms = n_terms
        self.own = np.cumsum([0] + [len(counts[i][0]) for i in self.order]).astype(np.int32)
        self.own_term, self.own_w = np.zeros(self.own[-1], np.int32), np.zeros(self.own[-1], np.float32)
        for at, i in enumerate(self.order):
            own = slice(self.own[at], self.own[at + 1])
            self.own_term[own], self.own_w[own] = weigh(*counts[i])
        self._derive()

    @property
    def doc(self) -> np.ndarray:
        """The example of each of ``own_term`` and ``own_w``."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.own))

    def _derive(self) -> None:
        """What follows from the examples' vectors: rows of frequent terms, postings and (term, block) pairs of the others."""
        df = np.bincount(self.own_term, minlength=self.terms)
        often = np.flatnonzero(df >= max(BLOCK, self.n // FREQUENT))
        self.row = np.full(len(df), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        doc, row = self.doc, self.row[self.own_term]
        self.dense[row[row >= 0], doc[row >= 0]] = self.own_w[row >= 0]
        rare = np.flatnonzero(row < 0).astype(np.int32)
        rare = rare[np.argsort(self.own_term[rare], kind="stable")]  # by term, then example
        term, self.rare_doc, self.rare_w = self.own_term[rare], doc[rare], self.own_w[rare]
        del rare, doc, row
        # Each (rare term, block) that has postings: its block, where they start, and their highest weight.
        block = self.rare_doc // BLOCK
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
        self.top = np.maximum.reduceat(self.rare_w, first) if len(first) else np.zeros(0, np.float32)
        self.block, self.first = block[first], np.append(first, len(term)).astype(np.int32)
        self.pairs = np.searchsorted(term[first], np.arange(self.terms + 1)).astype(np.int32)
        self.scratch = np.zeros(self.terms)

    def __getstate__(self) -> dict:
        """The vectors alone, so that a broadcast is small."""
        return {k: vars(self)[k] for k in ("order", "y", "n", "blocks", "terms", "own_term", "own_w", "own")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._derive()

    def _block_sims(self, part: np.ndarray, pairs: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples of ``blocks`` and their similarities: the frequent terms' part and the postings of ``pairs``, which lie in those blocks."""
        docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        docs = docs[docs < self.n]
        post, size = _ranges(self.first[pairs], self.first[pairs + 1])
        return docs, part[docs] + np.bincount(self.rare_doc[post], weights=np.repeat(w, size) * self.rare_w[post], minlength=self.n)[docs]

    def _exact(self, at: np.ndarray, w: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Similarities in double precision, from the examples' own vectors."""
        q = self.scratch
        q[at] = w
        post, size = _ranges(self.own[docs], self.own[docs + 1])
        out = np.bincount(np.repeat(np.arange(len(docs)), size), weights=q[self.own_term[post]] * self.own_w[post], minlength=len(docs))
        q[at] = 0.0
        return out

    def parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The frequent terms' share of the similarities of some texts with all examples, in one product."""
        q = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (at, w) in enumerate(vectors):
            rows = self.row[at]
            q[i, rows[rows >= 0]] = w[rows >= 0]
        return q @ self.dense

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1, seen: list | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, examples) of the k most similar ones, best first, ties by example.

        ``seen`` gets the number of blocks whose postings were read; ``part``
        is the text's row of :meth:`parts`.
        """
        part = self.parts([(at, w)])[0] if part is None else part
        rare = self.row[at] < 0
        pairs, size = _ranges(self.pairs[at[rare]], self.pairs[at[rare] + 1])
        by_pair, home = np.repeat(w[rare], size), self.block[pairs]
        best = np.zeros(self.blocks, part.dtype)
        for i in range(BLOCK):  # a few long rows are quicker than many short ones
            np.maximum(best, part[i::BLOCK], out=best)
        bound = best + np.bincount(home, weights=by_pair * self.top[pairs], minlength=self.blocks)
        # The most promising blocks, then all others whose bound reaches the k-th best so far.
        todo, docs, sims = np.ones(self.blocks, bool), np.zeros(0, np.int64), np.zeros(0)
        take = min(self.blocks, max(2, 4 * k // BLOCK + 1))
        blocks = np.argpartition(-bound, take - 1)[:take] if take else np.zeros(0, np.int64)
        done = 0
        while len(blocks):
            now = np.zeros(self.blocks, bool)
            now[blocks] = True
            todo &= ~now
            own = now[home]
            d, s = self._block_sims(part, pairs[own], by_pair[own], blocks)
            keep = d != without
            docs, sims, done = np.concatenate([docs, d[keep]]), np.concatenate([sims, s[keep]]), done + len(blocks)
            kth = np.partition(sims, -k)[-k] if len(sims) >= k else -1.0
            blocks = np.flatnonzero(todo & (bound >= kth - SLACK))
        if seen is not None:
            seen.append(done)
        if len(sims) > k:  # single precision picks out, double precision decides
            docs = docs[sims >= np.partition(sims, -k)[-k] - SLACK]
        sims = self._exact(at, w, docs)
        first = np.lexsort((docs, -np.round(sims, 9)))[:k]
        return sims[first], docs[first]


def _vote(sims: np.ndarray, y: np.ndarray) -> float:
    """Share of toxic neighbours, each weighted by the inverse of its distance; one without a common term is none."""
    sims, y = sims[sims > 0], y[sims > 0]
    if not len(sims):
        return 0.0
    weight = 1 / (0.05 + np.sqrt(np.maximum(0.0, 2 - 2 * sims)))
    return float((weight * y).sum() / weight.sum())


def weight_of(z: np.ndarray) -> np.ndarray:
    """What a term weighs beside its IDF: ``FLOOR`` or more, growing with its z-score to 1 more."""
    return FLOOR + np.clip(z - TELLS, 0, 1)


class Model:
    def __init__(self, texts: list[str], y: np.ndarray):
        self.empty = len(y) == 0
        words: dict[str, int] = {}
        for t in texts:
            for w in term_counts(t):
                words.setdefault(w, len(words))
        terms = [*words, *telling_beginnings(texts, y)]
        n_terms = len(terms) + 1
        yes, no = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.vectors = Vectors(terms, np.ones(n_terms), np.ones(n_terms, bool))
        del words, terms
        for t, toxic in zip(texts, y.tolist(), strict=True):
            at, _ = self.vectors.counts(term_counts(t))
            (yes if toxic else no)[at] += 1
        z = excess(yes, no, max(1, int(y.sum())), max(1, int((y == 0).sum())))
        self.vectors.tells, self.vectors.known = z > TELLS, {}
        counts = [self.vectors.counts(term_counts(t)) for t in texts]
        rest = sum(len(at) > 0 and at[-1] == n_terms - 1 for at, _ in counts)
        df = np.append((yes + no)[:-1], rest)
        self.vectors.idf = np.log(1 + len(y) / (1 + df)) * np.append(weight_of(z)[:-1], 1.0)
        # The weights in double precision are made again where they are needed: all at once they are the most memory of the fit.
        self.index = Index(counts, self.vectors.weigh, y, n_terms)
        plain = np.array([not len(at) for at, _ in counts], dtype=bool)
        self.plain = float(y[plain].mean()) if plain.any() else float(y.mean()) if len(y) else 0.0
        self.a, self.b = 1.0, 0.0
        learn = [i for i in range(len(counts)) if not plain[self.index.order[i]]]
        votes = np.zeros(len(learn))
        for lo in range(0, len(learn), TOGETHER):
            some = learn[lo : lo + TOGETHER]
            found = self._nearest([self.vectors.weigh(*counts[self.index.order[i]]) for i in some], some)
            votes[lo : lo + len(some)] = [_vote(sims, self.index.y[docs]) for sims, docs in found]
        own = self.index.y[~plain[self.index.order]] if len(y) else y
        if len(own) and own.min() != own.max():
            s = self._odds(votes)
            a, b = 1.0, 0.0
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
                v = p * (1 - p) + 1e-9
                g = np.array([((p - own) * s).sum() + 1e-2 * a, (p - own).sum()])
                h = np.array([[(v * s * s).sum() + 1e-2, (v * s).sum()], [(v * s).sum(), v.sum()]])
                a, b = np.array([a, b]) - np.linalg.solve(h, g)
            self.a, self.b = max(0.05, float(a)), float(b)

    def _nearest(self, vectors: list, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The neighbours of each vector, a few texts multiplied at a time."""
        out = []
        for lo in range(0, len(vectors), TOGETHER):
            some = vectors[lo : lo + TOGETHER]
            for i, ((at, w), part) in enumerate(zip(some, self.index.parts(some), strict=True), lo):
                out.append(self.index.nearest(at, w, NEIGHBOURS, without[i] if without else -1, part=part))
        return out

    @property
    def terms(self) -> list[str]:
        return list(self.vectors.terms)

    @staticmethod
    def _odds(vote):
        return np.log((vote + 0.02) / (1.02 - vote))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The calibrated score of a text and its (example, similarity) evidence."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """The calibrated score and the evidence of every text."""
        if self.empty:
            return [(0.0, [])] * len(texts)
        vectors = [self.vectors(term_counts(t)) for t in texts]
        # A text without words, or without one that an example has, has no neighbour.
        some = [i for i, (at, _) in enumerate(vectors) if len(at) and at[0] != len(self.vectors.terms)]
        out: list = [(self.plain, [])] * len(texts)
        for i, (sims, docs) in zip(some, self._nearest([vectors[i] for i in some]), strict=True):
            s = self.a * self._odds(_vote(sims, self.index.y[docs])) + self.b
            out[i] = float(1 / (1 + np.exp(-np.clip(s, -30, 30)))), [(int(self.index.order[d]), float(x)) for d, x in zip(docs, sims, strict=True)]
        return out


class Packed:
    """A pickled (model, ids) that unpickles, in a worker, as what it holds; the driver only passes the bytes on."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)

    def open(self) -> tuple[Model, list]:
        return pickle.loads(self.data)


def fit(documents: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Packed:
    """The model of a bounded sample (at most ``sample`` rows, so one task) and the doc_ids of its examples."""

    def run(it):
        rows = sorted((r for b in it for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)), key=lambda r: r[0])
        model = Model([t for _, t, _ in rows], np.array([y for _, _, y in rows], dtype=np.int64))
        packed = pa.array([pickle.dumps((model, [d for d, _, _ in rows]))], pa.binary())
        del rows, model
        give_back()
        yield pa.RecordBatch.from_pydict({"model": packed})

    rows = training_sample(documents, labels, "toxic", modulus, held_out, sample).coalesce(1).mapInArrow(run, "model binary").collect()  # one row, or none without examples
    return Packed(rows[0]["model"] if rows else pickle.dumps((Model([], np.zeros(0, np.int64)), [])))


def scores(documents: DataFrame, packed: Packed) -> DataFrame:
    """``documents``' doc_id with score and evidence, the nearest examples' (doc_id, similarity)."""
    held = documents.sparkSession.sparkContext.broadcast(packed)

    def run(it):
        model, ids = held.value
        give_back()
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))
        for b in it:
            texts = b.column("text")
            found = [x for lo in range(0, b.num_rows, TOGETHER) for x in model.scores(texts[lo : lo + TOGETHER].to_pylist())]
            evidence = [[{"doc_id": ids[e], "similarity": s} for e, s in ev[:3]] for _, ev in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:bigint,similarity:double>>")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``documents``."""
    out = scores(documents, fit(documents, labels))
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that are not predicted toxic."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(it):
        model, _ = held.value
        give_back()
        for b in it:
            for lo in range(0, b.num_rows, TOGETHER):  # small pieces out, as the batch and the model fill the worker
                some = b.slice(lo, TOGETHER)
                yield some.filter(pa.array([s < THRESHOLD for s, _ in model.scores(some.column("text").to_pylist())], pa.bool_()))
            give_back()

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
