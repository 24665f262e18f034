"""Language identification by words first, shorter and shorter n-grams after.

From a bounded sample of labelled learning rows: how often each language has
each word, and each character n-gram of its words (1 to 5 characters, with word
ends marked). A text's score for a language is the sum over its words of the
log frequency of the word if the model knows it; of an unknown word, the mean
log frequency of its longest known n-grams (5 characters, else 4, ... else 1).
The reported score is the winner's share under a softmax of the sums.

Counts are made and added up by Spark; the ``words`` most frequent words and
``grams`` most frequent n-grams are kept, so the model's size is fixed.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is everything if no row has a language; texts of unknown words and n-grams
get the most frequent language; ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import id_bucket, settle, table

SAMPLE, WORDS, GRAMS, LONGEST = 8_000, 150_000, 60_000, 5
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; single characters without marks."""
    w = word if n == 1 else f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def learning_rows(documents: DataFrame, modulus: int, held_out: int, sample: int) -> DataFrame:
    """(lang, text) of at most ``sample`` rows, those with the smallest id hash."""
    rows = documents.filter("lang is not null and doc_id is not null").filter(id_bucket(F.col("doc_id"), modulus) != held_out)
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    return rows.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(n, feature, lang, count): words have n = 0, n-grams their length."""

    def run(it):
        total: dict[str, Counter] = {}
        for b in it:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                total.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
            if sum(map(len, total.values())) > 300_000:
                yield from _rows(total)
                total = {}
        yield from _rows(total)

    def _rows(total):
        for lang, words in total.items():
            found = {0: words}
            for n in range(1, LONGEST + 1):
                c = found[n] = Counter()
                for w, k in words.items():
                    for g in grams(w, n):
                        c[g] += k
            for n, c in found.items():
                yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(c), pa.int32()), "feature": pa.array(c.keys(), pa.string()), "lang": [lang] * len(c), "count": pa.array(c.values(), pa.int64())})

    return rows.mapInArrow(run, "n int, feature string, lang string, count bigint").groupBy("n", "feature", "lang").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies of the kept words and n-grams, a row of languages each."""

    def __init__(self, langs: list[str], prior: np.ndarray, rows: list[tuple[int, str, dict[str, int]]]):
        self.langs, self.prior = langs, prior
        at = {x: i for i, x in enumerate(langs)}
        self.word: dict[str, int] = {}
        self.gram: dict[str, int] = {}
        counts = np.full((len(rows), len(langs)), 0.0)
        kinds = np.array([n for n, _, _ in rows], dtype=np.int64)
        for i, (n, f, by) in enumerate(rows):
            (self.word if n == 0 else self.gram)[f] = i
            for lang, k in by.items():
                counts[i, at[lang]] = k
        self.log = np.zeros_like(counts)
        for n in np.unique(kinds):
            own = kinds == n
            total = counts[own].sum(axis=0)
            self.log[own] = np.log((counts[own] + 0.5) / (total + 0.5 * own.sum() + 1))
        self.cache: dict[str, np.ndarray] = {}
        self.none = np.zeros(len(langs))

    def _unknown(self, word: str) -> np.ndarray:
        got = self.cache.get(word)
        if got is None:
            got = self.none
            for n in range(min(LONGEST, len(word) + 2), 0, -1):
                known = [i for g in grams(word, n) if (i := self.gram.get(g)) is not None]
                if known:
                    got = self.log[known].mean(axis=0)
                    break
            if len(self.cache) >= 100_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        get = self.word.get
        ids = [get(w, -1) for w in words]
        at = np.array(ids)
        total = self.log[at[at >= 0]].sum(axis=0) + self.prior
        unknown = [w for w, i in zip(words, ids, strict=True) if i < 0]
        if unknown:
            total = total + np.sum([self._unknown(w) for w in unknown], axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(documents: DataFrame, modulus: int = 4, held_out: int = 2, sample: int = SAMPLE, words: int = WORDS, n_grams: int = GRAMS) -> Model:
    rows = learning_rows(documents, modulus, held_out, sample)
    langs = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    names = sorted(langs)
    counts = feature_counts(rows).groupBy("n", "feature").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    counts = settle(counts)
    kept = []
    for part, most in ((F.col("n") == 0, words), (F.col("n") > 0, n_grams)):
        top = counts.filter(part).orderBy(F.desc("total"), "n", "feature").limit(most)
        kept += [(r.n, r.feature, r.by) for r in top.select("n", "feature", "by").collect()]  # at most `words` + `n_grams` rows
    prior = np.log(np.array([langs[x] for x in names], dtype=float) / max(1, sum(langs.values()))) if names else np.zeros(0)
    return Model(names, prior, kept)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            got = [held.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
