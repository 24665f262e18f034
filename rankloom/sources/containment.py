"""Exact substring containment between a corpus and a pattern set.

A document is paired with a pattern when the pattern's whole text occurs in
the document's text. A pattern's inner words (all but its first and last,
which may be cut in the document) occur as whole words in such a document, so
its first inner words are an equi-join key: documents' word shingles are looked
up among the patterns' (measured, broadcast; beyond that their hashes are
joined), and ``contains`` confirms the candidates on the full texts.
The work is linear in the corpus and no document x pattern pairs are formed.

Patterns of fewer than three words have no inner word; each document checks
them in its row, against a list that is measured before it is broadcast and
split when it is too large.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import BROADCAST_BYTES, checked_broadcast, measured

ANCHOR_WORDS = 3
_SPACE = "[ \t\r\n]+"


def _shingles(words: str, k: int) -> Column:
    """Hashes of the ``k``-word shingles of an array column."""
    w = F.col(words)
    last = F.size(w) - F.lit(k)
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + F.lit(j)] for j in range(k)]))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


#: Documents whose words a task looks up at a time, and anchor words that are numbered at most (three numbers make a key).
LOOKED_UP, NUMBERED = 1024, 1 << 20


class _Anchors:
    """The anchors of the patterns ``at`` that have ``n`` words, as sorted keys."""

    def __init__(self, n: int, words: np.ndarray, at: np.ndarray, size: int):
        self.n, self.size = n, size
        keys = self.key([words[:, i] for i in range(n)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.at = at[order]

    def key(self, words) -> np.ndarray:
        out = words[0].astype(np.int64)
        for w in words[1:]:
            out = out * self.size + w
        return out

    def found(self, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, patterns)`` of the anchors among the words of the rows; ``word`` is -1 where no anchor has it."""
        last = len(word) - self.n + 1
        if last < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((word[:last] >= 0) & (row[:last] == row[self.n - 1 :]))
        for i in range(1, self.n):
            at = at[word[at + i] >= 0]
        key = self.key([word[at + i] for i in range(self.n)])
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        place, rows = place[hit], row[at[hit]]
        n = self.count[place]
        return np.repeat(rows, n), self.at[np.repeat(self.start[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _looked_up(docs: DataFrame, first: DataFrame, doc_key: str, pat_key: str) -> DataFrame | None:
    """Candidate pairs, the documents' words looked up among the anchors ``first`` inside the tasks; None if these have too many words."""
    own = first.toArrow()  # at most the measured bytes
    lists = own.column("words").combine_chunks()
    words = lists.flatten().dictionary_encode()
    if len(words.dictionary) >= NUMBERED:
        return None
    size, start = pc.list_value_length(lists).to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    number, at = words.indices.to_numpy(zero_copy_only=False), np.arange(len(lists))
    anchors = [_Anchors(int(n), number[start[size == n][:, None] + np.arange(n)], at[size == n], len(words.dictionary)) for n in np.unique(size)]
    held = docs.sparkSession.sparkContext.broadcast((anchors, words.dictionary, own.column(pat_key).combine_chunks()))
    schema = T.StructType([first.schema[pat_key], docs.schema[doc_key]])

    def run(batches):
        anchors, known, keys = held.value
        for whole in batches:
            for lo in range(0, whole.num_rows, LOOKED_UP):
                b = whole.slice(lo, LOOKED_UP)
                lists = pc.split_pattern_regex(b.column(1).cast(pa.string()), _SPACE)
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                word = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
                found = [a.found(row, word) for a in anchors]
                pairs = np.unique(np.concatenate([r * len(keys) + p for r, p in found]))
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(pairs % len(keys))), b.column(0).take(pa.array(pairs // len(keys)))], names=[pat_key, doc_key])

    return docs.select(doc_key, "text").mapInArrow(run, schema)


def _by_anchor(docs: DataFrame, long: DataFrame, doc_key: str, pat_key: str, max_bytes: int) -> DataFrame | None:
    """Candidate pairs that share the pattern's first inner words: one scan for all anchor lengths."""
    n = F.least(F.size("inner"), F.lit(ANCHOR_WORDS))
    first, small = measured(long.select(pat_key, F.slice("inner", F.lit(1), n).alias("words")), max_bytes)
    lengths = sorted(r["n"] for r in first.select(F.size("words").alias("n")).distinct().collect())  # at most ANCHOR_WORDS rows
    if not lengths:
        return None
    found = _looked_up(docs, first, doc_key, pat_key) if small else None
    if found is not None:
        return found
    anchor = F.coalesce(*[F.when(F.size("words") == k, F.get(_shingles("words", k), F.lit(0))) for k in lengths])
    own, small = measured(first.select(pat_key, anchor.alias("anchor")), max_bytes)
    words = docs.select(doc_key, F.split("text", _SPACE).alias("words"))
    # Hashes of different numbers of words differ, so the lengths share one column.
    found = words.select(doc_key, F.explode(F.concat(*[_shingles("words", k) for k in lengths])).alias("anchor"))
    return found.join(F.broadcast(own) if small else own, "anchor").select(pat_key, doc_key)


def _short(docs: DataFrame, short: DataFrame, doc_key: str, pat_key: str, max_bytes: int) -> DataFrame | None:
    size = short.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return None
    out = None
    chunks = max(1, math.ceil(size["bytes"] / max_bytes))
    for c in range(chunks):
        chunk = short.filter(F.pmod(F.xxhash64(pat_key), F.lit(chunks)) == c)
        one = F.broadcast(chunk.agg(F.collect_list(F.struct(pat_key, "text")).alias("pats")))  # one row of at most about max_bytes
        hit = docs.select(doc_key, "text").crossJoin(one)  # one row
        hit = hit.select(doc_key, F.explode(F.filter("pats", lambda p: F.contains(F.col("text"), p["text"]))).alias("p"))
        hit = hit.select(F.col(f"p.{pat_key}").alias(pat_key), doc_key)
        out = hit if out is None else out.unionByName(hit)
    return out


def contains_pairs(docs: DataFrame, patterns: DataFrame,
                   doc_key: str = "docno", pat_key: str = "qid",
                   max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(pat_key, doc_key)`` for every document text containing a pattern text.

    ``docs`` has ``(doc_key, text)``, ``patterns`` has ``(pat_key, text)``.
    Empty or NULL texts are not matched.
    """
    pats = patterns.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select(pat_key, "text")
    parts = F.split("text", _SPACE)
    pats = pats.withColumn("inner", F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2))
                           .otherwise(F.array().cast("array<string>")))
    pairs = _by_anchor(docs, pats.filter(F.size("inner") > 0), doc_key, pat_key, max_bytes)
    out = _short(docs, pats.filter(F.size("inner") == 0), doc_key, pat_key, max_bytes)
    if pairs is not None:
        pairs = pairs.distinct().join(checked_broadcast(pats.select(pat_key, F.col("text").alias("pattern")), max_bytes), pat_key)
        pairs = docs.select(doc_key, "text").join(checked_broadcast(pairs, max_bytes), doc_key)
        pairs = pairs.filter(F.contains("text", F.col("pattern"))).select(pat_key, doc_key)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = patterns.select(pat_key).crossJoin(docs.select(doc_key)).limit(0)  # no pattern: no pair
    return out.distinct()
