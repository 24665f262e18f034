"""Near-duplicate groups with MinHash bands and odd sketches.

1. One pass over the texts gives each document a 128-bit fingerprint of its
   words, its MinHash samples folded into an odd sketch (each sample flips one
   bit, so the XOR of two sketches shows the samples in which they differ) and
   its band keys. Equal word sequences share a fingerprint and are handled as
   one text from here on.
2. Texts that share a band key are candidates. In rounds, texts without a link
   so far are paired with a few pivots of each of their bands (members that are
   smallest under a different bit pattern each time, found by a combined
   aggregate), so a band makes pairs in proportion to its size. Pairs whose
   sketches put the similarity clearly below the threshold are dropped, the
   others are confirmed on the full shingle sets.
3. Confirmed links give components, and what is left is settled exactly: band
   members of different components meet in blocks, which test all their pairs by
   sketches and then on the full sets (a matrix product where many pairs are
   close) and return only links that join components. A band that lies in one component needs nothing more, which is the
   usual case, also for groups of thousands.

A missed link needs a pair to share none of the bands (at the threshold less
than one in 10^7) or a sketch estimate more than five and a half standard
deviations off.

Defined cases: null or empty texts and texts without words have 0 shingles and
are linked with nothing; rows with a null doc_id are linked with nothing and
have a null component; rows that repeat a doc_id are one node; further columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import is_local_size, maybe_broadcast, settle, stored, table
from rankloom.llm.components import components
from rankloom.llm.wordhash import mix, shingle_sets

BAND_ROWS = 4
SKETCH_WORDS = 4  # of 64 bits
PIVOTS = (1, 2)  # of a band, in each round; a text is in many bands
BLOCK = 1024
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def band_count(percent: int) -> int:
    """Bands of ``BAND_ROWS`` samples that miss a pair at the threshold at most once in 10^7."""
    return math.ceil(-7 * math.log(10) / math.log1p(-((percent / 100) ** BAND_ROWS)))


def _coefficients(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _samples(s: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set ``s``."""
    out = np.full(len(coef), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):  # bounded memory for very long texts
        out = np.minimum(out, (s[at : at + 2048, None] * coef[None, :]).min(axis=0))
    return out


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, fp, n_shingles, s0.., bands) of every document; fp and the rest null without words."""
    n_samples = bands * BAND_ROWS

    def run(it):
        coef = _coefficients(n_samples)
        which = np.arange(n_samples, dtype=np.uint64)
        band = np.arange(bands, dtype=np.uint64)
        for b in it:
            out = {"fp": [], "n_shingles": [], "bands": [], **{c: [] for c in _SKETCH}}
            for w, s in shingle_sets(b.column("text"), k):
                out["n_shingles"].append(len(s))
                if not len(s):
                    for c in ("fp", "bands", *_SKETCH):
                        out[c].append(None)
                    continue
                at = np.arange(len(w), dtype=np.uint64)
                one, two = mix(w + at * np.uint64(0x9FB21C651E98DF25)), mix(w ^ mix(at + np.uint64(77)))
                out["fp"].append(int(one.sum()).to_bytes(8, "big") + int(two.sum()).to_bytes(8, "big"))
                v = _samples(s, coef)
                bit = mix(v ^ (which * np.uint64(0xC2B2AE3D27D4EB4F))) % np.uint64(64 * SKETCH_WORDS)
                parity = np.packbits(np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1 == 1).view(np.int64)
                for c, x in zip(_SKETCH, parity, strict=True):
                    out[c].append(int(x))
                key = band + np.uint64(1)
                for j in range(BAND_ROWS):
                    key = mix(key + v[j::BAND_ROWS])
                out["bands"].append(key.view(np.int64))
            cols = {"doc_id": b.column("doc_id"), "fp": pa.array(out["fp"], pa.binary()), "n_shingles": pa.array(out["n_shingles"], pa.int64())}
            cols |= {c: pa.array(out[c], pa.int64()) for c in _SKETCH}
            yield pa.RecordBatch.from_pydict(cols | {"bands": pa.array(out["bands"], pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = ", ".join(f"{c} bigint" for c in _SKETCH)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp binary, n_shingles bigint, {sketch}, bands array<bigint>")


def _least_distance(percent: int, samples: int) -> int:
    """The most differing sketch bits that a pair at the threshold may show."""
    t = percent / 100
    worst = max(0.0, t - 5.5 * math.sqrt(t * (1 - t) / samples))
    bits = 64 * SKETCH_WORDS
    mean = bits / 2 * (1 - math.exp(-4 * samples * (1 - worst) / bits))
    return math.ceil(mean)


def _close(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs whose sketches (columns with suffix _a and _b) differ in at most ``most`` bits."""
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    return pairs.filter(differ <= most)


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets reach the threshold."""

    def run(it):
        for x in it:
            keep, held, last = [], None, object()
            left = x.column("a").to_pylist()
            heads = [i for i, a in enumerate(left) if i == 0 or a != left[i - 1]]  # rows come sorted by a
            sets = iter([s for _, s in shingle_sets(x.column("text_a").take(pa.array(heads, pa.int64())), k)])
            for i, (_, s) in enumerate(shingle_sets(x.column("text_b"), k)):
                if left[i] != last:
                    held, last = next(sets), left[i]
                both = len(np.intersect1d(held, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(s) - both))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = F.broadcast(ids) if is_local_size(ids, 16) else ids
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")
    return both.mapInArrow(run, pairs.select("a", "b").schema).distinct()


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in _SKETCH]), side)
    return pairs


def linked_components(docs: DataFrame, sig: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """(node, label) of the representatives that have a confirmed link."""
    most = _least_distance(percent, bands * BAND_ROWS)
    reps = sig.filter("fp is not null and doc_id is not null")
    first = reps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    reps = stored(reps.join(first, ["fp", "doc_id"], "left_semi").dropDuplicates(["fp", "doc_id"]).select("doc_id", *_SKETCH, "bands"), "near-dup")
    sketches = maybe_broadcast(reps.select("doc_id", *_SKETCH), 64)
    rows = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"))
    shared = rows.groupBy("band").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x < y").select("band")
    members = stored(rows.join(shared, "band", "left_semi"), "near-dup")
    lonely, edges, used = members, None, 0
    for n in PIVOTS:
        salts = [_salt(used + j) for j in range(n)]
        used += n
        pick = [F.min(F.col("doc").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)) for s in salts]
        pivots = members.groupBy("band").agg(F.array(*pick).alias("pivots"))
        pairs = lonely.join(pivots, "band").select("doc", F.explode("pivots").alias("pivot")).filter("doc <> pivot")
        pairs = pairs.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
        close = settle(_close(_with_sketches(pairs, sketches), most).select("a", "b"))
        good = settle(_confirm(close, docs, k, percent))
        edges = good if edges is None else edges.unionByName(good)
        linked = edges.select(F.col("a").alias("doc")).unionByName(edges.select(F.col("b").alias("doc"))).distinct()
        lonely = members.join(maybe_broadcast(linked, 16), "doc", "left_anti")
    labels = settle(components(edges))
    rest = settle(_rest(members, labels, sketches, docs, most, k, percent))
    return labels if rest.isEmpty() else components(edges.unionByName(rest))


def _salt(i: int) -> int:
    """The bit pattern under which the i-th pivot of a band is its smallest member."""
    return ((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 2 if i else 0


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], close: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sorted sets, for the (left, right) pairs marked in ``close``.

    Many pairs go through a product of incidence matrices over the elements
    that both sides have, few pairs one by one; both are exact.
    """
    out = np.zeros(close.shape, dtype=np.int64)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if len(left) * len(right) * len(both) > close.sum() * 2_000_000:
        for i, j in zip(*np.nonzero(close), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    for at in range(0, len(both), 8192):  # bounded memory
        part = both[at : at + 8192]

        def rows(sets, part=part):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                col = np.minimum(np.searchsorted(part, own), len(part) - 1)
                m[i, col[part[col] == own]] = 1
            return m

        out += (rows(left) @ rows(right).T).astype(np.int64)
    return out


def _joining(labels_a: np.ndarray, labels_b: np.ndarray) -> list[int]:
    """The positions of links that join labels not joined by links before them."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    keep = []
    _, first = np.unique(np.stack([labels_a, labels_b]), axis=1, return_index=True)
    for i in np.sort(first).tolist():
        p, q = root(int(labels_a[i])), root(int(labels_b[i]))
        if p != q:
            top[max(p, q)] = min(p, q)
            keep.append(i)
    return keep


def _rest(members: DataFrame, labels: DataFrame, sketches: DataFrame, docs: DataFrame, most: int, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components that share a band.

    A band's members are dealt into blocks of about ``BLOCK`` by their id's
    hash; each pair of blocks is one group, so a large band is many groups. A
    group tests all its pairs by sketches, confirms the close ones on the full
    sets, and returns the links that join components, at most one a component.
    """
    now = members.join(maybe_broadcast(labels.withColumnRenamed("node", "doc"), 24), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    size = now.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).filter("x < y")
    size = size.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    now = settle(now.join(size, "band"))
    ids = maybe_broadcast(now.select(F.col("doc").alias("doc_id")).distinct(), 16)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    now = now.join(sketches.withColumnRenamed("doc_id", "doc"), "doc").join(texts, "doc")
    now = now.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    now = now.select("band", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "doc", "label", "text", *_SKETCH)
    kind = members.schema["doc"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        doc, label, own = (t.column(c).to_numpy() for c in ("doc", "label", "own"))
        g, h = t.column("g")[0].as_py(), t.column("h")[0].as_py()
        sk = np.stack([t.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
        left, right = np.flatnonzero(own == g), np.flatnonzero(own == h)
        close = label[left][:, None] != label[right][None, :]
        for at in range(0, len(left), 64):
            differ = np.bitwise_count(sk[left[at : at + 64]][:, None, :] ^ sk[right][None, :, :]).sum(axis=2, dtype=np.int64)
            close[at : at + 64] &= differ <= most
        left, right, close = left[close.any(axis=1)], right[close.any(axis=0)], close[close.any(axis=1)][:, close.any(axis=0)]
        if not close.any():
            return pa.table({"a": doc[:0], "b": doc[:0]})
        need = np.unique(np.concatenate([left, right]))
        sets = dict(zip(need.tolist(), (s for _, s in shingle_sets(t.column("text").take(pa.array(need)), k)), strict=True))
        a, b = [sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()]
        n = _shared_counts(a, b, close)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - n
        x, y = np.nonzero(close & (100 * n >= percent * union))
        x, y = left[x], right[y]
        keep = _joining(label[x], label[y])
        x, y = doc[x[keep]], doc[y[keep]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return now.groupBy("band", "g", "h").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents``.

    Texts are linked if their sets of ``shingle``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the smallest
    doc_id that links reach.
    """
    docs = documents.select("doc_id", "text")
    bands = band_count(percent)
    sig = stored(signatures(docs, shingle, bands), "near-dup")
    low = linked_components(docs, sig, shingle, percent, bands)
    base = sig.select("doc_id", "n_shingles", "fp")
    first = base.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    first = first.join(low.select(F.col("node").alias("rep"), "label"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component"))
    # A doc_id that repeats with different texts joins what they belong to.
    out = base.join(first, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM d) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
