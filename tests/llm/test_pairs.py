"""Decontamination, near-duplicates, components and top-k against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, near_dup, topk
from rankloom.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op2_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def op2_brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = op2_words(t)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = op2_words(t), set(), set()
        for win, own in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["Éa", "éa", "X-y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(25)), (2, say(12)), (3, "one two"), (4, ""), (5, None), (6, say(25)), (7, "solo"), (10, "one two"), (None, say(11))]
    items.append((8, items[0][1]))
    docs = [(i, say(rng.randint(0, 40))) for i in range(25)]
    docs += [(100, say(7) + " " + items[0][1].upper() + " " + say(9)), (101, items[1][1] + " " + items[1][1]), (102, "a ONE, two. solo"), (103, None), (104, ""),
             (100, "repeated id " + items[5][1]), (105, items[0][1] + ", " + items[5][1]), (106, items[0][1][:-1]), (107, "x " * 5000 + items[1][1])]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, toks string, w string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, len int")
    got = decontaminate.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = op2_brute(docs, [(i, t) for i, t in items if i is not None])
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert sum(x[-1] for x in want) >= 5


def test_decontamination_null_ids(spark):
    words = " ".join(f"w{i}" for i in range(14))
    docs = [(None, words), (None, "clean text"), (1, words + " more"), (None, None), (2, "x " + words), (2, "clean again")]
    d = spark.createDataFrame([(*r, 7, "t") for r in docs], "doc_id long, text string, id long, carried string")
    b = spark.createDataFrame([(None, words), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    got = decontaminate.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 14, 14, 1, True), (None, 2, 0, 0, False), (1, 15, 14, 1, True), (None, 0, 0, 0, False), (2, 15, 14, 1, True), (2, 2, 0, 0, False)], key=str)
    kept = decontaminate.clean_rows(d, b)
    assert kept.columns == d.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean again", "clean text"]
    nobody = decontaminate.decontaminate(d, b.filter("item_id is null")).filter("contaminated").select("n_items", "items_sha256").collect()
    assert len(nobody) == 3 and all(r["n_items"] == 0 and r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in nobody)


def test_decontamination_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.decontaminate(d, b).count() == 0
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(one, b).collect()] == [(1, 2, 0, 0)]


def op3_brute(docs, k, percent):
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    top = {d: d for d, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, k, percent):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(12):  # families of edited copies, so that links form chains
        base = [word() for _ in range(rng.randint(4, 60))]
        for _ in range(rng.randint(1, 9)):
            docs.append(list(base))
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = word()
    texts = [" ".join(w) for w in docs] + ["", None, " \t", "one", "ONE", "one two", "One\ntwo", "y " * 9000, "y " * 9001]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    d = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, band string, label int")
    got = near_dup.near_duplicates(d, k, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == op3_brute(rows, k, percent)


def test_what_the_pivots_leave(spark, monkeypatch):
    """One pivot and small blocks: most links come from the exact last step."""
    monkeypatch.setattr(near_dup, "PIVOTS", (1,))
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    docs = []
    for i in range(70):  # a star of edits around one text that comes last, and edits of edits
        own = list(base if i % 3 else docs[-1][1].split() if docs else base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(own)))
    docs.append((99, " ".join(base)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(d, 3, 85).collect()))
    assert got == op3_brute(docs, 3, 85)
    assert len({g[2] for g in got}) < len(got)


def test_shared_counts_both_ways():
    rng = np.random.default_rng(3)
    left = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (5, 90, 200, 1)]
    right = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (50, 300, 2)]
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    for close in (np.ones((4, 3), bool), want > 10):
        assert (near_dup._shared_counts(left, right, close)[close] == want[close]).all()
    many = [left[1]] * 300
    assert (near_dup._shared_counts(many, many, np.eye(300, dtype=bool))[np.eye(300, dtype=bool)] == len(left[1])).all()


def test_near_duplicates_null_ids_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(d, 3, 85).collect()), key=str)
    assert got == [(5, 2, 5, True), (None, 2, None, False), (None, 2, None, False)]
    assert near_dup.near_duplicates(d.limit(0), 3, 85).count() == 0


def test_bands_are_enough():
    for percent in (80, 85, 90):
        t = percent / 100
        assert (1 - t**near_dup.BAND_ROWS) ** near_dup.band_count(percent) <= 1e-7


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        top[max(p, q)] = min(p, q)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == root(x) for x in top)


def op4_brute(vectors, every, k):
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=False)), v) for v, y in vectors.items() if v != q)
            out += [(q, r, v, -s) for r, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1024])
def test_top_k_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("inf")] * 6), (None, [1.0] * 6)]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int").repartition(7)
    vectors = topk.integer_vectors(d)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter(F.col("vec_id") % 10 == 0), 5, block).collect()))
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    assert got == op4_brute(usable, 10, 5)


def test_top_k_large_components(spark):
    rows = [(50 * i, [1.0e6 * (i + 1), -3.1e5 * i, 7.0]) for i in range(4)] + [(i, [2.0e6 - i, 1.0, -5.5e5]) for i in range(1, 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(d)
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect()))
    assert got == op4_brute({i: [int(np.floor(256 * x)) for x in e] for i, e in rows}, 50, 5)
    far = topk.integer_vectors(spark.createDataFrame([(0, [3e15]), (1, [3e15])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 61 bits"):
        topk.top_k(far, far.filter("vec_id = 0"), 5).collect()


def test_top_k_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [3e9, 1e9])], "vec_id long, embedding array<double>")
    v = topk.integer_vectors(d)
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect()))
    usable = {0: [256, 512], 1: [256, 512], 50: [int(256 * 3e9), int(256 * 1e9)]}
    assert got == op4_brute(usable, 50, 5)
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0
    assert topk.top_k(v.filter("vec_id = 0"), v.filter("vec_id = 0"), 5).count() == 0
