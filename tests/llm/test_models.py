"""Language, scoring and classification operators: held-out results, brute force, defined cases."""

import math
import pickle
import pickletools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import language, mixing, quality, toxicity

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_language_held_out(docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs, language.fit(docs)).collect()
    held = [r for r in got if bucket(r.doc_id, 4) == 2]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_language_backoff_and_defined_cases(spark):
    d = spark.createDataFrame([(i, "the house and the garden", "en", 1) for i in range(8)] + [(20 + i, "das haus und der garten", "de", 1) for i in range(8)] + [(50, "x", None, 1)],
                              "doc_id long, text string, lang string, score int")
    m = language.fit(d)
    assert m.predict("the")[0] == "en" and m.predict("und")[0] == "de"
    assert m.predict("housegarden")[0] == "en" and m.predict("hausgarten")[0] == "de"  # unknown words
    assert m.predict("")[0] == m.predict(None)[0] == m.predict("12 ²_!")[0] == "und"
    assert m.predict("мир")[0] in ("en", "de")
    none = language.fit(d.limit(0))
    assert none.predict("the") == ("und", 0.0)
    assert language.identify(d.limit(0), m).count() == 0


def test_language_brute_force(spark):
    """Words, then n-grams from the longest known: every text's winner and score from plain counts."""
    rng = random.Random(12)
    stock = {"en": ["the", "house", "garden", "and", "tree"], "de": ["das", "haus", "garten", "und", "baum"], "fr": ["la", "maison", "jardin", "et", "arbre"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=rng.randint(1, 12))), lang) for i, lang in enumerate(rng.choices(list(stock), k=90))]
    rows += [(200, "", "en"), (201, None, "de"), (202, "same same", None), (203, "Haus " * 30000, "de"), (204, rows[0][1], rows[0][2]), (204, rows[0][1], rows[0][2])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [(t, lang) for i, t, lang in rows if lang is not None and bucket(i, 4) != 2]
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [x[i : i + n] for x in [w if n == 1 else f"<{w}>"] for i in range(len(x) - n + 1)]
    count = {n: Counter() for n in range(6)}
    for t, lang in learn:
        for w in words(t):
            count[0][w, lang] += 1
            for n in range(1, 6):
                for g in cut(w, n):
                    count[n][g, lang] += 1
    langs = sorted({lang for _, lang in learn})
    prior = Counter(lang for _, lang in learn)

    def log(n, f, lang):
        kinds = len({x for x, _ in count[n]})
        return math.log((count[n][f, lang] + 0.5) / (sum(k for (_, la), k in count[n].items() if la == lang) + 0.5 * kinds + 1))

    known = {n: {f for f, _ in count[n]} for n in count}

    def score(t, lang):
        total = math.log(prior[lang] / len(learn))
        for w, times in Counter(words(t)).items():
            if w in known[0]:
                total += times * log(0, w, lang)
                continue
            for n in range(min(5, len(w) + 2), 0, -1):
                own = [g for g in cut(w, n) if g in known[n]]
                if own:
                    total += times * sum(log(n, g, lang) for g in own) / len(own)
                    break
        return total

    texts = [t for _, t, _ in rows[:30]] + [None, "", "123", "hausgarden", "xyzzy", "Tree und jardin", "das la the", "maisonhaus ½"]
    m = language.fit(d)
    for t in texts:
        got, share = m.predict(t)
        if not any(c.isalpha() for c in t or ""):
            assert (got, share) == ("und", 0.0)
            continue
        by = [score(t, lang) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (round(by[i], 9), -i))
        assert got == langs[best] and abs(share - 1 / sum(math.exp(x - by[best]) for x in by)) < 1e-9


def test_base_score_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "The", "cat", "dög", "x\ty"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "new words only here", "b " * 40000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the end")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    count = Counter(x for i, t in rows if i is None or bucket(i, 10) != 0 for x in tokens(t))
    n, v = sum(count.values()), len(count)
    for frequent in (3, 10_000):
        got = mixing.score(d, frequent=frequent).collect()
        want = sorted((str(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 5)) for i, t in rows)
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert mixing.score(d.limit(0)).count() == 0


def test_mixer_is_a_distribution_and_learns():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["sun", "moon", "star"]) for _ in range(30)) for _ in range(80)]
    seen = np.zeros(257, np.int64)
    for _, u, _ in mixing.runs(pa.array(texts)):
        seen += np.bincount(u.sym, weights=u.count[u.of], minlength=257).astype(np.int64)
    code = mixing.Code(seen + 1)
    counts = [np.zeros(2 << b, np.int64) for b in mixing.BITS]
    for _, u, _ in mixing.runs(pa.array(texts[20:])):
        ctx, _ = mixing.contexts(u.sym, u.of, u.before)
        for _, at, node, bit in mixing.bits_of(code, u.sym):
            for c, t in enumerate(counts):
                np.add.at(t, mixing.slots_of(ctx[c][at], node, c) * 2 + bit, u.count[u.of[at]])
    m = mixing.Mixer(code, [t.reshape(-1, 2) for t in counts])
    m.learn(texts[:20])
    # The costs of all symbols after the same bytes belong to one distribution.
    start = list(b"sun mo")
    after = []
    for c in range(257):
        sym = np.array([*start, c])
        ctx, kind = mixing.contexts(sym, np.zeros(len(sym), np.int64), np.array([0]))
        whole = m.costs(sym, np.zeros(len(sym), np.int64), np.array([0]))[0]
        after.append(math.exp(m.costs(sym[:-1], np.zeros(len(sym) - 1, np.int64), np.array([0]))[0] - whole))
    assert abs(sum(after) - 1) < 1e-3
    per_byte = -m.log10(pa.array(["moon star sun star"]))[0] * math.log2(10) / 18
    noise = -m.log10(pa.array(["qzkv jxwp bbgh tttt"]))[0] * math.log2(10) / 19
    assert per_byte < 1.5 < 6 < noise
    # A text scored alone, in a batch, and cut into pieces gets the same score.
    long = "moon sun star " * 700_000
    both = m.log10(pa.array(["sun", long, None]))
    assert abs(both[0] - m.log10(pa.array(["sun"]))[0]) < 1e-3
    short = m.log10(pa.array(["moon sun star " * 1000, "moon sun star " * 2000]))
    assert abs(both[1] - (short[0] + (short[1] - short[0]) / 1000 * 699_000)) < 1e-3 * abs(both[1]) and both[2] == m.log10(pa.array([""]))[0]


def test_mixer_is_fitted_on_every_text(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["sun", "moon", "star"]) for _ in range(2_500)) for _ in range(6)]  # all above 8,000 characters
    texts += [" ".join(rng.choice(["red", "green", "blue"]) for _ in range(20)) for _ in range(230)] + ["\u00e9t\u00e9 \u00e9t\u00e9", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    units = {(bytes(r.unit), r.before): (r.n, r.texts) for r in mixing.distinct_units(d).collect()}
    want: dict = {}
    for t in texts:
        u = mixing.Units(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        for i in range(len(u.before)):
            key = bytes(u.sym[u.of == i].astype(np.uint8)), int(u.before[i])
            n, k = want.get(key, (0, 0))
            want[key] = n + int(u.count[i]), k + 1
        key = b"", int(u.last[0])
        want[key] = tuple(x + 1 for x in want.get(key, (0, 0)))
    assert units == want
    seen = mixing.symbol_counts(mixing.distinct_units(d))
    assert seen[mixing.END] == len(texts) and seen[:256].sum() == sum(len((t or "").encode()) for t in texts)
    # The long texts alone: weights, code and table are learned from them too, and known costs change no score.
    m, plain = mixing.fit(d.limit(0)), mixing.fit(d.filter("length(text) > 8000"), 0)
    fitted = mixing.fit(d.filter("length(text) > 8000").repartition(3))
    assert not (m.weights != np.append(np.full(5, np.float32(mixing.START)), np.float32(0))).any() and (plain.weights != m.weights).any()
    assert len(plain.known[0]) == 0 < len(fitted.known[0])
    col = pa.array(["sun moon star", "sun blue", None])
    assert np.allclose(plain.log10(col), fitted.log10(col), atol=1e-4)


def test_quality_held_out(docs, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (bucket(r.doc_id, 5) == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def test_quality_defined_cases(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["good text here.", "", None, "!!! $$$ " * 9000, "good text here."])], "doc_id long, text string, y int")
    lab = spark.createDataFrame([(i, i % 2, None) for i in range(5)] + [(0, None, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(d, lab).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.score for r in quality.classify(d, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(d.limit(0), lab).count() == 0


def test_pairwise_quality_brute_force():
    """The weights minimise the stated loss, the cut is the quantile, the score is 0.3 at the cut."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = (x @ np.array([2.0, -1.0, 0.0, 0.5, 0.0]) + rng.normal(size=400) > 0.4).astype(int)
    m = quality.fit(x, y)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    few, many, sign = (np.flatnonzero(y == 0), np.flatnonzero(y == 1), -1.0) if (y == 0).sum() <= (y == 1).sum() else (np.flatnonzero(y == 1), np.flatnonzero(y == 0), 1.0)
    i = np.repeat(few, quality.PAIRS_EACH)
    d = sign * (z[i] - z[np.random.default_rng(7).choice(many, len(i))])
    loss = lambda w: sum(math.log1p(math.exp(-float(v @ w))) for v in d) + 0.001 * len(d) * float(w @ w)
    least = loss(m["w"])
    for j in range(5):
        for step in (0.01, -0.01):
            assert loss(m["w"] + step * np.eye(5)[j]) > least
    s = z @ m["w"]
    assert abs(m["cut"] - np.quantile(s, (y == 0).mean())) < 1e-9
    p = quality.score(m, x)
    assert ((p >= quality.THRESHOLD) == (s >= m["cut"] - 1e-12)).all() and (np.argsort(p, kind="stable") == np.argsort(s, kind="stable")).all()
    assert np.mean((p >= quality.THRESHOLD) == y) > 0.85


def test_nearest_examples_are_exact():
    rng = random.Random(4)
    words = ["bad", "worse", "fine", "nice", "sky", "sea", "tree", "rock"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    y = np.array([int("bad" in t or "worse" in t) for t in texts])
    m = toxicity.Model(texts, y)
    x = np.zeros((m.index.n, len(m.terms) + 1))
    x[m.index.doc, m.index.own_term] = m.index.own_w
    for t in texts[:60] + ["bad sky", "worse"]:
        at, w = m.vectors(toxicity.term_counts(t))
        q = np.zeros(x.shape[1])
        q[at] = w
        for k in (1, 5, 15):
            assert np.allclose(m.index.nearest(at, w, k)[0], np.sort(x @ q)[::-1][:k])


def test_nearest_examples_ties_and_frequent_terms():
    rng = random.Random(8)
    common = [a + b for a in ("sky", "sea", "tree", "rock", "sand") for b in ("", "ly", "er", "ing", "ment")]
    texts = [" ".join([*rng.sample(common, 12), f"own{chr(97 + i % 26)}{chr(97 + i % 23)}", *(["idiot"] if i % 10 == 0 else [])]) for i in range(500)]
    texts += texts[:100]  # equal texts, so equal similarities
    y = np.array([int("idiot" in t) for t in texts])
    m = toxicity.Model(texts, y)
    assert 0 < len(m.index.dense) < len(m.terms)  # both kinds of terms take part
    x = np.zeros((m.index.n, len(m.terms) + 1))
    x[m.index.doc, m.index.own_term] = m.index.own_w
    for t in texts[::7] + ["sky idiot", "ownab unheard", "sea"]:
        at, w = m.vectors(toxicity.term_counts(t))
        q = np.zeros(x.shape[1])
        q[at] = w
        sims = x @ q
        want = np.lexsort((np.arange(m.index.n), -np.round(sims, 9)))[:15]
        got = m.index.nearest(at, w, 15)
        assert got[1].tolist() == want.tolist() and np.allclose(got[0], sims[want])
        again = pickle.loads(pickle.dumps(m.index)).nearest(at, w, 15)
        assert again[1].tolist() == want.tolist()


def test_toxicity_rare_telling_words():
    rng = random.Random(5)
    words = [a + b for a in ("sky", "sea", "tree", "rock", "sand") for b in ("", "ly", "er", "ing", "ment")]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(400)]
    y = np.array([int(i % 8 == 0) for i in range(400)])
    texts = [t + " bad" if toxic else t for t, toxic in zip(texts, y, strict=True)]
    texts[0] = texts[8] = "zorbel gribnak"  # in two toxic examples only
    m = toxicity.Model(texts, y)
    score, evidence = m.score("Gribnak, zorbel!")
    assert {e for e, _ in evidence[:2]} == {0, 8} and score >= toxicity.THRESHOLD
    assert set(" ".join(texts).split()) <= set(m.terms)
    assert len(m.score("sky sea rock")[1]) == toxicity.NEIGHBOURS  # a text without a telling word has neighbours
    assert m.score("sky sea rock")[0] < toxicity.THRESHOLD
    assert m.score("unheard of")[1] == []  # no word that an example has


def test_toxicity_held_out(docs, labels):
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    clean = [r for r in held if truth[r.doc_id] == 0]
    assert np.mean([r.predicted == 0 for r in clean]) >= 0.97


def test_toxicity_defined_cases(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["you idiot", "", None, "nice day " * 9000, "you idiot"])], "doc_id long, text string, score int")
    lab = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(d, lab).collect())
    assert {(r.score, r.predicted) for r in toxicity.classify(d, lab.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.classify(d.limit(0), lab).count() == 0
    assert toxicity.keep_clean(d, lab).columns == d.columns


def test_toxicity_fit_and_model_stay_small():
    """A fit holds no second, double precision copy of its vectors; a model is pickled without a string for each term."""
    rng = random.Random(31)
    stock = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(2_000)]
    texts = [" ".join(rng.sample(stock, 1_000)) for _ in range(200)] + ["", "badword " * 3]
    y = np.array([int(i % 3 == 0) for i in range(len(texts))], dtype=np.int64)
    tracemalloc.start()
    model = toxicity.Model(texts, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 57 * len(model.index.own_term)  # 49 here, 66 with such a copy
    packed = pickle.dumps(model)
    assert sum("UNICODE" in op.name for op, _, _ in pickletools.genops(packed)) < 100 < len(model.terms)
    again = pickle.loads(packed)
    assert again.terms == model.terms and again.scores([*texts[:40], None, "", "zzzz"]) == model.scores([*texts[:40], None, "", "zzzz"])
