"""Secret scan and spelling variants against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import pytest

from rankloom.llm import secretscan, variants

# ---- secrets ------------------------------------------------------------------
NAIVE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def naive(t):
    out = []
    for rank, (kind, (pattern, ok)) in enumerate(NAIVE.items()):
        at, p = 0, re.compile(pattern)
        while at < len(t):
            m = p.match(t, at)
            if m and ok(m):
                out.append((m.start(), rank, m.end(), kind))
            at = m.end() if m else at + 1
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_plain_spans_are_brute_force():
    rng = random.Random(1)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "API_KEY", "ſecret", "toKen", "=", ":", " = ", '"', "'", "  ", "AKIA", "AKIAIOSFODNN7EXAMPL", "deadbeef", "0123456789abcdef", "x" * 12, "é", "-._=", "\n", "passwd"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secretscan.plain_spans(t) == naive(t), t


@pytest.fixture(scope="module")
def enc():
    return secretscan.encoding(secretscan.VOCABULARY)


def test_random_strings_are_found_and_digests_left_out(enc):
    rng = random.Random(2)
    found = 0
    for _ in range(300):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice((20, 32, 40))))
        t = f"we use {key} here"
        found += (7, 7 + len(key)) in secretscan.random_spans(t, enc)
    assert found >= 290
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (32, 40, 64)]
    for t in (*hexes, hexes[1].upper(), "123e4567-e89b-12d3-a456-426614174000", "4465758382889437", "2024-01-01-00-00-00-17", "internationalization", "getCustomerAddressById", "max_retry_count_default", "src/main/resources/application/config"):
        assert secretscan.random_spans(f"see {t} .", enc) == [], t


def test_addresses_by_segment_known_strings_and_windows(enc):
    key = "q8ZxT4vLw0PbN7sKd2Fh"
    t = f"https://example.com/documentation/{key}/overview"
    a = t.index(key)
    assert secretscan.random_spans(t, enc) == [(a, a + len(key))]
    assert secretscan.random_spans(t, enc, frozenset([key])) == []
    assert secretscan.random_spans(f"pw={key}==", enc) == [(3, 25)]  # padding belongs to the string
    rng = random.Random(3)
    blob = "".join(rng.choice(string.ascii_letters) for _ in range(300000))
    assert secretscan.random_spans(f"x {blob} y", enc) == [(2, 300002)]


def test_added_spans_stay_outside_plain_ones(enc):
    key = "q8ZxT4vLw0PbN7sKd2Fh"
    t = f'token = "{key}" and {key}'
    assert secretscan.spans_of(t, enc) == [(0, 29, "assign"), (35, 55, "random")]


def test_secret_query_cases(spark):
    key = "q8ZxT4vLw0PbN7sKd2Fh"
    rows = [(1, None), (2, ""), (3, f"é {key}"), (3, f"é {key}"), (None, "0123456789abcdef " * 20000), (5, "AKIA" + "Z" * 14)]
    d = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kind string, spans int")
    got = sorted(map(tuple, secretscan.digest(secretscan.find(d)).select("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans").collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    long = ",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(20000))
    want = [(1, 0, 0, 0, 0, sha(""), ""), (2, 0, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, 1, sha(""), "random:2:22"), (3, 0, 0, 0, 1, sha(""), "random:2:22"),
            (None, 0, 0, 20000, 0, sha(long), long), (5, 0, 1, 0, 0, sha("access:0:18"), "access:0:18")]
    assert got == sorted(want, key=str)
    assert secretscan.digest(secretscan.find(d.limit(0))).count() == 0


# ---- spelling variants ------------------------------------------------------------
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, shortest, least, damage):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def corpus(seed, alphabet, size, docs):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, size))) for _ in range(12)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stock[: rng.randint(1, len(stock))])
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(("", rng.choice(alphabet))) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice((" ", ", ", "1")).join(words)))
    return out + [(None, "Words words WORDS"), (3, None), (4, ""), (5, out[0][1]), (5, out[0][1])]


@pytest.mark.parametrize("hot", [0, 3, 64])
@pytest.mark.parametrize("alphabet,size", [("abé", 7), ("abcdefgh", 12)])
def test_variants_are_brute_force(spark, hot, alphabet, size):
    docs = corpus(size, alphabet, size, 150)
    d = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, word string, n int")
    got = [tuple(r[c] for c in COLUMNS) for r in variants.variants(d, damage=5, hot=hot).collect()]
    want = brute(docs, 5, 3, 5)
    assert len(got) == len(set(got)) and set(got) == want and any(f for _, f, *_ in want)


def test_long_chains_and_empty(spark):
    chain = ["abcde" + "x" * i for i in range(6)]  # every word is a form of the next, longer one
    text = " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2 ** (5 - i)))
    d = spark.createDataFrame([(0, text + " " + "y" * 200000)], "doc_id long, text string")
    got = {r["word"]: r for r in variants.variants(d, damage=10**9).collect()}
    assert {w: got[w]["root"] for w in chain} == dict.fromkeys(chain, chain[0])
    assert variants.variants(d.limit(0)).count() == 0
