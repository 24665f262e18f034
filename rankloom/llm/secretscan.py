"""Secrets: plain patterns plus a token-efficiency test.

Plain spans are the leftmost non-overlapping matches of each kind that are long
enough. The test adds spans of the kind ``random``: runs of key characters whose
characters-per-token ratio under a byte-pair vocabulary is low. A vocabulary
learned from text spends few tokens on words and about one token on every one
or two characters of a random string, whatever its alphabet.

Left out before the test, as known digests and identifiers: hexadecimal strings
of a digest's length, UUIDs, runs without a letter (numbers, dates, cards),
and the strings given as ``known``. A run with ``/`` after ``:``, ``.`` or ``/``,
or with two slashes in a row, is a path or an address: its segments are tested
one by one. The rest of ``name=value`` is tested as the value.

The vocabulary is read from the path given (one base64 piece and its rank a
line) and never trained. Pieces that hold letters only may be as long as their
run, so a run is encoded in windows of ``WINDOW`` characters; work and memory
stay linear in the text.

Defined cases: null and empty texts have no spans; a random span that lies in a
plain one is not added, and plain spans always stay; repeated rows each give a
row; the result has doc_id and spans only, whatever other columns there are.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: Characters a token at most: runs of letters and digits, runs of letters only.
MOST, MOST_LETTERS = 2.0, 1.5
SHORTEST = 16
WINDOW = 256
# The splitting pattern of the vocabulary, and digest lengths in hexadecimal digits.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{12}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_WORDS = ("password", "passwd", "secret", "token", "api")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def plain_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain matches, by start then kind as listed."""
    out = []
    if not _LONG.search(t):  # every kind holds a run of 12 such characters
        return out
    low = t.lower()
    if any(w in low for w in _WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 12]
    if "AKIA" in t:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(t) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(t)]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def candidates(t: str) -> list[tuple[int, int]]:
    """Runs of key characters that are neither digests, nor numbers, nor UUIDs; addresses by segment."""
    out = []
    for m in _RUN.finditer(t):
        a, b = m.span()
        path = "/" in m[0] and ("//" in m[0] or t[max(a - 1, 0) : a] in (":", ".") and a > 0 or m[0][0] == "/")
        at = a
        for part in m[0].split("/") if path else [m[0]]:
            body = part.lstrip("+/_-")
            start = at + len(part) - len(body)
            body = body.rstrip("+/_-")
            at += len(part) + 1
            if len(body) >= SHORTEST and not known_shape(body):
                out.append((start, start + len(body)))
    return out


def known_shape(run: str) -> bool:
    """Whether ``run`` looks like a digest, a UUID or a number."""
    if not any(c.isalpha() for c in run) or _UUID.fullmatch(run):
        return True
    return len(run) in _DIGESTS and _ANY_HEX.fullmatch(run) is not None


def per_token(enc, run: str) -> float:
    """Characters a token of ``run``, encoded in windows."""
    n = sum(len(enc.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))
    return len(run) / n


def random_spans(t: str, enc, known: frozenset = frozenset(), most: float = MOST, most_letters: float = MOST_LETTERS) -> list[tuple[int, int]]:
    """Spans of runs whose characters-per-token ratio is low."""
    out = []
    for a, b in candidates(t):
        run = t[a:b]
        limit = most if any("0" <= c <= "9" for c in run) else most_letters
        if run not in known and per_token(enc, run) <= limit:
            out.append((a, b))
    return out


def spans_of(t: str, enc, known: frozenset = frozenset(), most: float = MOST, most_letters: float = MOST_LETTERS) -> list[tuple[int, int, str]]:
    """All spans of a text, by start then kind as listed."""
    plain = plain_spans(t)
    more, reach, at = [], -1, 0
    for a, b in random_spans(t, enc, known, most, most_letters):
        while at < len(plain) and plain[at][0] <= a:
            reach = max(reach, plain[at][1])
            at += 1
        if b > reach:  # in no plain span that starts at or before it
            more.append((a, b, "random"))
    return sorted(plain + more, key=_order)


def find(documents: DataFrame, vocabulary: str = VOCABULARY, known: frozenset = frozenset(), most: float = MOST, most_letters: float = MOST_LETTERS) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) in code points, by start then kind."""

    def run(it):
        enc = encoding(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in it:
            texts = b.column("text")
            rows = [[{"kind": k, "start": x, "end": y} for x, y, k in spans_of(texts[i].as_py() or "", enc, known, most, most_letters)] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the plain spans, and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    plain = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(F.concat_ws(",", F.transform(plain, line)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform("spans", line)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
