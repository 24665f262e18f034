"""Personal data: plain patterns plus offset-preserving deobfuscation.

Plain spans are found in the text as it is. Then a chain of small transducers
rewrites disguises and keeps, for every character it writes, the source span it
came from: homoglyphs and full-width forms to ASCII, invisible characters to
nothing, "at" / "dot" / "plus" disguises to their signs, bracketed or bare, also
mixed with real signs, and runs of spelled digits, numerals and "dot" to digits.
A full stop between the digits of such a run may part them or not, so both
readings are searched. The same detectors run on each rewritten text, and their
length checks alone decide. Their spans are mapped back to code points of the
source. A span counts as added if it holds something rewritten and lies in no
plain span and no longer added span of its kind; plain spans always stay.

All scans are linear in the text, also for long runs of digits or letters.

Defined cases: null and empty texts have no spans; repeated rows each give a
row; further columns are ignored by :func:`find`, kept by :func:`redact`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters that look like ASCII ones (Cyrillic, Greek, signs).
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " ",
}
_HIDDEN = "­​‌‍⁠﻿"
_GLYPHS = {ord(k): v for k, v in _LOOKALIKES.items()}
_GLYPHS |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other decimal digits
    _GLYPHS |= {_zero + i: str(i) for i in range(10)}
_GLYPHS |= {ord(c): "" for c in _HIDDEN}
_GLYPH = re.compile("[" + "".join(map(re.escape, map(chr, _GLYPHS))) + "]")

# Digits and signs in English, French, German and Spanish.
_NUMBER = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_PLUS = ("plus", "más")
_WORD = "(?:" + "|".join(sorted(_NUMBER, key=len, reverse=True)) + ")"
_DIGIT = rf"(?:{_WORD}|[0-9]++)(?![A-Za-zÀ-ÿ])"
_GAP = r"[\s,.()-]{1,4}"
_POINT = "(?:dot|point|punkt|punto)"
_AT_WORD = "(?:at|arroba|arobase)"
#: Digits, spelled or not, with "dot" or full stops between them and "plus" before them.
_SPELLED = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9])(?:(?:{'|'.join(_PLUS)}){_GAP})?{_DIGIT}(?:{_GAP}(?:{_POINT}{_GAP})?{_DIGIT})++", re.I)
_TOKEN = re.compile(rf"{'|'.join(_PLUS)}|{_POINT}|{_WORD}|[0-9]++", re.I)
_OPEN, _CLOSE = r"(?:(?<!\s)\s{1,4})?[\[({<]\s{0,4}", r"\s{0,4}[\])}>]\s{0,4}"
_SIGN = re.compile(rf"{_OPEN}(?:({_AT_WORD}|@)|({_POINT}|\.)){_CLOSE}", re.I)
#: name at host dot tld: a bare "at" counts only before a tail with a disguised dot.
_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:\s++{_AT_WORD}\s++|\s*+@\s*+)(?=[A-Za-z0-9-])", re.I)
_LABEL = r"[A-Za-z0-9-]++"
_TAIL = re.compile(rf"{_LABEL}(?:(?:\s++{_POINT}\s++|\.){_LABEL})++", re.I)
_DOT = re.compile(rf"(\s++{_POINT}\s++|\.)({_LABEL})", re.I)
_TLD = re.compile(r"[A-Za-z]{2,24}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = t.find("@", max(at + 1, end))
    return out


def plain_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """The leftmost non-overlapping matches of each kind that pass its check."""
    out = {"email": _emails(t) if "@" in t else [], "ip": [], "card": [], "phone": []}
    for m in _DOTTED.finditer(t):
        if m.end() - m.start() >= 7 and "." in m[0]:
            parts = [(g.start(), g.end()) for g in _GROUP.finditer(t, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(len(part := t[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in parts[i : i + 4]):
                    out["ip"].append((parts[i][0], parts[i + 3][1]))
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and _luhn(d):
                out["card"].append(m.span())
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out["phone"].append(m.span())
    return out


class _Tape:
    """A text with the source span of each of its characters, rewritten in runs."""

    def __init__(self, text: str, runs: list | None = None):
        self.text = text
        self.runs = runs or [(0, 0, len(text), False)]  # (start here, source start, source end, rewritten); a kept run is one to one
        self.starts = [r[0] for r in self.runs]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of text[start:end], and whether part of it was rewritten."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first, last = self.runs[i], self.runs[j]
        a = first[1] if first[3] else first[1] + start - first[0]
        b = last[2] if last[3] else last[1] + end - last[0]
        return a, b, b - a != end - start or any(r[3] for r in self.runs[i : j + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given, ordered, non-overlapping spans of the text."""
        if not edits:
            return
        text, runs, at, here = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal here
            while a < b:
                i = bisect_right(self.starts, a) - 1
                stop = min(b, self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.text))
                r = self.runs[i]
                runs.append((here, r[1], r[2], True) if r[3] else (here, r[1] + a - r[0], r[1] + stop - r[0], False))
                text.append(self.text[a:stop])
                here, a = here + stop - a, stop

        for a, b, new in edits:
            keep(at, a)
            if new:
                src = self.source(a, b)
                runs.append((here, src[0], src[1], True))
                text.append(new)
                here += len(new)
            at = b
        keep(at, len(self.text))
        self.text, self.runs = "".join(text), runs or [(0, 0, 0, False)]
        self.starts = [r[0] for r in self.runs]


def _glyphs(t: str) -> list[tuple[int, int, str]]:
    return [] if t.isascii() or _GLYPH_SET.isdisjoint(t) else [(m.start(), m.end(), _GLYPHS[ord(m[0])]) for m in _GLYPH.finditer(t)]


def _spelled(t: str, stops: bool) -> list[tuple[int, int, str]]:
    """Runs of digits as figures; with ``stops``, a full stop between two digits stays one."""
    out = []
    for m in _SPELLED.finditer(t):
        tokens = list(_TOKEN.finditer(t, m.start(), m.end()))
        if all(w[0][0].isdigit() for w in tokens):
            continue
        for k, w in enumerate(tokens):  # a digit each, so that every digit keeps its own source span
            name = w[0].lower()
            if not name[0].isdigit():
                out.append((w.start(), w.end(), "+" if name in _PLUS else _NUMBER.get(name, ".")))
            if k + 1 < len(tokens):
                gap, after = t[w.end() : tokens[k + 1].start()], tokens[k + 1][0].lower()
                digits = all(x in _NUMBER or x[0].isdigit() for x in (name, after))
                out.append((w.end(), tokens[k + 1].start(), "." if stops and digits and "." in gap else ""))
    return out


def _signs(t: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _SIGN.finditer(t)]


def _bare(tape: _Tape) -> list[tuple[int, int, str]]:
    t, out = tape.text, []
    written = {r[0] for r in tape.runs if r[3] and r[2] - r[1] > 1}  # signs that were more than one character
    for m in _AT.finditer(t):
        tail = _TAIL.match(t, m.end())
        dots = list(_DOT.finditer(t, m.end(), tail.end())) if tail else []
        while dots and not _TLD.fullmatch(dots[-1][2]):
            dots.pop()
        if any(d[1] != "." or d.start() in written for d in dots):
            out.append((m.start(), m.end(), "@"))
            out += [(d.start(1), d.end(1), ".") for d in dots if d[1] != "."]
    return [(a, b, new) for a, b, new in out if t[a:b] != new]


_POINTS = ("dot", "point", "punkt", "punto")
_GLYPH_SET = frozenset(map(chr, _GLYPHS))


def _readings(t: str) -> list[_Tape]:
    """The rewritten forms of a text."""
    tape = _Tape(t)
    tape.rewrite(_glyphs(tape.text))
    low = tape.text.lower()
    if any(c in tape.text for c in "[({<"):
        tape.rewrite(_signs(tape.text))
    if any(w in low for w in _POINTS) or len(tape.runs) > 1:
        tape.rewrite(_bare(tape))
    out = [tape]
    if any(w in low for w in _NUMBER):
        edits = [_spelled(tape.text, stops) for stops in (False, True)]
        for e in edits if edits[0] != edits[1] else edits[:1]:
            if e:
                out.append(_Tape(tape.text, tape.runs))
                out[-1].rewrite(e)
    return [x for x in out if len(x.runs) > 1 or x.runs[0][3]]


def added_spans(t: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that appear once the text's disguises are undone."""
    found = {k: set() for k in KINDS}
    for tape in _readings(t):
        for kind, spans in plain_spans(tape.text).items():
            for a, b in spans:
                start, end, rewritten = tape.source(a, b)
                if rewritten:
                    found[kind].add((start, end))
    out = {}
    for kind, spans in found.items():
        own, reach = [], -1
        for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
            if end > reach:
                own.append((start, end))
                reach = end
        out[kind] = _outside(own, plain[kind])
    return out


def _outside(spans: list[tuple[int, int]], plain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in none of ``plain``, which is ordered and does not overlap."""
    starts = [a for a, _ in plain]
    return [(a, b) for a, b in spans if not (i := bisect_right(starts, a)) or plain[i - 1][1] < b]


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, plain>>) in code points, by kind then start."""

    def run(it):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))
        for b in it:
            rows = []
            for at in range(b.num_rows):
                t = b.column("text")[at].as_py() or ""
                plain = plain_spans(t)
                more = added_spans(t, plain)
                rows.append([{"kind": k, "start": x, "end": y, "plain": p} for k in KINDS for x, y, p in sorted([(x, y, True) for x, y in plain[k]] + [(x, y, False) for x, y in more[k]])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,plain:boolean>>")


def redacted(t: str) -> str:
    """``t`` with every span replaced by its kind in angle brackets; overlapping spans are one."""
    plain = plain_spans(t)
    more = added_spans(t, plain)
    spans = sorted((a, b, k) for k in KINDS for a, b in plain[k] + more[k])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [t[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """The same rows with personal data in ``text`` replaced; a null text stays null."""

    def run(it):
        for b in it:
            at = b.schema.get_field_index("text")
            new = pa.array([None if x is None else redacted(x) for x in b.column("text").to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return documents.mapInArrow(run, documents.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the plain spans, and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    plain = F.filter("spans", lambda s: s["plain"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(F.concat_ws(",", F.transform(plain, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"), F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_added"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
