"""SentencePiece encoding and decoding with N-best segmentation.

The lattice over a text has an edge for every vocabulary piece that occurs in
it, and byte-fallback edges for characters that are no piece. N best paths come
from a forward Viterbi pass, whose scores are the exact heuristic of a backward
A* search from the end of the text.

No piece runs over the start of a word (white space inside a piece only leads
it) or over a line feed, so the lattice of a text is the chain of the lattices
of its segments. Forward scores, best paths and each segment's loss to its
second path are computed for all distinct segments of a batch at once, with
numpy; the A* search runs on the at most N - 1 segments of a text with the
smallest loss, because any other one can take no part in the N best.

The model file is a BPE vocabulary whose scores are merge ranks. A piece of
rank r gets the score -ln(r + 2), in integer millionths, so sums and ties are
exact; a path's score is the sum. The tokenizer is read, never trained.

Defined cases: null and empty texts have no pieces, the score 0 and one path;
ties keep an arbitrary but fixed order; a text with fewer than N paths returns
what it has; U+2581 in a text is encoded by bytes, so decoding is exact.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import give_back, table
from rankloom.llm.wordhash import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.int64(-(1 << 60))
MICRO = 1_000_000
_SLOTS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: pieces (white space as plain spaces), scores, byte pieces and a hash table of both."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.byte, self.id, self.score = [], {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i).replace("▁", " ")
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = -round(math.log(2 + max(0.0, -sp.get_score(i))) * MICRO)
            self.text.append(piece)
        self.raw = [x.encode() for x in self.text]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        #: A byte costs more than any piece, so bytes serve characters without a piece only.
        self.byte_score = min(self.score.values()) - MICRO
        self.longest = max(map(len, self.id))
        if any(re.search(r"[^ ] |\n", p) and len(p) > 1 for p in self.id):
            raise ValueError("pieces run over word starts or line feeds; segments would not be exact")
        keys = np.array([_key(p) for p in self.id], dtype=np.uint64)
        self.slot_key, self.slot_id = _cuckoo(keys, np.array(list(self.id.values()), dtype=np.int64))
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[_mark(keys)] = True
        self.id_score = np.full(len(self.text), NONE)
        for p, i in self.id.items():
            self.id_score[i] = self.score[p]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose key is a piece, and the pieces' ids."""
        rows = np.flatnonzero(self.maybe[_mark(keys)])
        keys = keys[rows]
        a, b = _slots(keys)
        ids = np.where(self.slot_key[a] == keys, self.slot_id[a], np.where(self.slot_key[b] == keys, self.slot_id[b], -1))
        hit = ids >= 0
        return rows[hit], ids[hit]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = mix(keys)
    return (m >> np.uint64(44)).astype(np.int64), (m & np.uint64(_SLOTS - 1)).astype(np.int64)


def _mark(keys: np.ndarray) -> np.ndarray:
    return ((keys * _P) >> np.uint64(44)).astype(np.int64)


def _key(s: str) -> int:
    k = 0
    for c in s:
        k = (k * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return k


def _cuckoo(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key in one of its two slots."""
    slots = list(zip(*(x.tolist() for x in _slots(keys)), strict=True))
    held: dict[int, int] = {}
    for k in range(len(keys)):
        at = slots[k][0]
        for _ in range(200):
            k, held[at] = held.get(at, -1), k
            if k < 0:
                break
            at = slots[k][0] + slots[k][1] - at  # the other slot of the one that had to go
        else:
            raise ValueError("the piece table is too full")
    key, val = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int64)
    at, k = np.array(list(held)), np.array(list(held.values()))
    key[at], val[at] = keys[k], ids[k]
    return key, val


_SEGMENT = re.compile(r"\n| *[^ \n]+| +")


def segments(text: str | None) -> list[str]:
    """The text with the leading space that encoding adds, cut where no piece can span."""
    return _SEGMENT.findall(" " + text) if text else []


def best_paths(p: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """(score, loss to the second path, ids of the best path) of each segment."""
    score, loss, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        step = max(1, 400_000 // int(n * min(n, p.longest)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            chars = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            score[part], loss[part], got = _lattice(p, chars)
            for i, x in zip(part, got, strict=True):
                ids[i] = x
    return score, loss, ids


def _lattice(p: Pieces, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Forward and backward Viterbi over segments of one length."""
    m, n = chars.shape
    cols = np.ascontiguousarray(chars.T).astype(np.uint64) + np.uint64(1)
    edges = []  # (i, j, rows, ids, costs), by i then j
    fwd, via = np.full((n + 1, m), NONE), np.zeros((n + 1, m), np.int32)
    fwd[0] = 0
    for i in range(n):
        key = np.zeros(m, np.uint64)
        for j in range(i + 1, min(n, i + p.longest) + 1):
            key = key * _P + cols[j - 1]
            rows, ids = p.find(key)
            cost = p.id_score[ids]
            if j == i + 1 and len(rows) < m:  # a character that is no piece goes by its bytes
                own = np.full(m, -1)
                own[rows] = ids
                c = chars[:, i]
                by_bytes = (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)) * p.byte_score
                rows, ids, cost = np.arange(m), own, np.where(own >= 0, p.id_score[own], by_bytes)
            if not len(rows):
                continue
            edges.append((i, j, rows, ids, cost))
            total = fwd[i, rows] + cost
            better = total > fwd[j, rows]
            fwd[j, rows[better]], via[j, rows[better]] = total[better], i
    back = np.full((n + 1, m), NONE)
    back[n] = 0
    for i, j, rows, _, cost in reversed(edges):
        back[i, rows] = np.maximum(back[i, rows], cost + back[j, rows])
    ends = np.zeros((n + 1, m), bool)  # of the best path's pieces
    at, every = np.full(m, n), np.arange(m)
    for _ in range(n):
        ends[at, every] = True
        at = via[at, every]
        if not at.any():
            break
    loss = np.full(m, -NONE)
    pick = np.full((n + 1, m), -2)
    for i, j, rows, ids, cost in edges:
        best = ends[j, rows] & (via[j, rows] == i)
        pick[j, rows[best]] = ids[best]
        r = rows[~best]
        loss[r] = np.minimum(loss[r], fwd[n, r] - fwd[i, r] - cost[~best] - back[j, r])
    by_text = pick[1:].T
    on = by_text != -2
    flat, stops = by_text[on].astype(np.int32), np.cumsum(on.sum(axis=1))
    out = np.split(flat, stops[:-1])
    for k in np.flatnonzero((by_text == -1).any(axis=1)):
        out[k] = np.array([x for e in np.flatnonzero(on[k]) for x in ([by_text[k, e]] if by_text[k, e] >= 0 else [p.byte[b] for b in chr(chars[k, e]).encode("utf-8", "surrogatepass")])], np.int32)
    return fwd[n], loss, out


def n_best(p: Pieces, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best (score, ids) of one segment: forward Viterbi, then A* from its end."""
    size = len(word)
    fwd, into = [0] + [None] * size, [[] for _ in range(size + 1)]
    for i in range(size):
        for j in range(i + 1, min(size, i + p.longest) + 1):
            s = word[i:j]
            if s in p.id:
                into[j].append((i, p.score[s], (p.id[s],)))
                cost = p.score[s]
            elif j == i + 1:
                raw = s.encode("utf-8", "surrogatepass")
                cost = p.byte_score * len(raw)
                into[j].append((i, cost, tuple(p.byte[b] for b in raw)))
            else:
                continue
            if fwd[j] is None or fwd[i] + cost > fwd[j]:
                fwd[j] = fwd[i] + cost
    heap, turn, out = [(-fwd[size], 0, size, 0, None)], 0, []
    while heap and len(out) < n:
        f, _, at, tail, link = heapq.heappop(heap)
        if at == 0:
            ids = []
            while link:
                ids += link[0]
                link = link[1]
            out.append((-f, tuple(ids)))
            continue
        for i, cost, ids in into[at]:
            turn += 1
            heapq.heappush(heap, (-(fwd[i] + cost + tail), turn, i, tail + cost, (ids, link)))
    return out


@lru_cache(maxsize=40_000)
def _n_best_cached(path: str, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    return n_best(pieces(path), word, n)


def encode_texts(path: str, texts: list, n: int):
    """For each text: a list of at most n (score, ids array), best first, and whether the best decodes to the text."""
    p = pieces(path)
    cut = [segments(t) for t in texts]
    words = list(dict.fromkeys(chain.from_iterable(cut)))
    where = dict(zip(words, range(len(words)), strict=True))
    score, loss, ids = best_paths(p, words)
    bad = {i for i, w in enumerate(words) if _joined(p, ids[i].tolist()) != w.encode("utf-8", "surrogatepass")}
    for ws in cut:
        at = list(map(where.__getitem__, ws))
        best = [ids[i] for i in at]
        total = int(score[at].sum())
        paths = [(0, {})]
        for k in np.argsort(loss[at], kind="stable")[: n - 1]:  # the segments whose second path costs least
            own = _n_best_cached(path, ws[k], n)
            paths = heapq.nsmallest(n, ((d + own[0][0] - s, c | {int(k): alt} if r else c) for d, c in paths for r, (s, alt) in enumerate(own)), key=lambda x: x[0])
        rows = []
        for d, change in paths:
            if change:
                parts = list(best)
                for k, alt in change.items():
                    parts[k] = np.array(alt, np.int32)
            else:
                parts = best
            rows.append((total - d, np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        yield rows, bad.isdisjoint(at)


def _joined(p: Pieces, ids: list[int]) -> bytes:
    return b"".join([p.raw[i] for i in ids])


def decode_ids(path: str, ids) -> str:
    """The text of a piece sequence; bytes that are no UTF-8 become U+FFFD."""
    raw = _joined(pieces(path), list(ids))
    return raw.decode("utf-8", "replace")[1:]


def _sliced(batch: pa.RecordBatch, most_bytes: int = 8 << 20):
    """Runs of rows of about this many bytes of text."""
    size = batch.column("text").nbytes // max(1, batch.num_rows) + 1
    step = max(1, most_bytes // size)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode(documents: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """(doc_id, paths array<struct<score, ids>>): the n best encodings of each whole text."""

    def run(it):
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for b in it:
            for part in _sliced(b):
                rows = [[{"score": s / MICRO, "ids": i} for s, i in r] for r, _ in encode_texts(model, part.column("text").to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "paths"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, paths array<struct<score:double,ids:array<int>>>")


def decode(encoded: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of the id sequences in ``column`` as a further column ``decoded``."""

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decode_ids(model, x))

    return encoded.withColumn("decoded", text(F.col(column)))


def digests(documents: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_pieces, scores, ids_sha256, round_trip): per path the score and
    the hash of its ids (32-bit little-endian); whether the best path decodes to the text."""

    def run(it):
        for b in it:
            for part in _sliced(b):
                texts = part.column("text").to_pylist()
                out = {"n_chars": [], "n_pieces": [], "scores": [], "ids_sha256": [], "round_trip": []}
                for t, (rows, same) in zip(texts, encode_texts(model, texts, n), strict=True):
                    out["n_chars"].append(len(t or ""))
                    out["n_pieces"].append(len(rows[0][1]))
                    out["scores"].append([s / MICRO for s, _ in rows])
                    out["ids_sha256"].append([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for _, i in rows])
                    out["round_trip"].append(same)
                give_back()
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **out})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars bigint, n_pieces bigint, scores array<double>, ids_sha256 array<string>, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
