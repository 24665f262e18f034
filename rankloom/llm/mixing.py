"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are coded byte by byte, then one end symbol, each along a fixed binary
code (Huffman), so every symbol is a few bit predictions. For a bit, each
context (the last 1, 2, 3, 4 bytes of the word so far; the whole word so far) is
hashed with the code node to a slot that holds the log odds of the bit there.
A gate (code depth, kind of the previous byte, how often the two longest
contexts were seen) picks the weights that mix those log odds; a last stage
refines the mix by a table over (code node, mixed log odds). The sum of the
bits' costs is the text's log probability: symbols form a proper distribution,
the end symbol included.

A unit is a word with the white space behind it. What came before a unit enters
its contexts as a class (punctuation and line end of the unit before), so the
cost of a unit depends on its bytes and that class only: each distinct unit of
a run of texts is coded once, and its bits are counted once with its frequency.

Learning: the distinct units of all learning texts are grouped on the cluster,
with their frequency and the number of texts that have them. The code, the
slots, the mixing weights (Newton steps on sums over all bits) and the refining
table all come from every unit. What a unit predicts must be new to it, so while
weights and table are learned, its mean frequency in a text is taken off the
counts of its own bits. Only sums of a fixed size reach the driver. Scoring uses
the learned state as it is, so a score depends on neither order nor partition;
the costs of the most frequent units (a fixed number) are computed once.

The base score needs the corpus count of every token. The most frequent tokens
(a fixed number) are broadcast; the others are looked up by a join, summed by
document.

Defined cases: null texts are empty and have one token, the end; without
learning rows every count is 0 and the code is flat; repeated rows each give a
row; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import id_bucket, stored, table
from rankloom.llm.wordhash import powers, column_bytes, mix, word_hashes

END_TOKEN = 0x5DEECE66D1234567
END = 256
BITS = (14, 16, 18, 20, 21)  # log2 of the slots of each context
CHUNK = 1 << 15
ROUNDS, RIDGE = 2, 4.0  # Newton steps for the weights, and what their start is worth
START = 0.3  # the weight of each context before learning
FREQUENT, FREQUENT_UNITS = 400_000, 300_000
BITS_AT_ONCE = 1 << 20  # bytes of units that are coded at once
STEPS = 25  # of the refining table
LIMIT = 12.0
_SLICE = 4 << 20


class TokenTable:
    """A fixed set of 64-bit keys with their counts, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.counts = keys[order], counts[order]
        self.start = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ``keys``, -1 for those that are not here."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        slot = self._slot(keys)
        at, stop = self.start[slot], self.start[slot + 1]
        rows = np.flatnonzero(at < stop)
        while len(rows):
            hit = self.keys[at[rows]] == keys[rows]
            out[rows[hit]] = self.counts[at[rows[hit]]]
            rows = rows[~hit]
            at[rows] += 1
            rows = rows[at[rows] < stop[rows]]
        return out


class Code:
    """A binary code over 256 bytes and the end; node k of symbol s at depth d."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c), i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        left, right, name = {}, {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            left[name], right[name] = a[2], b[2]
            heapq.heappush(heap, (a[0] + b[0], name, name))
            name += 1
        paths = {}
        todo = [(heap[0][2], [])]
        while todo:
            node, path = todo.pop()
            if node < len(counts):
                paths[node] = path
            else:
                todo += [(left[node], [*path, (node - len(counts), 0)]), (right[node], [*path, (node - len(counts), 1)])]
        self.nodes = name - len(counts)
        self.length = np.array([len(paths[s]) for s in range(len(counts))], dtype=np.int16)
        self.node = np.zeros((self.length.max(), len(counts)), np.uint32)
        self.bit = np.zeros((self.length.max(), len(counts)), np.int8)
        for s, path in paths.items():
            for d, (node, bit) in enumerate(path):
                self.node[d, s], self.bit[d, s] = node, bit


_KIND = np.zeros(257, dtype=np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[97:123] = 2
_KIND[128:256] = 3
GATES = 8 * 4 * 4 * 4  # code depth, kind of byte, how often the two longest contexts were seen
_WORD_POWERS = np.cumprod(np.concatenate([[1], np.full(63, 0x9E3779B1)]).astype(np.uint32), dtype=np.uint32)


#: The class of a unit by the last byte of its word (and whether its white space starts a line).
_LAST = np.full(257, 4, dtype=np.int64)
_LAST[[33, 46, 63]] = 1
_LAST[[44, 58, 59]] = 2
_LAST[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 3
START_CLASS, CLASSES = 0, 16


def _plain_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, pos: np.ndarray) -> np.ndarray:
    val = (data.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[pos]
    return mix(np.add.reduceat(val, start) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def unit_keys(data: np.ndarray, off: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hashes of units that lie one after the other, none of them empty, as in ``Units``."""
    size = np.diff(off)
    pos = np.arange(size.sum()) - np.repeat(off[:-1] - off[0], size)
    return mix(_plain_keys(data[off[0] : off[-1]], off[:-1] - off[0], size, pos) + before.astype(np.uint64))


class Units:
    """The distinct units of a run of texts.

    sym, of: the units' bytes, one after the other, and the unit of each;
    before: the class before each unit; count: how often it occurs;
    text, unit: the text and the unit of every occurrence; last: the class
    at the end of every text; key: the units' hashes, ascending.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, first_class: int = START_CLASS):
        n = len(off) - 1
        self.last = np.full(n, first_class)
        if not len(data):
            self.sym = self.of = self.before = self.count = self.text = self.unit = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        space = _KIND[data] == 1
        begin = ~space
        begin[1:] &= space[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, len(data)))
        pos = np.arange(len(data)) - np.repeat(start, size)
        key = _plain_keys(data, start, size, pos)
        # The class that each unit leaves behind, from its last word byte and its first white space.
        words = np.add.reduceat((~space).astype(np.int64), start)
        end = start + np.maximum(words - 1, 0)
        gap = np.minimum(start + words, len(data) - 1)
        line = (words < size) & ((data[gap] == 10) | (data[gap] == 13))
        leaves = np.where(words > 0, _LAST[data[end]], 5) * 2 + line
        text = np.searchsorted(off, start, "right") - 1
        before = np.empty(len(start), np.int64)
        before[1:] = leaves[:-1]
        lead = np.ones(len(start), bool)
        lead[1:] = text[1:] != text[:-1]
        before[lead] = first_class
        ends = np.flatnonzero(np.append(lead[1:], True))
        self.last[text[ends]] = leaves[ends]
        self.key, first, self.unit, self.count = np.unique(mix(key + before.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
        self.text, self.before = text, before[first]
        size = size[first]
        self.of = np.repeat(np.arange(len(first)), size)
        self.sym = data[np.arange(len(self.of)) - np.repeat(np.cumsum(size) - size - start[first], size)].astype(np.int64)

    def texts(self) -> np.ndarray:
        """In how many texts each unit occurs."""
        pairs = np.sort(self.unit * (len(self.last) + 1) + self.text)
        new = np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]
        return np.bincount(pairs[new] // (len(self.last) + 1), minlength=len(self.before))


def runs(col: pa.Array):
    """(first row, Units, whether a text of the run goes on in the next one): whole texts in runs of rows.

    A very long text is a run of its own, in pieces cut where a unit starts.
    """
    data, off = column_bytes(col)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + _SLICE, "right")) - 1)
        lo, hi = int(off[row]), int(off[stop])
        if stop == row + 1 and hi - lo > 2 * _SLICE:
            at, cls = lo, START_CLASS
            while at < hi:
                end = min(at + _SLICE, hi)
                while end < hi:
                    near = _KIND[data[end - 1 : end + _SLICE]] == 1
                    begin = np.flatnonzero(near[:-1] & ~near[1:])
                    end = min(end + int(begin[0]) if len(begin) else end + _SLICE, hi)
                    if len(begin):
                        break
                u = Units(data[at:end], np.array([0, end - at]), cls)
                cls, at = int(u.last[0]), end
                yield row, u, at < hi
        else:
            yield row, Units(data[lo:hi], off[row : stop + 1] - lo), False
        row = stop


def contexts(sym: np.ndarray, of: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A 32-bit hash of each context before every byte of every unit, and the kind of the byte before it."""
    n = len(sym)
    first = np.ones(n, bool)
    first[1:] = of[1:] != of[:-1]
    age = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    cls = (before[of] + 300).astype(np.uint32)
    s = (sym + 1).astype(np.uint32)
    out, h = [], np.zeros(n, np.uint32)
    prev = np.zeros(n, np.int64)
    prev[1:] = sym[:-1]
    kind = np.where(first, 1, _KIND[prev])
    for k in range(1, 5):
        last = np.zeros(n, np.uint32)
        last[k:] = s[:-k]
        last = np.where(age < k, cls, last)
        h = h * np.uint32(0x01000193) + last * np.uint32(0x85EBCA6B) + np.uint32(k)
        out.append(h)
    part = s * _WORD_POWERS[age & 63]
    total = np.cumsum(part, dtype=np.uint32) - part
    out.append((total - total[np.arange(n) - age]) * np.uint32(0xC2B2AE35) + cls)
    return out, kind


def ends(last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The end symbols of texts as units: (sym, of, before)."""
    return np.full(len(last), END, np.int64), np.arange(len(last)), last


def slots_of(ctx: np.ndarray, node: np.ndarray, which: int) -> np.ndarray:
    h = (ctx ^ (node * np.uint32(0x9E3779B1))) * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS[which])).astype(np.int64)


def bits_of(code: Code, sym: np.ndarray):
    """By code depth: (depth, symbols that have a bit there, its node, the bit)."""
    at = np.arange(len(sym))
    for d in range(len(code.node)):
        at = at[code.length[sym[at]] > d]
        if not len(at):
            return
        yield d, at, code.node[d, sym[at]], code.bit[d, sym[at]]


def distinct_units(rows: DataFrame) -> DataFrame:
    """(unit, before, n, texts): the distinct units of all texts, how often they occur and in how many texts; an end is an empty unit."""

    def run(it):
        for b in it:
            for _, u, more in runs(b.column("text")):
                size = np.bincount(u.of, minlength=len(u.before))
                at = np.append(0, np.cumsum(size)).astype(np.int32)
                cls = np.zeros(0, np.int64) if more else np.unique(u.last)
                n = np.zeros(0, np.int64) if more else np.bincount(u.last)[cls]
                at = np.append(at, np.full(len(cls), at[-1], np.int32))
                units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(u.sym.astype(np.uint8))])
                before, count, texts = np.append(u.before, cls), np.append(u.count, n), np.append(u.texts(), n)
                whole = pa.table({"unit": units, "before": pa.array(before, pa.int32()), "n": pa.array(count, pa.int64()), "texts": pa.array(texts, pa.int64())})
                yield from whole.to_batches(max_chunksize=1 << 16)

    found = rows.select("text").mapInArrow(run, "unit binary, before int, n long, texts long")
    return found.groupBy("unit", "before").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def pieces(batch: pa.RecordBatch):
    """(sym, of, before, n, less) of the units of a batch, a bounded number of bytes at a time; ``less`` is a unit's mean frequency in the texts that have it."""
    col = batch.column("unit")
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    before, n, texts = (batch.column(x).to_numpy().astype(np.int64) for x in ("before", "n", "texts"))
    less = (n / np.maximum(texts, 1)).astype(np.float32)
    end = off[1:] == off[:-1]
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BITS_AT_ONCE, "right")) - 1)
        plain, last = lo + np.flatnonzero(~end[lo:hi]), lo + np.flatnonzero(end[lo:hi])
        if len(plain):
            sym = data[off[lo] : off[hi]].astype(np.int64)
            yield sym, np.repeat(np.arange(len(plain)), off[plain + 1] - off[plain]), before[plain], n[plain], less[plain]
        if len(last):
            yield *ends(before[last]), n[last], less[last]
        lo = hi


def symbol_counts(units: DataFrame) -> np.ndarray:
    """How often each byte and the end occur."""

    def run(it):
        seen = np.zeros(257, np.int64)
        for b in it:
            for sym, of, _, n, _ in pieces(b):
                seen += np.rint(np.bincount(sym, weights=n[of], minlength=257)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sym": np.arange(257, dtype=np.int32), "n": seen})

    out = np.zeros(257, np.int64)
    for r in units.mapInArrow(run, "sym int, n long").groupBy("sym").agg(F.sum("n").alias("n")).collect():  # 257 symbols
        out[r.sym] = r.n
    return out


def slot_counts(units: DataFrame, code: Code) -> list[np.ndarray]:
    """[slot, bit] counts of each context over ``units``, a fixed number of them."""
    sc = units.sparkSession.sparkContext
    held = sc.broadcast(code)

    def count(it):
        total = [np.zeros(2 << b, np.int64) for b in BITS]
        for batch in it:
            for sym, of, before, n, _ in pieces(batch):
                ctx, _ = contexts(sym, of, before)
                for _, at, node, bit in bits_of(held.value, sym):
                    times = n[of[at]]
                    for c, t in enumerate(total):
                        np.add.at(t, slots_of(ctx[c][at], node, c) * 2 + bit, times)
        for c, t in enumerate(total):
            for k in range(0, len(t), CHUNK):
                if t[k : k + CHUNK].any():
                    yield pa.RecordBatch.from_pydict({"context": pa.array([c], pa.int32()), "at": pa.array([k], pa.int32()), "counts": [zlib.compress(t[k : k + CHUNK].tobytes(), 1)]})

    def add(it):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in it:
            for c, k, raw in zip(*(b.column(x).to_pylist() for x in ("context", "at", "counts")), strict=True):
                own = np.frombuffer(zlib.decompress(raw), np.int64)
                total[c, k] = total[c, k] + own if (c, k) in total else own
        for (c, k), own in total.items():  # beyond what an int holds, a count says no more
            own = np.minimum(own, np.iinfo(np.int32).max).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"context": pa.array([c], pa.int32()), "at": pa.array([k], pa.int32()), "counts": [own.tobytes()]})

    kind = "context int, at int, counts binary"
    summed = units.mapInArrow(count, kind).repartition("context", "at").mapInArrow(add, kind)
    out = [np.zeros(2 << b, np.int32) for b in BITS]
    for r in summed.collect():  # the slots: their number is fixed
        own = np.frombuffer(r.counts, np.int32)
        out[r.context][r.at : r.at + len(own)] = own
    return [t.reshape(-1, 2) for t in out]


_PAIRS = [(i, j) for i in range(len(BITS) + 1) for j in range(i, len(BITS) + 1)]
SUMS = len(BITS) + 1 + len(_PAIRS)  # of a gate: its gradient and the upper half of its second derivatives


def _steps(z: np.ndarray) -> np.ndarray:
    return np.rint((z + LIMIT) * ((STEPS - 1) / (2 * LIMIT))).astype(np.int64)


class Mixer:
    """Slots, mixing weights and the refining table, with what scoring needs of them."""

    def __init__(self, code: Code, counts: list[np.ndarray]):
        self.code = code
        self.counts = [t.astype(np.float32) for t in counts]  # until all is learned
        self.weights = np.full((GATES, len(BITS) + 1), START, np.float32)
        self.weights[:, -1] = 0
        self.refine = np.tile(np.linspace(-LIMIT, LIMIT, STEPS), (code.nodes, 1)).astype(np.float32)
        steps = np.arange(-LIMIT * 128, LIMIT * 128 + 1) / 128
        self.cost = np.log1p(np.exp(steps)).astype(np.float32)  # of a bit of 0 at these log odds
        self.slots = [np.log((t[:, 1] + 0.4) / (t[:, 0] + 0.4)).astype(np.float32) for t in counts]
        self.seen = [np.searchsorted([1, 4, 32], t.sum(axis=1), "right").astype(np.int8) for t in counts[-2:]]
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.float32)  # hashes of frequent units, ascending, and their costs

    def new_to(self, sym, of, before, n, less):
        """By code depth: (log odds of each context and 1, gate, node, bit, frequency) of the units' bits, as if ``less`` occurrences of them were not counted."""
        ctx, kind = contexts(sym, of, before)
        for d, at, node, bit in bits_of(self.code, sym):
            off = less[of[at]]
            x, seen = np.ones((len(BITS) + 1, len(at)), np.float32), []
            for c, t in enumerate(self.counts):
                both = t[slots_of(ctx[c][at], node, c)]
                c1, c0 = np.maximum(both[:, 1] - off * bit, 0), np.maximum(both[:, 0] - off * (1 - bit), 0)
                x[c] = np.log((c1 + np.float32(0.4)) / (c0 + np.float32(0.4)))
                if c >= len(BITS) - 2:
                    seen.append(np.searchsorted(np.array([1, 4, 32], np.float32), np.rint(c0 + c1), "right"))
            yield x, (seen[0] * 4 + seen[1]) * 32 + (min(d, 7) * 4 + kind[at]), node.astype(np.int64), bit, n[of[at]].astype(np.float64)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for own, w in zip(x, self.weights.T, strict=True):
            z += w[gate] * own
        return np.clip(z, -LIMIT, LIMIT)

    def sums(self, *units) -> np.ndarray:
        """[gate, SUMS] first and second derivatives of the units' cost at the present weights."""
        out = np.zeros((GATES, SUMS))
        for x, gate, _, bit, n in self.new_to(*units):
            p = 1 / (1 + np.exp(-self.mixed(x, gate)))
            err, v = (p - bit) * n, p * (1 - p) * n
            for i, own in enumerate(x):
                out[:, i] += np.bincount(gate, weights=err * own, minlength=GATES)
                some = v * own
                for k, (a, b) in enumerate(_PAIRS):
                    if a == i:
                        out[:, len(x) + k] += np.bincount(gate, weights=some * x[b], minlength=GATES)
        return out

    def step(self, sums: np.ndarray) -> None:
        """One Newton step of every gate's weights; a gate without bits keeps its start."""
        m = len(BITS) + 1
        start = np.append(np.full(m - 1, START), 0.0)
        w = self.weights.astype(np.float64)
        h = np.zeros((GATES, m, m))
        for k, (a, b) in enumerate(_PAIRS):
            h[:, a, b] = h[:, b, a] = sums[:, m + k]
        h += np.eye(m) * RIDGE
        change = np.linalg.solve(h, (sums[:, :m] + RIDGE * (w - start))[..., None])[..., 0]
        self.weights = np.round(w - np.clip(change, -1, 1), 4).astype(np.float32)

    def cells(self, *units) -> np.ndarray:
        """[2, cell] how often the bit is 1, and how often it is met, by (code node, step of the mixed log odds)."""
        out = np.zeros((2, self.code.nodes * STEPS))
        for x, gate, node, bit, n in self.new_to(*units):
            cell = node * STEPS + _steps(self.mixed(x, gate))
            out[0] += np.bincount(cell, weights=n * bit, minlength=out.shape[1])
            out[1] += np.bincount(cell, weights=n, minlength=out.shape[1])
        return out

    def calibrate(self, cells: np.ndarray) -> None:
        """The refining table; each cell starts at its own log odds, worth 8 observations."""
        ones, n = cells
        prior = 1 / (1 + np.exp(-np.tile(np.linspace(-LIMIT, LIMIT, STEPS), self.code.nodes)))
        p = np.clip((ones + 8 * prior) / (n + 8), 1e-6, 1 - 1e-6)
        self.refine = np.round(np.log(p / (1 - p)), 4).reshape(self.code.nodes, STEPS).astype(np.float32)

    def learn(self, texts: list[str]) -> None:
        """Weights and refining table from ``texts`` that the slots have not counted."""
        parts = []
        for _, u, _ in runs(pa.array(texts, pa.string())):
            for sym, of, before, n in ((u.sym, u.of, u.before, u.count), (*ends(u.last), np.ones(len(u.last), np.int64))):
                parts.append((sym, of, before, n, np.zeros(len(before), np.float32)))
        if parts:
            for _ in range(ROUNDS):
                self.step(sum(self.sums(*p) for p in parts))
            self.calibrate(sum(self.cells(*p) for p in parts))

    def inputs(self, ctx, at, node, d: int, kind) -> tuple[list[np.ndarray], np.ndarray]:
        """The log odds of each context and the gate, for bits at one code depth."""
        slot = [slots_of(x[at], node, c) for c, x in enumerate(ctx)]
        gate = (self.seen[0][slot[-2]].astype(np.int64) * 4 + self.seen[1][slot[-1]]) * 32 + (min(d, 7) * 4 + kind[at])
        return [t[x] for t, x in zip(self.slots, slot, strict=True)], gate

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        z = np.clip(z, -LIMIT, LIMIT)
        return 0.5 * (z + self.refine[node, _steps(z)])

    def costs(self, sym: np.ndarray, of: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The cost in nats of each unit."""
        ctx, kind = contexts(sym, of, before)
        total = np.zeros(len(sym), np.float32)
        for d, at, node, bit in bits_of(self.code, sym):
            own, gate = self.inputs(ctx, at, node, d, kind)
            z = self.weights[gate, len(BITS)]
            for c, x in enumerate(own):
                z = z + self.weights[gate, c] * x
            z = self.refined(z, node)
            z = np.clip(np.where(bit == 1, -z, z), -LIMIT, LIMIT)
            total[at] += self.cost[np.rint((z + LIMIT) * 128).astype(np.int64)]
        return np.bincount(of, weights=total, minlength=len(before))

    def unit_costs(self, u: Units) -> np.ndarray:
        """The cost of each unit of a run; only those that are not known are coded."""
        keys, costs = self.known
        out = np.zeros(len(u.key))
        new = np.ones(len(u.key), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, u.key), len(keys) - 1)
            new = keys[at] != u.key
            out[~new] = costs[at[~new]]
        if new.any():
            own = new[u.of]
            out[new] = self.costs(u.sym[own], (np.cumsum(new) - 1)[u.of[own]], u.before[new])
        return out

    def log10(self, col: pa.Array) -> np.ndarray:
        """log10 of the probability of each text."""
        out = np.zeros(len(col))
        last = self.costs(*ends(np.arange(CLASSES)))
        for row, u, more in runs(col):
            found = np.bincount(u.text, weights=self.unit_costs(u)[u.unit], minlength=len(u.last)) if len(u.sym) else np.zeros(len(u.last))
            if not more:
                found = found + last[u.last]
            out[row : row + len(found)] -= found / np.log(10)
        return out


def token_counts(rows: DataFrame) -> DataFrame:
    """(h, c): the corpus count of each token of the texts, ends included."""

    def run(it):
        held, size = [], 0
        for b in it:
            held.append(np.full(b.num_rows, END_TOKEN, np.uint64))
            for _, _, h, _ in word_hashes(b.column("text")):
                held.append(h)
                size += len(h)
                if size > 2_000_000:
                    yield _summed(held)
                    held, size = [], 0
        if held:
            yield _summed(held)

    def _summed(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)})

    return rows.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _summed(units: DataFrame, mixer: Mixer, of, shape: tuple[int, int]) -> np.ndarray:
    """``of(mixer, *units)``, an array of a fixed shape, summed over all units on the cluster."""
    held = units.sparkSession.sparkContext.broadcast(mixer)

    def run(it):
        total = np.zeros(shape)
        for b in it:
            for p in pieces(b):
                total += of(held.value, *p)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "x": total.ravel()[at]})

    out = np.zeros(shape)
    found = units.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # a row a place of the array
    out.ravel()[found.column("at").to_numpy()] = found.column("x").to_numpy()
    held.destroy()
    return out


def fit(learning: DataFrame, frequent: int = FREQUENT_UNITS) -> Mixer:
    """A mixer from all texts of ``learning`` (text)."""
    units = stored(distinct_units(learning), "mixing-units")
    code = Code(symbol_counts(units) * 4 + 1)
    mixer = Mixer(code, slot_counts(units, code))
    for _ in range(ROUNDS):
        mixer.step(_summed(units, mixer, Mixer.sums, (GATES, SUMS)))
    mixer.calibrate(_summed(units, mixer, Mixer.cells, (2, code.nodes * STEPS)))
    mixer.counts = []
    held = units.sparkSession.sparkContext.broadcast(mixer)

    def known(it):
        for b in it:
            for lo in range(0, b.num_rows, 1 << 14):
                some = b.slice(lo, 1 << 14)
                data, off = column_bytes(some.column("unit").cast(pa.large_binary()).view(pa.large_string()))
                sym, of = data[off[0] : off[-1]].astype(np.int64), np.repeat(np.arange(some.num_rows), np.diff(off))
                before = some.column("before").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": unit_keys(data, off, before).view(np.int64), "cost": held.value.costs(sym, of, before)})

    top = units.filter(F.length("unit") > 0).orderBy(F.desc("n"), "unit", "before").limit(frequent).select("unit", "before")
    found = top.mapInArrow(known, "key long, cost double").toArrow()  # at most `frequent` rows
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    mixer.known = keys[order], found.column("cost").to_numpy()[order].astype(np.float32)
    return mixer


def score(documents: DataFrame, modulus: int = 10, held_out: int = 0, frequent: int = FREQUENT) -> DataFrame:
    """One row per document row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), modulus) == held_out)
    learning = docs.filter(~F.col("held_out"))
    counts = stored(token_counts(learning), "mixing")
    end_h = int(np.uint64(END_TOKEN).astype(np.int64))
    ends = counts.filter(F.col("h") == end_h).first()
    end = ends.c if ends else 0
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(frequent).toArrow()  # at most `frequent` rows
    tokens = TokenTable(top.column("h").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64))
    below = 0 if v <= frequent else None
    held = spark.sparkContext.broadcast((fit(learning), tokens))
    scale = float(np.log10(n + 0.1 * (v + 1)))

    def run(it):
        mixer, tokens = held.value
        part = TaskContext.get().partitionId()
        turn = 0
        for b in it:
            log10 = mixer.log10(b.column("text"))
            _, off = column_bytes(b.column("text"))
            cols = {k: np.zeros(b.num_rows) for k in ("base", "n_tokens", "n_known")}
            rare, rare_n = [], []
            for row, stop, h, size in word_hashes(b.column("text")):
                h = h.view(np.int64)
                of = np.repeat(np.arange(stop - row), size)
                c = tokens.find(h)
                hit = c >= 0
                cols["base"][row:stop] = np.bincount(of[hit], weights=np.log10(c[hit] + 0.1) - scale, minlength=stop - row)
                cols["n_tokens"][row:stop] = size
                cols["n_known"][row:stop] = np.bincount(of[hit & (c > 0)], minlength=stop - row)
                for i in range(stop - row):
                    lo, hi = np.searchsorted(of, (i, i + 1))
                    x, k = np.unique(h[lo:hi][~hit[lo:hi]], return_counts=True)
                    rare.append(x)
                    rare_n.append(k.astype(np.int32))
            cols["base"] += np.log10(end + 0.1) - scale
            cols["n_tokens"] += 1
            cols["n_known"] += end > 0
            rid = (np.int64(part) << 40) + turn + np.arange(b.num_rows)
            turn += b.num_rows
            yield pa.RecordBatch.from_pydict({
                "rid": rid, "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_bytes": np.diff(off), "log10": log10, "base": cols["base"],
                "n_tokens": cols["n_tokens"].astype(np.int64), "n_known": cols["n_known"].astype(np.int64),
                "rare": pa.array(rare, pa.list_(pa.int64())), "rare_n": pa.array(rare_n, pa.list_(pa.int32())),
            })

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, n_bytes bigint, log10 double, base double, n_tokens bigint, n_known bigint, rare array<bigint>, rare_n array<int>")
    rows = stored(rows, "mixing")
    lost = rows.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("rid", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("k"))
    lost = lost.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0))) if below is None else lost.withColumn("c", F.lit(0).cast("bigint"))
    more = lost.groupBy("rid").agg(
        F.sum(F.col("k") * (F.log10(F.col("c") + F.lit(0.1)) - F.lit(scale))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
    )
    out = rows.drop("rare", "rare_n").join(more, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.col("log10").alias("score"),
        (-F.col("log10") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
