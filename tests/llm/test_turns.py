"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest

from rankloom.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"


def legal(initials):
    if not initials:
        return True
    rest = initials[1:] if initials[0] == "s" else initials
    return len(rest) >= 2 and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest))


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired lines) over every string of edits with at most two insertions in a place."""
    wrong = faults(rows)
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(w in ("blank", "duplicate") and e != "D" for w, e in zip(wrong, edits)):
            continue
        for put in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(put, (*edits, "")))
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in audit) + sum(w == "truncated" and e != "D" for w, e in zip(wrong, edits))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(c in "IR" for c in audit)):
                free, row, lines = iter(roles), iter(rows), []
                for c in audit:
                    role, text = (next(free), "") if c == "I" else next(row)
                    if c == "R":
                        role = next(free)
                    if c != "D":
                        lines.append((role, text))
                if legal("".join(r[:1] or "?" for r, _ in lines)):
                    best = cost, audit, lines
                    break
    return best


def spoiled(rows):
    """The damaged rows of each conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        got = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        got.extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, g in out.items()}


def expected(rows):
    out = {}
    for conv, got in spoiled(rows).items():
        own = [(r, t) for _, r, t in got]
        cost, audit = turns.best_edits(turns.codes_of(got))
        wrong = faults(own)
        who = [r[:1] for r, _ in own]
        at = {t for t, _, _ in got if t is not None}
        lines = [f"{r}:{t}" for _, r, t in turns.edited(audit, iter(own))]
        out[conv] = (max(at) - min(at) + 1 - len(at) if at else 0, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"),
                     sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(who, who[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(rng, n, roles=("system", "user", "user", "assistant", "assistant", "tool", "")):
    return [(rng.choice(roles), rng.choice(["Hi.", "Yes", "so it is!", " \t", "No.", "really?  "])) for _ in range(n)]


def test_search_is_brute_force():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4):
        for _ in range((1, 40, 60, 60, 25)[n]):
            rows = talk(rng, n)
            cost, audit, lines = brute(rows)
            codes = turns.codes_of([(0, r, t) for r, t in rows])
            assert turns.best_edits(codes) == (cost, audit), rows
            assert [(r, t) for _, r, t in turns.edited(audit, iter(rows))] == lines


def test_long_search_is_exact_and_linear():
    rng = random.Random(6)
    codes = turns.codes_of([(0, r, t + str(i)) for i, (r, t) in enumerate(talk(rng, 3000))])
    cost, audit = turns.search(codes, turns.START, turns.ENDS)
    assert sum(c != "I" for c in audit) == 3000
    # Cost alone, by dynamic programming forwards.
    now = [0, turns.FAR, turns.FAR, turns.FAR]
    for c in codes:
        new = [turns.FAR] * 4
        for q in range(4):
            for _, more, to in turns.EDITS[c][q]:
                new[to] = min(new[to], now[q] + more)
        now = new
    assert cost == min(a + b for a, b in zip(now, turns.ENDS))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations():
    rng = random.Random(7)
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(talk(rng, rng.randint(1, 9)))]
    rows += [(70, None, "user", "Hi."), (70, None, "assistant", "Yes."), (70, 5, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, "c")]
    rows += [(80, i // 3, *x) for i, x in enumerate(talk(rng, 300))]  # ties and many repeats
    rows += [(90, 3, "user", "Hi.")] * 7 + [(91, t, "user", None) for t in range(4)]
    rows += [(92, t, ("user", "assistant")[t % 2], "word " * 60000 + str(t)) for t in range(3)]
    return rows


@pytest.mark.parametrize("limits", [(4096, 16 << 20, 4096), (5, 16 << 20, 7), (0, 0, 1)])
def test_short_and_long_conversations(spark, limits):
    rows = conversations()
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", gone string, codes int").repartition(5)
    damaged = turns.damage(d)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.repair(damaged, *limits).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, w in want.items():
        assert got[c] == w, c
    lines = {}
    for r in turns.repaired(damaged, *limits).collect():
        lines.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["text"]))
    for c, w in want.items():
        own = sorted(lines.get(c, []))
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == w[-1]


def test_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    d = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    for limits in ((4096, 16 << 20, 4096), (0, 0, 1)):
        assert [tuple(r) for r in turns.repair(turns.damage(d), *limits).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damage(empty)).count() == 0 and turns.repaired(turns.damage(empty)).count() == 0
