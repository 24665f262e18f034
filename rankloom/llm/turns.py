"""Conversation structure repair by depth-first branch-and-bound.

A conversation should read ``(system? (user assistant)+)?`` by the initials of
its roles. Its rows, in the order of their turns, are edited: Keep (K, 0),
Rerole to user or assistant (R, 2), Delete (D, 3; required for blank and
duplicate rows), Insert an empty user or assistant row (I, 2); a truncated row
that stays adds 1. Wanted are the least cost and, among the cheapest edits, the
ASCII-least string of initials.

What the search needs of a row is one code: the initial of its role and its
first fault. A node is (rows done, state), the state being what the roles so far
end with, so the roles of R and I follow from it. The search keeps an explicit
stack and tries a row's edits in ASCII order (an insertion belongs to the row
before which it stands, so no two prefixes with as many rows are prefixes of
each other). A prefix is cut off if its cost and the suffix bound of its node
cannot beat the incumbent (cost, audit), or if the node's dominance table holds
one as cheap, which came earlier and is therefore ASCII-less. Suffix bounds are
computed backwards with the audit left out of account; they are attainable, so
the search is linear and ends with the proof of optimality. More than one
insertion before a row, or one before a deletion, is never best: leaving the
pair out, or inserting later, is cheaper or ASCII-less.

Conversations of at most ``MOST_ROWS`` rows and ``MOST_CHARS`` characters are
dealt by their id, sorted and streamed; a task holds one of them at a time. A
longer one, however hot, is range-partitioned by its order: each task turns its
rows into codes, blocks of ``BLOCK`` codes are searched in parallel from every
state to every state, the blocks' costs (one row in 256) are folded, and the
audits of the chosen blocks are joined. Only its checksum, which is sequential
by nature, is one stream over the rows, with constant memory beside the audit.

Defined cases: a null role or text counts as one space, as does a null conv_id
or turn in the checksum; null turns come first and take no part in the gaps;
rows of equal turns are taken by role, then text; the null conv_id is a
conversation of its own; an empty role has no initial; a conversation without
rows has the empty audit and the checksum of the empty string; repeated rows are
duplicates; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import maybe_broadcast, settle, stored, table

MOST_ROWS, MOST_CHARS, BLOCK = 4096, 16 << 20, 4096
START, SYSTEM, USER, DONE = range(4)
INITIALS, FINE, BLANK, DUPLICATE, TRUNCATED = "sua", 0, 1, 2, 3
FAR = 1 << 40
#: Cost of ending in each state, and the insertions that it takes.
ENDS, TAILS = (0, 4, 2, 0), ("", "II", "I", "")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---- rows to codes ------------------------------------------------------------
def fault(text: str) -> int:
    """BLANK, TRUNCATED or FINE by the text alone."""
    end = text.rstrip(_SPACE)
    return BLANK if not end else FINE if end[-1] in ".!?" else TRUNCATED


def code(role: str, wrong: int) -> str:
    """One letter for the initial (other ones alike) and the fault."""
    return chr(65 + 4 * wrong + (INITIALS.find(role[0]) if role and role[0] in INITIALS else 3))


def codes_of(rows: list[tuple]) -> str:
    """The codes of the ordered rows (turn, role, text) of a conversation."""
    seen, out = set(), []
    for _, role, text in rows:
        wrong = fault(text)
        if wrong != BLANK and (role, text) in seen:
            wrong = DUPLICATE
        seen.add((role, text))
        out.append(code(role, wrong))
    return "".join(out)


def tally(codes: str) -> dict[str, int]:
    """Counts of faults and of illegal neighbours."""
    wrong = [(ord(c) - 65) // 4 for c in codes]
    who = [(*INITIALS, "")[(ord(c) - 65) % 4] for c in codes]
    return {"blank": wrong.count(BLANK), "duplicate": wrong.count(DUPLICATE), "truncated": wrong.count(TRUNCATED),
            "illegal": sum(pair not in _LEGAL for pair in zip(who, who[1:], strict=False))}


# ---- the search -----------------------------------------------------------------
def follow(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return DONE if initial == "a" and state == USER else None


def wanted(state: int) -> str:
    return "assistant" if state == USER else "user"


def _edits(c: str, state: int) -> list[tuple[str, int, int]]:
    """(letters, cost, next state) of every edit of a row, in ASCII order."""
    wrong, who = (ord(c) - 65) // 4, (*INITIALS, "")[(ord(c) - 65) % 4]
    out = [("D", 3, state)]
    if wrong in (FINE, TRUNCATED):
        own = int(wrong == TRUNCATED)
        put = follow(state, wanted(state)[0])
        for letters, cost, to in (("IK", 2, follow(put, who)), ("IR", 4, follow(put, wanted(put)[0])), ("K", 0, follow(state, who)), ("R", 2, put)):
            if to is not None:
                out.append((letters, cost + own, to))
    return out


EDITS = {chr(65 + i): [_edits(chr(65 + i), state) for state in range(4)] for i in range(16)}


def search(codes: str, entry: int, ends: tuple) -> tuple[int, str] | None:
    """(cost, audit) of the best edits of ``codes`` from the state ``entry``; ``ends`` has the cost of ending in each state."""
    n = len(codes)
    low = [ends] * (n + 1)
    for i in range(n - 1, -1, -1):
        after = low[i + 1]
        low[i] = tuple(min(cost + after[to] for _, cost, to in options) for options in EDITS[codes[i]])
    if low[0][entry] >= FAR:
        return None
    limit, best = low[0][entry] + 1, None  # the bound can be attained, so the first incumbent costs no more
    table = [[FAR] * 4 for _ in range(n + 1)]
    stack = [(0, entry, 0, None)]
    while stack:
        i, state, cost, path = stack.pop()
        if cost + low[i][state] >= limit or cost >= table[i][state]:
            continue
        table[i][state] = cost
        if i == n:
            letters = [TAILS[state] if ends is ENDS else ""]
            while path:
                letters.append(path[0])
                path = path[1]
            limit = cost + ends[state]
            best = limit, "".join(reversed(letters))
            continue
        for letters, more, to in reversed(EDITS[codes[i]][state]):
            stack.append((i + 1, to, cost + more, (letters, path)))
    return best


@lru_cache(maxsize=1 << 14)
def best_edits(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return search(codes, START, ENDS)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every row that the edits leave or insert; ``rows`` has (role, text)."""
    state = START
    for letter in audit:
        role, text = (wanted(state), "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role = wanted(state)
        state = follow(state, role[0])
        yield letter, role, text


def checksum(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of the repaired ``role:text`` lines, taken as a stream."""
    sha, first = hashlib.sha256(), True
    for _, role, text in edited(audit, rows):
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return sha.hexdigest()


# ---- the rows ---------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; a dropped row stays, marked as gone, without its text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h.isin(0, 1), "").when(h == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(h == 4, "user").otherwise(space("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h == 0).alias("gone"), F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1)).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy")).drop("copy")


def _split(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short and of long conversations; None if there are no long ones."""
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = settle(size.filter((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("long_id")))
    if not long.limit(1).count():
        return rows, None
    long = maybe_broadcast(long, 32)
    same = rows["conv_id"].eqNullSafe(long["long_id"])
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    order = ["conv_id", *more, "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _runs(it, columns: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for b in it:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _conversations(it) -> Iterator[tuple]:
    """(conv_id, rows after damage) of each short conversation of a sorted partition."""
    rows, now, some = [], None, False
    for conv, turn, role, text, gone in _runs(it, ("conv_id", "turn", "role", "text", "gone")):
        if some and conv != now:
            yield now, rows
            rows = []
        now, some = conv, True
        if not gone:
            rows.append((turn, role, text))
    if some:
        yield now, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from tuples."""
    part, chars = [], 0
    for r in rows:
        part.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(part) >= most or chars > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, chars = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _map(df: DataFrame, fn: Callable, columns: str) -> DataFrame:
    """``fn`` (an iterator of tuples from Arrow batches) over the partitions of ``df``; conv_id comes first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = df.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, {columns}")
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda it: _batches(fn(it), arrow), schema)


def _summary(it) -> Iterator[tuple]:
    for conv, rows in _conversations(it):
        codes = codes_of(rows)
        n, (cost, audit) = tally(codes), best_edits(codes)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, checksum(audit, ((r, t) for _, r, t in rows))


def _lines(it) -> Iterator[tuple]:
    for conv, rows in _conversations(it):
        _, audit = best_edits(codes_of(rows))
        for at, line in enumerate(edited(audit, ((r, t) for _, r, t in rows))):
            yield conv, at, *line


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LINES = "pos long, edit string, role string, text string"


# ---- long conversations --------------------------------------------------------------
def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, part, block, codes): the codes of long conversations, in pieces; (part, block) orders them."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    again = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = maybe_broadcast(settle(again.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")), 160)
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    # 1: of the first turn with these words, so a duplicate unless it comes first there; 2: of a later turn.
    seen = F.when(F.col("first").isNull(), 0).when(F.col("turn").eqNullSafe(F.col("first.turn")), 1).otherwise(2)
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.select(*order, seen.alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(it):
        part, now, number, codes, before = TaskContext.get().partitionId(), None, 0, [], None
        for conv, turn, role, text, seen in _runs(it, (*order, "seen")):
            if codes and (conv != now or len(codes) == block):
                yield now, part, number, "".join(codes)
                number, codes = number + 1, []
            wrong = fault(text)
            if wrong != BLANK and (seen == 2 or seen == 1 and before == (conv, turn, role, text)):
                wrong = DUPLICATE
            codes.append(code(role, wrong))
            now, before = conv, (conv, turn, role, text) if seen == 1 else None
        if codes:
            yield now, part, number, "".join(codes)

    return _map(rows, run, "part int, block int, codes string")


def _searched(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, entry, exit, cost, rank, audit, counts): each block's best edits from state to state.

    ``rank`` orders the audits of a block that start in the same state.
    """

    def run(it):
        for conv, part, number, codes in _runs(it, ("conv_id", "part", "block", "codes")):
            n = tally(codes)
            n = (n["blank"], n["duplicate"], n["truncated"], n["illegal"], codes[0], codes[-1])
            for entry in range(4):
                found = [(leave, search(codes, entry, tuple(0 if s == leave else FAR for s in range(4)))) for leave in range(4)]
                found = sorted((f[1], leave, f[0]) for leave, f in found if f)
                for rank, (audit, leave, cost) in enumerate(found):
                    yield conv, part, number, entry, leave, cost, rank, audit, *n

    return _map(blocks, run, "part int, block int, entry int, exit int, cost long, rank int, audit string, blank long, duplicate long, truncated long, illegal long, head string, tail string")


def _fold(g: pd.DataFrame) -> pd.DataFrame:
    """The chosen (part, block, entry, exit) of one conversation, with its counts on every row."""
    blocks = [b for _, b in g.sort_values(["part", "block"]).groupby(["part", "block"], sort=True)]
    edges = [{(int(e), int(x)): (int(c), int(r)) for e, x, c, r in zip(b["entry"], b["exit"], b["cost"], b["rank"], strict=True)} for b in blocks]
    low = [list(ENDS)]
    for options in reversed(edges):
        low.append([min((c + low[-1][x] for (e, x), (c, _) in options.items() if e == state), default=FAR) for state in range(4)])
    low.reverse()
    state, out = START, []
    for i, options in enumerate(edges):
        tight = [(r, x) for (e, x), (c, r) in options.items() if e == state and c + low[i + 1][x] == low[i][state]]
        leave = min(tight)[1]
        out.append((state, leave))
        state = leave
    heads = [b.iloc[0] for b in blocks]
    joints = sum(tally(a["tail"] + b["head"])["illegal"] for a, b in zip(heads, heads[1:], strict=False))
    n = {k: int(sum(h[k] for h in heads)) for k in ("blank", "duplicate", "truncated", "illegal")}
    return pd.DataFrame({"part": [h["part"] for h in heads], "block": [h["block"] for h in heads], "entry": [a for a, _ in out], "exit": [b for _, b in out],
                         "blank": n["blank"], "duplicate": n["duplicate"], "truncated": n["truncated"], "illegal": n["illegal"] + joints, "cost": low[0][START], "end": TAILS[state]})


def _long_audits(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of long conversations."""
    here = rows.filter("not gone")
    found = stored(_searched(stored(_blocks(here, block), "codes")), "edits")
    narrow = found.select("conv_id", "part", "block", "entry", "exit", "cost", "rank", "blank", "duplicate", "truncated", "illegal", "head", "tail")
    chosen = narrow.groupBy("conv_id").applyInPandas(_fold, "part int, block int, entry int, exit int, blank long, duplicate long, truncated long, illegal long, cost long, end string")
    key = ["part", "block", "entry", "exit"]  # (part, block) is the place of one block of one conversation
    pieces = chosen.join(found.select("conv_id", *key, "audit"), key)
    audit = F.concat(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x["audit"])), F.max("end"))
    totals = [F.max(c).alias(c) for c in COUNTS[1:]]
    whole = pieces.groupBy("conv_id").agg(*totals, audit.alias("audit"))
    turns = here.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = rows.select("conv_id").distinct()
    whole = every.join(whole.withColumnRenamed("conv_id", "w"), F.col("conv_id").eqNullSafe(F.col("w")), "left").join(turns, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return settle(whole.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit")))


def _with_audit(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of every conversation in order, its audit (kind 0) in front of them."""
    lead = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return _ordered(lead.unionByName(rows.filter("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")), "kind")


def _streams(it) -> Iterator[tuple]:
    """(conv_id, audit, iterator of (role, text)) of each conversation, one row in memory at a time."""
    rows = _runs(it, ("conv_id", "kind", "role", "text"))
    ahead = next(rows, None)

    def own():
        nonlocal ahead
        while (ahead := next(rows, None)) is not None and ahead[1] == 1:
            yield ahead[2], ahead[3]

    while ahead is not None:
        mine = own()
        yield ahead[0], ahead[3], mine
        for _ in mine:  # rows after the last edit that reads one: none, but the stream must move on
            pass


def _long_sums(it) -> Iterator[tuple]:
    for conv, audit, rows in _streams(it):
        yield conv, checksum(audit, rows)


def _long_lines(it) -> Iterator[tuple]:
    for conv, audit, rows in _streams(it):
        for at, line in enumerate(edited(audit, rows)):
            yield conv, at, *line


# ---- the operator ---------------------------------------------------------------------
def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    (conv_id, turn, role, text, gone)."""
    short, long = _split(rows, most_rows, most_chars)
    out = _map(_ordered(short), _summary, _SUMMARY)
    if long is None:
        return out
    audits = _long_audits(long, block)
    sums = _map(_with_audit(long, audits), _long_sums, "repaired_sha256 string").withColumnRenamed("conv_id", "s")
    return out.unionByName(audits.join(sums, F.col("conv_id").eqNullSafe(F.col("s"))).drop("s"))


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, edit, role, text): the repaired conversations themselves, rows counted from 0."""
    short, long = _split(rows, most_rows, most_chars)
    out = _map(_ordered(short), _lines, _LINES)
    return out if long is None else out.unionByName(_map(_with_audit(long, _long_audits(long, block)), _long_lines, _LINES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


#: States are named by what the roles end with; every state's best path is kept from row to row.
SQL = r"""
with recursive bits as (
  select range as b, 0 as i, range::ubigint as c from range(256)
  union all
  select b, i + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where i < 8),
crc as materialized (select list(c order by b) as entry from bits where i = 8),
summed as materialized (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::int, 2))::ubigint),
      lambda a, x: xor(a >> 8, entry[(xor(a & 255, x) + 1)::int]), 4294967295::ubigint), 4294967295::ubigint) % 20 as h
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations), crc),
spoiled as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy
  from summed where h <> 0),
placed as materialized (
  select conv_id, turn, role, text, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body, substr(role, 1, 1) as who, lag(substr(role, 1, 1)) over w as before
  from spoiled window w as (partition by conv_id order by turn nulls first, role, text, copy)),
judged as materialized (
  select *, case when body = '' then 'blank' when again then 'duplicate' when substr(body, length(body), 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from placed),
states as (select * from (values ('', 'u', ''), ('s', 'u', 'II'), ('u', 'a', 'I'), ('a', 'u', '')) t(state, want, tail)),
-- Every edit of a row from every state: the letters, the cost beside a truncated row's 1, and the state that follows.
edits as materialized (
  select state, who, letters, cost, next from (
    select state, who, 'D' as letters, 3 as cost, state as next from states, (values ('s'), ('u'), ('a'), ('-')) t(who)
    union all select state, who, 'K', 0, who from states, (values ('s'), ('u'), ('a')) t(who) where who = want or who = 's' and state = ''
    union all select state, who, 'R', 2, want from states, (values ('s'), ('u'), ('a'), ('-')) t(who)
    union all select state, who, 'IK', 2, who from states, (values ('u'), ('a')) t(who) where who <> want
    union all select state, who, 'IR', 4, case want when 'u' then 'a' else 'u' end from states, (values ('s'), ('u'), ('a'), ('-')) t(who))),
paths as (
  select conv_id, 0::bigint as i, '' as state, {'cost': 0::bigint, 'audit': ''} as best from (select distinct conv_id from conversations)
  union all
  select p.conv_id, p.i + 1, e.next, min({'cost': (best.cost + e.cost + case when fault = 'truncated' and letters <> 'D' then 1 else 0 end)::bigint, 'audit': best.audit || letters})
  from paths p join judged j on j.conv_id is not distinct from p.conv_id and j.i = p.i + 1
  join edits e on e.state = p.state and e.who = case when j.who in ('s', 'u', 'a') then j.who else '-' end
  where letters = 'D' or fault in ('', 'truncated')
  group by p.conv_id, p.i, e.next),
counts as (select conv_id, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || who not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
done as materialized (
  select p.conv_id, min({'cost': best.cost + 2 * length(tail), 'audit': best.audit || tail}) as best, any_value(c) as c
  from paths p join states s using (state) left join counts c on c.conv_id is not distinct from p.conv_id
  where p.i = coalesce(c.n, 0) group by p.conv_id),
letters as (select conv_id, best.audit as audit, unnest(range(1, length(best.audit) + 1))::int as p from done),
lines as (
  select l.conv_id, l.p, substr(audit, p, 1) as letter, role, text, who from (select *, length(substr(audit, 1, p)) - length(replace(substr(audit, 1, p), 'I', '')) as put from letters) l
  left join judged j on j.conv_id is not distinct from l.conv_id and j.i = l.p - l.put and substr(audit, p, 1) <> 'I'),
kept as (select *, row_number() over (partition by conv_id order by p) as place, max(case when letter = 'K' and who = 's' then 1 else 0 end) over (partition by conv_id) as lead from lines where letter <> 'D'),
said as (
  select conv_id, string_agg(case when letter = 'K' then role when (place - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by place) as words
  from kept group by conv_id)
select d.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal,
  best.cost as cost, best.audit as audit, sha256(coalesce(words, '')) as repaired_sha256
from done d left join said s on s.conv_id is not distinct from d.conv_id
"""
