"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``,
no row is blank, repeated or cut off. The cheapest edits that make it so are a
lightest derivation: an item is (rows read, state of that pattern); the rules
Keep, Rerole, Delete and Insert deduce an item from another, and joining a prefix
of the conversation with the next block is a rule with two antecedents. An
item's value is (cost, audit), the audit being the initials of the edits. Every
rule's function is superior (it never makes a value smaller, and audits of one
item with equal costs are never prefixes of each other, so appending keeps their
order). The agenda pops the smallest value first, so the first time an item is
popped it is final, and the work ends when the goal items are.

Rows are sorted over all tasks by (conversation, turn, digest), so a long
conversation lies over several tasks. Equal rows of one turn are one row with
its number of copies. A conversation inside a task that fits one block of
``BLOCK_ROWS`` rows is repaired there. Of the others (the first and last of every
task, and long ones) each block is solved for every state it may be entered in;
these small tables are then joined in order, and the chosen states go back to the
blocks. While they are joined, states that can no longer win go, and what the
audits of the others have in common is put aside, so a step costs about what the
block does, not the conversation. A digest of
a whole conversation is sequential; its task streams the blocks.

Defined results: null roles and texts are one space; null turns come first; a
null conversation id is a conversation; rows of equal turn are ordered by the
SHA-256 of role and text, repeated rows are duplicates of the first; blank is
every text without a character other than white space, so also the empty one; a
text of any length is one row, and a block holds at least one; a conversation
without rows has no edits; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import WS, materialize, ship

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted truncated row adds.
CUT_OFF = 3
#: Rows (with their copies) and bytes of text of a block, about.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: The pattern's states and moves: start, after s, after u, after a.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Row(NamedTuple):
    """A row and its copies; ``fault`` is that of the first."""

    role: str
    text: str
    fault: int
    copies: int


#: (cost, audit); the audit has one letter a row (its copies after the first are
#: deleted, so their letters say nothing) and an I for every insertion.
Value = tuple[int, str]


def agenda(axioms: list[tuple[Value, object]], deduce: Callable, goals: set) -> dict:
    """Lightest values of the items: ``deduce(item, value)`` yields (value, item)
    by superior functions; ends when all goals are final or nothing is left."""
    heap = [(value, item) for value, item in axioms]
    heapq.heapify(heap)
    final: dict = {}
    left = set(goals)
    while heap and left:
        value, item = heapq.heappop(heap)
        if item in final:
            continue
        final[item] = value
        left.discard(item)
        for made, to in deduce(item, value):
            if to not in final:
                heapq.heappush(heap, (made, to))
    return final


def solve(rows: list[Row], entry: int) -> dict[int, Value]:
    """State after the rows -> lightest value, entering in ``entry``."""

    def deduce(item: tuple[int, int], value: Value) -> Iterator[tuple[Value, tuple[int, int]]]:
        (i, state), (cost, audit) = item, value
        for letter, to in MOVES[state].items():
            if letter != "s":
                yield (cost + INSERT, audit + "I"), (i, to)
        if i == len(rows):
            return
        row = rows[i]
        cost += DELETE * (row.copies - 1)
        yield (cost + DELETE, audit + "D"), (i + 1, state)
        if row.fault in (BLANK, DUPLICATE):
            return
        cost += CUT_OFF * (row.fault == TRUNCATED)
        for letter, to in MOVES[state].items():
            if row.role[:1] == letter:
                yield (cost + KEEP, audit + "K"), (i + 1, to)
            if letter != "s":
                yield (cost + REROLE, audit + "R"), (i + 1, to)

    goals = {(len(rows), s) for s in range(4)}
    final = agenda([((0, ""), (0, entry))], deduce, goals)
    return {s: final[len(rows), s] for s in range(4) if (len(rows), s) in final}


class Prefix:
    """The lightest derivations of a conversation's first blocks."""

    def __init__(self):
        self.at: dict[int, tuple[int, str, str]] = {0: (0, "", "")}  # state -> (cost, audit, states) past what is settled
        self.cost, self.audit, self.states = 0, [], []

    def join(self, block: dict[tuple[int, int], Value]) -> None:
        """Rule with two antecedents: [start, q] and [q, r] over the block give [start, r]."""

        def deduce(item: tuple, value: tuple) -> Iterator[tuple]:
            kind, state = item
            if kind:
                return
            cost, audit, states = value
            for (q, r), (more, letters) in block.items():
                if q == state:
                    yield (cost + more, audit + letters, states + str(r)), (1, r)

        self.at = {s: v for (kind, s), v in agenda([(v, (0, s)) for s, v in self.at.items()], deduce, {(1, s) for s in range(4)}).items() if kind}
        # what follows "start" or "after s" can follow "after a" as well (but for an s,
        # which can be deleted), so these two states go once they cost more
        for state, saved in ((0, DELETE), (1, 0)):
            if 3 in self.at and state in self.at and self.at[state][0] > self.at[3][0] + saved:
                del self.at[state]
        cost = min(v[0] for v in self.at.values())
        audit, states = commonprefix([v[1] for v in self.at.values()]), commonprefix([v[2] for v in self.at.values()])
        self.cost += cost
        self.audit.append(audit)
        self.states.append(states)
        self.at = {s: (c - cost, a[len(audit) :], p[len(states) :]) for s, (c, a, p) in self.at.items()}

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, the state after each block) of the goal."""
        cost, audit, states = min(self.at[s] for s in ACCEPTING if s in self.at)
        return self.cost + cost, "".join(self.audit) + audit, "".join(self.states) + states


def carry_out(rows: list[Row], audit: str, state: int) -> tuple[list[tuple[str, str]], str, int]:
    """(repaired rows, the audit with the letters of all copies, letters read) of
    one block, entered in ``state``; reads the audit up to the block's last row."""
    out, shown, at = [], [], 0
    ahead = lambda: next(c for c in MOVES[state] if c != "s")
    for row in rows:
        while audit[at] == "I":
            out.append((ROLES[ahead()], ""))
            state = MOVES[state][ahead()]
            shown.append("I")
            at += 1
        edit = audit[at]
        at += 1
        shown.append(edit + "D" * (row.copies - 1))
        if edit != "D":
            letter = row.role[:1] if edit == "K" else ahead()
            out.append((row.role if edit == "K" else ROLES[letter], row.text))
            state = MOVES[state][letter]
    while at < len(audit):
        out.append((ROLES[ahead()], ""))
        state = MOVES[state][ahead()]
        shown.append("I")
        at += 1
    return out, "".join(shown), at


class Counts(NamedTuple):
    """What a run of rows adds to the counts of its conversation."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str  # initials of the first and last role
    last: str
    low: int | None  # turns
    high: int | None
    turns: int

    @classmethod
    def of(cls, rows: list[Row], turns: list[int | None]) -> Counts:
        initials = [r.role[:1] for r in rows]
        some = sorted({t for t in turns if t is not None})
        return cls(
            sum(r.copies for r in rows if r.fault == BLANK),
            sum(r.copies if r.fault == DUPLICATE else r.copies - 1 for r in rows if r.fault != BLANK),
            sum(r.fault == TRUNCATED for r in rows),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r.copies - 1 for r in rows),
            initials[0], initials[-1], some[0] if some else None, some[-1] if some else None, len(some),
        )

    def then(self, other: Counts) -> Counts:
        seam = self.high is not None and self.high == other.low
        low, high = (self.low if self.low is not None else other.low), (other.high if other.high is not None else self.high)
        illegal = self.illegal + other.illegal + (self.last + other.first not in LEGAL)
        return Counts(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, illegal, self.first, other.last, low, high, self.turns + other.turns - seam)

    def columns(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the faults that the CRC-32 of
    ``conv_id:turn`` modulo 20 chooses: dropped, emptied, without its end marks,
    repeated, its role the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn))) % 20
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), how.alias("how"))
    damaged = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), damaged.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and fault, sorted by conversation and turn
    over all tasks. ``conv`` names the conversation, null ids too."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), "copies")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    # only what a conversation says at several turns can be a duplicate of another turn
    said = rows.groupBy("conv", "key").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(said, ["conv", "key"], "left")
    later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    end = F.regexp_extract("text", rf"([^{WS}])[{WS}]*\z", 1)
    fault = F.when(end == "", BLANK).when(later, DUPLICATE).when(~end.rlike("[.!?]"), TRUNCATED).otherwise(0)
    order = ["conv", F.asc_nulls_first("turn"), "key"]
    marked = marked.select("conv", "turn", "key", "role", "text", fault.cast("int").alias("fault"), "copies")
    return marked.repartitionByRange(*order).sortWithinPartitions(*order)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_BODY = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("copies", pa.int64())]))
_TABLE = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = pa.struct([(n, pa.string() if n in ("first", "last") else pa.int64()) for n in Counts._fields])
_KINDS = [pa.string(), pa.int64(), pa.binary(), _COUNTS, pa.int64(), pa.string(), _TURNS, _BODY, _TABLE]
_FIELDS = ["conv", "turn", "key", "counts", "cost", "audit", "repaired", "body", "ways"]
_PARTS = (
    "conv string, turn long, key binary, counts struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string,low:long,high:long,turns:long>, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>, body array<struct<role:string,text:string,fault:int,copies:long>>, ways array<struct<enter:int,leave:int,cost:long,audit:string>>"
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], _FIELDS)


def _turns(out: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in out]


def _closed(conv: str, turns: list, keys: list, rows: list[Row]) -> tuple:
    """A conversation in one block: its repair."""
    ends = solve(rows, 0)
    cost, audit = min(ends[s] for s in ACCEPTING if s in ends)
    out, shown, _ = carry_out(rows, audit, 0)
    return conv, turns[0], keys[0], Counts.of(rows, turns)._asdict(), cost, shown, _turns(out), None, None


def _open(conv: str, turns: list, keys: list, rows: list[Row], heads: bool) -> tuple:
    """A block of a conversation: its ways from every state it may be entered in."""
    ways = [{"enter": p, "leave": q, "cost": c, "audit": a} for p in ((0,) if heads else range(4)) for q, (c, a) in solve(rows, p).items()]
    return conv, turns[0], keys[0], Counts.of(rows, turns)._asdict(), None, None, None, [r._asdict() for r in rows], ways


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Repairs and blocks of one task's sorted rows."""
    conv, turns, keys, rows, size = None, [], [], [], 0
    convs = cut = 0  # conversations seen; blocks of this one that were cut off before
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for now, turn, key, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if now != conv:
                if rows:
                    out.append(_closed(conv, turns, keys, rows) if convs > 1 and not cut else _open(conv, turns, keys, rows, convs > 1 and not cut))
                conv, turns, keys, rows, size, cut = now, [], [], [], 0, 0
                convs += 1
            elif len(rows) >= block_rows or size >= BLOCK_BYTES:
                out.append(_open(conv, turns, keys, rows, convs > 1 and not cut))
                turns, keys, rows, size, cut = [], [], [], 0, cut + 1
            turns.append(turn)
            keys.append(key)
            rows.append(Row(*row))
            size += len(row[1])
            held += len(row[1])
            if len(out) >= 2000 or out and held >= BLOCK_BYTES:
                yield _batch(out)
                out, held = [], 0
    if rows:
        out.append(_open(conv, turns, keys, rows, convs > 1 and not cut))
    if out:
        yield _batch(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation whose blocks arrive in order: counts, cost, the states after its blocks."""
    conv, prefix, counts = None, None, None

    def done() -> pa.RecordBatch:
        cost, _, states = prefix.best()
        cols = [pa.array([conv]), pa.array([counts._asdict()], _COUNTS), pa.array([cost], pa.int64()), pa.array([states])]
        return pa.RecordBatch.from_arrays(cols, ["conv", "counts", "cost", "states"])

    for batch in batches:
        for now, own, ways in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now != conv:
                if prefix:
                    yield done()
                conv, prefix, counts = now, Prefix(), None
            prefix.join({(w["enter"], w["leave"]): (w["cost"], w["audit"]) for w in ways})
            counts = Counts(**own) if counts is None else counts.then(Counts(**own))
    if prefix:
        yield done()


_DONE = ["conv", "block", "place", "repaired", "audit", "sha"]


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order with the states after all blocks of their conversation:
    repaired rows with the place of the first, the audit; at the last block the digest."""
    conv, k, place, digest = None, 0, 0, None
    for batch in batches:
        for now, body, ways, states in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now != conv:
                conv, k, place, digest = now, 0, 0, hashlib.sha256()
            enter, leave = (int(states[k - 1]) if k else 0), int(states[k])
            audit = next(w["audit"] for w in ways if (w["enter"], w["leave"]) == (enter, leave))
            out, shown, _ = carry_out([Row(**r) for r in body], audit, enter)
            for n, (role, text) in enumerate(out):
                digest.update((("\n" if place + n else "") + f"{role}:{text}").encode())
            k += 1
            cols = [pa.array([conv]), pa.array([k], pa.int64()), pa.array([place], pa.int64()), pa.array([_turns(out)], _TURNS), pa.array([shown]), pa.array([digest.hexdigest() if k == len(states) else None], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, _DONE)
            place += len(out)


class Repaired(NamedTuple):
    """Tables of the repaired conversations that have rows: ``found`` (conv, gaps,
    blank, duplicate, truncated, illegal, cost, audit, sha) and ``turns`` (conv,
    place, role, text)."""

    found: DataFrame
    turns: DataFrame


_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repaired:
    """Repairs of the conversations in ``rows`` (conv_id, turn, role, text, copies)."""
    ship(rows.sparkSession)
    order = ["conv", F.asc_nulls_first("turn"), "key"]
    parts = materialize(_in_order(rows).mapInArrow(lambda b: _blocks(b, block_rows), _PARTS), "parts")
    sha = F.sha2(F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)
    whole = parts.where("body IS NULL").select("conv", "counts", "cost", "audit", sha.alias("sha"), F.lit(0).cast("long").alias("place"), "repaired")

    long_ = parts.where("body IS NOT NULL")
    in_turn = lambda df: df.repartition("conv").sortWithinPartitions(*order)
    joined = in_turn(long_.select("conv", "counts", "ways", "turn", "key")).select("conv", "counts", "ways").mapInArrow(
        _joined, f"conv string, counts {parts.schema['counts'].dataType.simpleString()}, cost long, states string"
    )
    joined = materialize(joined, "joined")
    bodies = in_turn(long_.select("conv", "body", "ways", "turn", "key").join(joined.select("conv", "states"), "conv"))
    done = materialize(
        bodies.select("conv", "body", "ways", "states").mapInArrow(_carried, "conv string, block long, place long, repaired array<struct<role:string,text:string>>, audit string, sha string"), "repaired"
    )
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    of = done.groupBy("conv").agg(letters.alias("audit"), F.max("sha").alias("sha"))
    found = whole.select("conv", "counts", "cost", "audit", "sha").unionByName(joined.drop("states").join(of, "conv").select("conv", "counts", "cost", "audit", "sha"))
    c = F.col("counts")
    gaps = F.when(c["low"].isNull(), 0).otherwise(c["high"] - c["low"] + 1 - c["turns"]).cast("long")
    found = found.select("conv", gaps.alias("gaps"), *(c[n].alias(n) for n in _LONGS[1:]), "cost", "audit", "sha")
    turns = whole.select("conv", "place", "repaired").unionByName(done.select("conv", "place", "repaired"))
    turns = turns.select("conv", "place", F.posexplode("repaired").alias("k", "t")).select("conv", (F.col("place") + F.col("k")).alias("place"), "t.role", "t.text")
    return Repaired(found, turns)


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """Per conversation id of the table, damaged and repaired: conv_id, the counts,
    cost, audit and digest of the repaired rows."""
    found = repair(damage(conversations)).found
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    ids = conversations.select("conv_id").distinct().withColumn("conv", conv)
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in [*_LONGS, "cost"]]
    return ids.join(found, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
