"""Conversation repair against an alignment to every target and a plain replay."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from revkit.llm import conversations as C

SPACES = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, key string, copies int, place string"


def key(r):
    role, text = r
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    out = []
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, key(r[2:])))


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) by aligning the rows to every legal row of roles."""
    best = None
    for size in range(0, len(rows) + 4):
        for target in {"ua" * (size // 2), "s" + "ua" * (size // 2)} if size >= 2 else {""}:
            @cache
            def go(i, j, target=target):
                found = []
                if i == len(rows) and j == len(target):
                    return 0, "", ()
                if j < len(target) and target[j] != "s" and (x := go(i, j + 1)):
                    role = {"u": "user", "a": "assistant"}[target[j]]
                    found.append((x[0] + 3, "I" + x[1], (f"{role}:", *x[2])))
                if i < len(rows):
                    role, text = rows[i][2:]
                    if x := go(i + 1, j):
                        found.append((x[0] + 4, "D" + x[1], x[2]))
                    if marks[i] not in ("blank", "duplicate") and j < len(target) and (x := go(i + 1, j + 1)):
                        more = 3 * (marks[i] == "truncated")
                        if role[:1] == target[j]:
                            found.append((x[0] + more, "K" + x[1], (f"{role}:{text}", *x[2])))
                        if target[j] != "s":
                            found.append((x[0] + more + 3, "R" + x[1], ({"u": "user", "a": "assistant"}[target[j]] + ":" + text, *x[2])))
                return min(found) if found else None

            got = go(0, 0)
            best = min(filter(None, (best, got)))
    return best


def expected(table):
    by = {}
    for r in table:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, all_rows in by.items():
        rows = damaged(all_rows)
        marks = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest(rows, marks)
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def table(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "What?  ", "", " \t", "Fine.\n", "é。", "ok.", None, "cut off, "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "Assistant"]
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t, t + 3, None])
            out.append((c, turn, rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[t % 2], rng.choice(texts) if rng.random() < 0.5 else f"Text {t}."))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", None, 7, "p") for r in rows], SCHEMA)


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query(spark):
    rows = table(1, 150, 7)
    rows += [(None, t, ("user", "assistant")[t % 2], f"null id {t}.") for t in range(5)] + [(None, None, None, None)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"900:{t}".encode()) % 20 == 0)
    rows += [(900, dropped, "user", "gone.")]  # no rows after damage
    rows += [(901, 5, "user", "Same.")] * 9 + [(901, 5, "assistant", "")] * 4  # repeated rows of one turn
    rows += [(902, t, "user", "x" * 30000 + "." * (t % 2)) for t in range(3)]
    want = expected(rows)
    got = found(C.audit_damaged(frame(spark, rows).repartition(3)))
    assert {k: (v, want[k]) for k, v in got.items() if v != want.get(k)} == {} and set(got) == set(want)
    assert got[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.audit_damaged(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_rows", [1, 3])
def test_blocks_of_long_conversations(spark, block_rows):
    rows = [(c, t, *r[2:]) for c in range(4) for t, r in enumerate(table(50 + c, 12, 8))]
    whole = C.repair(C.damage(frame(spark, rows)), block_rows=1000)
    split = C.repair(C.damage(frame(spark, rows)).repartition(5), block_rows=block_rows)
    assert found(split.found) == found(whole.found)
    assert sorted(map(tuple, split.turns.collect())) == sorted(map(tuple, whole.turns.collect()))
    want = expected(rows)
    assert found(split.found) == {f"={k}": v for k, v in want.items()}
    text = "\n".join(f"{r.role}:{r.text}" for r in split.turns.where("conv = '=2'").orderBy("place").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == want[2][-1]


def test_joining_blocks_keeps_ties():
    rng = random.Random(9)
    for _ in range(300):
        rows = [C.Row(rng.choice(["user", "assistant", "system", "t"]), "x", rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 12))]
        ends = C.solve(rows, 0)
        cost, audit = min(ends[s] for s in C.ACCEPTING if s in ends)
        prefix, at = C.Prefix(), 0
        while at < len(rows):
            n = rng.randint(1, 4)
            prefix.join({(p, q): v for p in range(4) for q, v in C.solve(rows[at : at + n], p).items()})
            at += n
        assert prefix.best()[:2] == (cost, audit)
        out, shown, read = C.carry_out(rows, audit, 0)
        assert read == len(audit) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and len(shown) >= len(rows)


def test_long_conversation_is_linear():
    """4,000 rows in blocks: the joined audits stay as short as a block."""
    rows = [C.Row(("user", "assistant")[t % 2], f"{t}.", 0, 1) for t in range(4000)]
    prefix = C.Prefix()
    for at in range(0, len(rows), 100):
        prefix.join({(p, q): v for p in range(4) for q, v in C.solve(rows[at : at + 100], p).items()})
        assert max(len(v[1]) for v in prefix.at.values()) <= 210
    assert prefix.best()[:2] == (0, "K" * 4000)
