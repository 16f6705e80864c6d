import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from groundwork.llm import conversations as cv

GRAMMAR = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        sp = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for c, rows in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edit sequences in the order of (cost, audit), whole strings and roles kept: the first with a legal end."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and GRAMMAR.fullmatch(initials) and all(r[:1] for r, _ in out):
            return cost, audit, out
        if not re.fullmatch("(s?(ua)*u?)?", initials) or not all(r[:1] for r, _ in out) or cost > 40:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (new, text))))
    raise AssertionError


def brute(rows):
    out = []
    for conv, own in damaged(rows).items():
        faults = faults_of(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit, kept = cheapest(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, cv.repair(cv.damage(df)).collect()), key=str)


def test_small_conversations_equal_brute_force(spark):
    pick = random.Random(7)
    texts = ["Yes.", "No!", "open end", "", " \t", None, "Done? \n"]
    roles = ["system", "user", "assistant", "tool", "", None, "sys"]
    rows = []
    for conv in range(220):
        turn = 0
        for _ in range(pick.randrange(1, 5)):
            turn += pick.choice([1, 1, 1, 3])
            rows.append((conv, pick.choice([turn, turn, turn, turn, None]), pick.choice(roles[:3] * 3 + roles), pick.choice(texts)))
    own = {}
    rows = [r for r in rows if r[1] is not None or own.setdefault(r[0], r) is r]  # one null turn each: no ties of different rows
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", range(5))
def test_every_signature_has_its_cheapest_least_audit(length):
    automaton = cv.Automaton()
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for ends in sorted("".join(x) for x in product("suaoSUxA"[: 8 if length < 4 else 5], repeat=length)):
        rows = [(k, role[s.lower()], f"text {k}") if s != "x" else (k, "user", "") for k, s in enumerate(reversed(ends))]
        faults = ["blank" if s == "x" else "truncated" if s.isupper() else "" for s in reversed(ends)]
        assert automaton.plan(ends) == cheapest(rows, faults)[:2]
    assert automaton.made <= sum(8**k for k in range(1, length + 1))  # a node for each suffix, once


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (3, None, "user", "x" * 300_000 + "."), (3, 1, "assistant", "y")] + [(9, t, "user", "same.") for t in range(6)]
    assert got(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.selectExpr("*", "1 as kind", "'D' as audit", "2 as digest", "3 as cost")
    assert sorted(map(tuple, cv.repair(cv.damage(wide)).collect()), key=str) == brute(rows)
    assert cv.repair(cv.damage(df.limit(0))).collect() == []
    same = [(5, 2, "user", "a."), (5, 2, "user", "a."), (5, 3, "assistant", "b.")]
    assert got(spark, same) == brute(same)


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "text.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_the_hashed_text_and_legal(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = cv.damage(df)
    text = {}
    for r in sorted(cv.repaired_turns(rows).collect(), key=lambda r: (r["conv_id"], r["place"])):
        text.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in cv.repair(rows).collect():
        own = text.get(r["conv_id"], [])
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in own))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r["repaired_sha256"]


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(5000)]
    (row,) = got(spark, rows)
    own = damaged(rows)[1]
    assert row[7].count("I") + len(own) == len(row[7]) and row[2:5] == tuple(faults_of(own).count(f) for f in ("blank", "duplicate", "truncated"))
