"""Conversation structure repair on a suffix-shared automaton.

A conversation becomes a signature, one symbol per row for its role and first fault. All
signatures are sorted by their reversed strings, so that those with equal ends stand side by side:
a task reads them in order and keeps the nodes of the current one as a stack. Two positions with the
same rest of a signature are the same node, which is made once: its cost-to-go, its best edits and the link
to the best audit suffix are computed for each state of the grammar ``(s?(ua)+)?`` when the node is pushed, and every
conversation that ends so shares them. A range of the sort repeats at most the one path it starts with.

Rows of a conversation are in the order of turn (nulls first), role, digest of role and text. A
conversation streams through its task: what is held are a symbol and an edit per row, never
its texts. Its repaired texts are hashed in their order, so one conversation is one task's work.

Handling: a null role or text is one space, a null conversation is one of its own, null turns come
first and count in no gap. Repeated rows are duplicates. Texts are read whole, however long. Other columns are not
read. A conversation without rows after damage has zeros, an empty audit and the hash of
nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
OPEN_END = 3  # an undeleted truncated row

# grammar: nothing yet, after the system row, after a user row, after a pair
START, SYSTEM, USER, PAIR = range(4)
ROLE_OF = {START: "user", SYSTEM: "user", USER: "assistant", PAIR: "user"}  # what an edit may write there
NEXT = {START: USER, SYSTEM: USER, USER: PAIR, PAIR: USER}
STATES = (START, SYSTEM, USER, PAIR)

# symbols: the role's initial (o for any other), upper case if truncated; x for blank and duplicate
LOST = "x"
PAIRS = {"su", "ua", "au"}


# --------------------------------------------------------------------------
# the automaton


def _best(state: int, after: list[int], symbol: str) -> tuple[int, str, int]:
    """Cheapest way to use up one row: (cost, edit, state), ties to the least edit."""
    options = [(COSTS[DELETE] + after[state], DELETE, state)]
    if symbol != LOST:
        extra = OPEN_END if symbol.isupper() else 0
        to = NEXT[state]
        options.append((COSTS[REROLE] + extra + after[to], REROLE, to))
        if symbol.lower() == ROLE_OF[state][0]:
            options.append((extra + after[to], KEEP, to))
        if symbol.lower() == "s" and state == START:
            options.append((extra + after[SYSTEM], KEEP, SYSTEM))
    return min(options)


def _with_inserts(own: list[tuple[int, str, int]]) -> tuple[list[int], tuple[tuple[str, int], ...]]:
    """Costs and (edits, state) of each state where rows may be inserted first. One insert moves between the states
    after a user row and after a pair, a second one would move back: none needs more."""

    def first_or(state: int, other: tuple[int, str, int]) -> tuple[int, str, int]:
        return min(own[state], (COSTS[INSERT] + other[0], INSERT + other[1], other[2]))

    user, pair = first_or(USER, own[PAIR]), first_or(PAIR, own[USER])
    found = [first_or(START, user), first_or(SYSTEM, user), user, pair]
    return [c for c, _, _ in found], tuple((e, s) for _, e, s in found)


_NEVER = 1 << 30
END_COSTS, END_EDITS = _with_inserts([(0, "", START), (_NEVER, "", SYSTEM), (_NEVER, "", USER), (0, "", PAIR)])


@lru_cache(None)
def _step(after: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """A node from the node behind it: costs less the least of them, that least, edits. The costs of two states differ
    by a few edits at most, so there are few different arguments."""
    costs, edits = _with_inserts([_best(s, list(after), symbol) for s in STATES])
    least = min(costs)
    return tuple(c - least for c in costs), least, edits


class Automaton:
    """The nodes of one reversed signature after the other; a new one shares the nodes of the common end."""

    def __init__(self) -> None:
        self.read = ""
        self.nodes: list[tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = [(tuple(END_COSTS), 0, END_EDITS)]
        self.made = 0

    def plan(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and audit of the conversation with this signature."""
        shared, most = 0, min(len(self.read), len(reversed_signature))
        while shared < most and self.read[shared] == reversed_signature[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed_signature[shared:]:
            after, base, _ = self.nodes[-1]
            costs, least, edits = _step(after, symbol)
            self.nodes.append((costs, base + least, edits))
            self.made += 1
        self.read = reversed_signature
        state, audit = START, []
        for _, _, edits in reversed(self.nodes):
            step, state = edits[state]
            audit.append(step)
        costs, base, _ = self.nodes[-1]
        return base + costs[START], "".join(audit)


# --------------------------------------------------------------------------
# damage, faults, signatures


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ``conv_id, turn, role, text, present`` after damage by crc32(``conv:turn``) % 20: 0 drops the row
    (``present`` is false), 1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 sets the role user."""
    blank = F.lit(" ")
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(named) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _digest() -> Column:
    """128 bits of role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, ends`` (the reversed
    signature) of rows as ``damage`` gives them. One narrow shuffle, without the texts."""
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select("conv_id", "turn", "role", "present", _digest().alias("digest"), (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(*ENDS)).alias("open"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("present"), "absent").when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated").otherwise("")
    marked = narrow.repartition("conv_id").select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: _Conversation | None = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
            for conv_id, turn, initial, fault in zip(*cols, strict=True):
                if conv is None or conv.conv_id != conv_id:
                    if conv is not None:
                        done.append(conv.row())
                    conv = _Conversation(conv_id)
                if fault != "absent":
                    conv.add(turn, initial, fault)
            if len(done) > 4096:
                yield _batch(done, schema)
                done = []
        if conv is not None:
            done.append(conv.row())
        yield _batch(done, schema)

    return marked.sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "initial", "fault").mapInArrow(run, schema)


class _Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.before = conv_id, [], None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in PAIRS
        self.before = initial
        if turn is not None and turn != self.high:  # turns ascend
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        role = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(LOST if fault in ("blank", "duplicate") else role.upper() if fault else role)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, "".join(reversed(self.symbols))


_ARROW = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


# --------------------------------------------------------------------------
# plans and repaired texts

FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def plans(signed: DataFrame) -> DataFrame:
    """Signed conversations (a written table) with ``cost`` and ``audit``. Ranges of reversed signatures, those of one
    signature split by conversation: a frequent signature is no hot key."""
    schema = "conv_id long, " + ", ".join(f"{f} long" for f in FAULTS) + ", cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, last, found = Automaton(), None, (0, "")
        for batch in batches:
            costs, audits = [], []
            for ends in batch.column("ends").to_pylist():
                if ends != last:
                    last, found = ends, automaton.plan(ends)
                costs.append(found[0])
                audits.append(found[1])
            cols = [batch.column(c) for c in ("conv_id", *FAULTS)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["conv_id", *FAULTS, "cost", "audit"])

    return signed.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends").mapInArrow(run, schema)


class _Walk:
    """Applies an audit to a conversation's rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _write(self, edit: str) -> tuple[str, str]:
        role = ROLE_OF[self.state]
        self.state = NEXT[self.state]
        return edit, role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._write(INSERT)

    def row(self, role: str) -> tuple[str, str] | None:
        """Edit and role of the next row; None if it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return None
        if edit == REROLE:
            return self._write(edit)
        self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
        return edit, role


def _told(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan followed by its rows in order, streamed by conversation."""
    lines = rows.where("present").withColumn("digest", _digest()).withColumn("kind", F.lit(1))
    told = planned.withColumn("kind", F.lit(0)).unionByName(lines.drop("present"), allowMissingColumns=True)
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired text of each conversation, from rows as ``damage`` gives them:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    planned = written(plans(written(signatures(rows), "signatures")), "plans")
    names = ["conv_id", *FAULTS, "cost", "audit"]
    schema = "conv_id long, " + ", ".join(f"{f} long" for f in FAULTS) + ", cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        plan = walk = digest = None
        begun = False

        def add(role: str, text: str) -> None:
            nonlocal begun
            digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
            begun = True

        def close() -> None:
            if plan is not None:
                for _, role in walk.inserts():
                    add(role, "")
                done.append((*plan, digest.hexdigest()))

        for batch in batches:
            kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
            head = {c: batch.column(c).to_pylist() for c in names}
            for k, kind in enumerate(kinds):
                if kind == 0:
                    close()
                    plan, digest, begun = tuple(head[c][k] for c in names), hashlib.sha256(), False
                    walk = _Walk(plan[-1])
                    continue
                for _, role in walk.inserts():
                    add(role, "")
                kept = walk.row(roles[k])
                if kept is not None:
                    add(kept[1], texts[k])
            if len(done) > 4096:
                yield _batch(done, schema)
                done = []
        close()
        yield _batch(done, schema)

    return _told(rows, planned).select(*names, "kind", "role", "text").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place`` (from 0), ``edit, role, text``."""
    planned = written(plans(written(signatures(rows), "signatures")), "plans")
    schema = "conv_id long, place long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv_id, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for kind, own, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "audit", "role", "text")), strict=True):
                found = list(walk.inserts()) if walk else []
                lines = [(*x, "") for x in found]
                if kind:
                    kept = walk.row(role)
                    lines += [(*kept, text)] if kept else []
                for edit, new_role, new_text in lines:
                    out.append((conv_id, place, edit, new_role, new_text))
                    place += 1
                if not kind:
                    walk, conv_id, place = _Walk(audit), own, 0
            yield _batch(out, schema)
        if walk:
            yield _batch([(conv_id, place + k, edit, role, "") for k, (edit, role) in enumerate(walk.inserts())], schema)

    return _told(rows, planned).select("kind", "conv_id", "audit", "role", "text").mapInArrow(run, schema)
