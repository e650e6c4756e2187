"""Repair of conversations by generalised LR parsing with weighted edits.

The roles of a conversation should follow a grammar: perhaps a system turn, then
pairs of a user and an assistant turn. ``Grammar`` makes an SLR automaton of its
productions. The parser keeps a graph-structured stack: the tops that are alive
after a turn share what lies under them. From every top a turn may be kept (cost
0), given another role (2) or deleted (3), and an empty turn may be inserted
before it (2); a blank or repeated turn must be deleted, and a turn without an
end that stays adds 1. Equal tops merge, and the one with the least (cost,
audit) stays; the audit is the initials of its edits. Stacks with one top accept
the same continuations in this grammar, so merging loses nothing.

Two tops that have read the same turns have audits of which neither begins the
other, so the order of two audits is settled by their order one turn before, or
else by the letters of the last turn. Each top carries the running digest of the
turns it would leave, so the texts are read once, as a stream in order of turns,
and a conversation of any length takes constant memory besides its audit. A
conversation is read by one task, as its digest can only be taken in order.

Turns come in order of turn (nulls first), and those of one turn by role and
text. Which turns repeat an earlier one is counted by Spark beforehand.

Defined results: a null role or text counts as one blank; rows with a null id
are one conversation; rows with a null turn stand first. Equal rows repeat each
other. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.arrow import slices
from gleanspark.runtime import broadcast_if_small, materialize

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
RULES = [("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua")]
DELETE, INSERT, REROLE, UNENDED = 3, 2, 2, 1
END = "$"


class Grammar:
    """SLR automaton of productions (symbol, string of symbols); the first one's symbol is the start."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.rules = [("^", rules[0][0]), *rules]
        self.symbols = {x for x, _ in rules}
        self.follow = self._follows()
        first = self._closed({(0, 0)})
        self.states, self.goto = [first], {}
        for at, items in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                moved = {(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol}
                state = self._closed(moved)
                if state not in self.states:
                    self.states.append(state)
                self.goto[at, symbol] = self.states.index(state)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            ahead = self.rules[rule][1][dot : dot + 1]
            new = {(k, 0) for k, (x, _) in enumerate(self.rules) if x == ahead} - items
            items |= new
            todo += new
        return frozenset(items)

    def _follows(self) -> dict[str, set[str]]:
        empty, first, follow = set(), {}, {x: set() for x, _ in self.rules}
        follow["^"].add(END)
        while True:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for symbol, body in self.rules:
                begins = first.setdefault(symbol, set())
                for x in body:
                    begins |= first.get(x, set()) if x in self.symbols else {x}
                    if x not in empty:
                        break
                else:
                    empty.add(symbol)
                after = follow[symbol]
                for x in reversed(body):
                    if x in self.symbols:
                        follow[x] |= after
                        after = first.get(x, set()) | (after if x in empty else set())
                    else:
                        after = {x}
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                return follow

    def step(self, stack: tuple[int, ...], token: str) -> tuple[int, ...] | None:
        """The stack after ``token``, reductions included; for the end token a stack if all is accepted."""
        while True:
            if (stack[-1], token) in self.goto:
                return (*stack, self.goto[stack[-1], token])
            for rule, dot in sorted(self.states[stack[-1]]):
                symbol, body = self.rules[rule]
                if dot == len(body) and token in self.follow[symbol]:
                    if symbol == "^":
                        return stack
                    stack = stack[: len(stack) - dot]
                    stack = (*stack, self.goto[stack[-1], symbol])
                    break
            else:
                return None


class Parser:
    """Cheapest edits of the turns of one conversation at a time."""

    grammar = Grammar(RULES)

    def __init__(self):
        # Top of the stack → (stack, cost, digest so far, turns left, audit as linked pairs), in order of audits.
        self.tops = [((0,), 0, hashlib.sha256(), 0, None)]

    @staticmethod
    @lru_cache(maxsize=None)
    def inserted(stack: tuple[int, ...]) -> list[tuple[str, tuple[int, ...]]]:
        """(tokens inserted, stack), without coming to a top twice."""
        found, todo = [], [("", stack, {stack[-1]})]
        while todo:
            tokens, at, seen = todo.pop()
            found.append((tokens, at))
            for x in ROLES:
                after = Parser.grammar.step(at, x)
                if after and after[-1] not in seen:
                    todo.append((tokens + x, after, seen | {after[-1]}))
        return found

    @staticmethod
    @lru_cache(maxsize=None)
    def moves(stack: tuple[int, ...], initial: str, must_go: bool) -> list[tuple[int, str, str, str, tuple[int, ...]]]:
        """(cost, letters, tokens inserted, token of the turn, stack) for one turn; no token: deleted."""
        found = []
        for tokens, at in Parser.inserted(stack):
            before, cost = "I" * len(tokens), INSERT * len(tokens)
            found.append((cost + DELETE, before + "D", tokens, "", at))
            if must_go:
                continue
            for letter, token, price in (("K", initial, 0), *(("R", x, REROLE) for x in ROLES)):
                after = Parser.grammar.step(at, token) if token else None
                if after:
                    found.append((cost + price, before + letter, tokens, letter + token, after))
        return found

    def turn(self, role: str, text: str, must_go: bool, unended: bool) -> None:
        best: dict[int, tuple] = {}
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        for rank, (stack, cost, *_) in enumerate(self.tops):
            for price, letters, tokens, kept, after in self.moves(stack, initial, must_go):
                key = (cost + price + (UNENDED if unended and kept else 0), rank, letters)
                held = best.get(after[-1])
                if held is None or key < held[0]:
                    best[after[-1]] = (key, tokens, kept, after)
        tops = []
        for (cost, rank, letters), tokens, kept, after in sorted(best.values(), key=lambda x: x[0][1:]):
            _, _, digest, count, audit = self.tops[rank]
            lines = [f"{ROLES[x]}:" for x in tokens]
            if kept:
                lines.append(f"{role if kept[0] == 'K' else ROLES[kept[1]]}:{text}")
            tops.append((after, cost, *self._written(digest, count, lines), (audit, letters)))
        self.tops = tops

    @staticmethod
    def _written(digest, count: int, lines: list[str]):
        if lines:
            digest = digest.copy()
            digest.update((("\n" if count else "") + "\n".join(lines)).encode())
        return digest, count + len(lines)

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair of the turns read."""
        ends = []
        for rank, (stack, cost, *_) in enumerate(self.tops):
            for tokens, at in self.inserted(stack):
                if self.grammar.step(at, END):
                    ends.append((cost + INSERT * len(tokens), rank, "I" * len(tokens), tokens))
        cost, rank, letters, tokens = min(ends)
        _, _, digest, count, audit = self.tops[rank]
        digest, _ = self._written(digest, count, [f"{ROLES[x]}:" for x in tokens])
        parts = [letters]
        while audit:
            audit, part = audit
            parts.append(part)
        return cost, "".join(reversed(parts)), digest.hexdigest()


SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    def __init__(self):
        self.parser, self.turns, self.low, self.high = Parser(), 0, None, None
        self.faults, self.illegal, self.last = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, None

    def add(self, turn: int | None, role: str, text: str, repeats: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        here = (turn, role, text)
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if repeats or here == self.last else "truncated" if body[-1] not in ENDS else ""
        if fault:
            self.faults[fault] += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = here
        self.parser.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults.values(), self.illegal, *self.parser.result()]


def _turns(conversations: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """conv, turn, role, text, repeats: whether an earlier turn has the same role and text."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(conv_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column), blank).alias("role"), F.coalesce(F.col(text_column), blank).alias("text"),
    )
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("said", said)
    again = (
        rows.groupBy("conv", "said")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first"))
        .where("n > 1")
        .select(F.col("conv").alias("c"), F.col("said").alias("s"), "unnumbered", "first")
    )
    again = broadcast_if_small(materialize(again, "said-again"))
    rows = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    repeats = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first")))
    return rows.select("conv", "turn", "role", "text", F.coalesce(repeats, F.lit(False)).alias("repeats"))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *keys, "turn", "role", "text")


def repair(
    conversations: DataFrame, conv_column="conv_id", turn_column="turn", role_column="role", text_column="text",
) -> DataFrame:
    """Per conversation: its id, the faults found, the cost and audit of its repair and a digest of the turns left.

    ``gaps`` are missing numbers between the first and the last turn, ``illegal`` the neighbours whose roles do not
    follow each other; a turn has one fault, blank before duplicate before truncated.
    """
    kind = dict(conversations.dtypes)[conv_column]
    rows = _turns(conversations, conv_column, turn_column, role_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, None, []
        for batch in batches:
            names = schema_of(batch)
            for part in slices(batch):
                for conv, turn, role, text, repeats in zip(*(c.to_pylist() for c in part.columns)):
                    if held is None or conv != at:
                        if held is not None:
                            done.append([at, *held.row()])
                        at, held = conv, _Conversation()
                    held.add(turn, role, text, repeats)
                if len(done) >= 1000:
                    yield written(done, names)
                    done = []
        if held is not None:
            yield written([*done, [at, *held.row()]], names)

    def schema_of(batch: pa.RecordBatch) -> pa.Schema:
        longs = [pa.field(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        texts = [pa.field(x, pa.string()) for x in ("audit", "repaired_sha256")]
        return pa.schema([pa.field("conv", batch.schema.field("conv").type), *longs, *texts])

    def written(done: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    found = _in_order(rows).mapInArrow(run, f"conv {kind}, {SUMMARY}")
    return found.withColumnRenamed("conv", conv_column)


def repaired_turns(
    conversations: DataFrame, summary: DataFrame, conv_column="conv_id", turn_column="turn", role_column="role", text_column="text",
) -> DataFrame:
    """The turns that ``repair`` leaves: id, position from 0, role, text and the edit that made them (K, R or I)."""
    kind = dict(conversations.dtypes)[conv_column]
    rows = _turns(conversations, conv_column, turn_column, role_column, text_column)
    rows = rows.select("conv", F.lit(1).alias("part"), "turn", "role", "text", F.lit("").alias("audit"))
    none = F.lit(None)
    heads = summary.select(
        F.col(conv_column).alias("conv"), F.lit(0).alias("part"), none.cast("long").alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"), "audit",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, system, conv = "", 0, 0, 0, None

        def said(role: str | None, text: str, edit: str):
            nonlocal place, system
            if edit == "K" and place == 0 and role.startswith("s"):
                system = 1
            name = role if edit == "K" else ROLES["ua"[(place - system) % 2]]
            place += 1
            return conv, place - 1, name, text, edit

        for batch in batches:
            out = []
            for c, part, _, role, text, edits in zip(*(x.to_pylist() for x in batch.columns)):
                if part == 0:
                    conv, audit, at, place, system = c, edits, 0, 0, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        out.append(said(role, text, edit))
                while at < len(audit) and audit[at] == "I":
                    out.append(said(None, "", "I"))
                    at += 1
            if out:
                types = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                arrays = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv", "position", "role", "text", "edit"])

    found = _in_order(rows.unionByName(heads), "part").mapInArrow(run, f"conv {kind}, position long, role string, text string, edit string")
    return found.withColumnRenamed("conv", conv_column)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with faults by a checksum of their id and turn: 0 of 20 drops a row, 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it a user's. Nulls are one blank."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", times.alias("__time")).drop("__time")


def digests(conversations: DataFrame) -> DataFrame:
    """The summary of every conversation after its rows were ``damaged``; one without rows has zeros."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "__id")
    ids = conversations.select("conv_id").distinct()
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    none = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none["audit"] = F.coalesce("audit", F.lit(""))
    none["repaired_sha256"] = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return rows.withColumns(none)
