"""Repair of damaged conversations: least-cost edits over a role automaton, the ASCII-least of all cheapest edit strings.

A legal sequence of role initials is `(s?(ua)+)?`. Turns are kept (K), given the other speaker's role (R), deleted (D), or
an empty turn is put in (I). Nodes are (turns taken, state); least costs from the start and to the end show which arcs are
tight, that is on some cheapest way. A frontier of nodes goes along tight arcs, each time by the least letter that leaves
it. The letters alone fix the roles, as they alternate from the first kept or inserted turn.

Turns are sorted over the whole table by ranges, so a long conversation lies in several tasks; each task packs
neighbouring turns of one conversation into blocks. Conversations inside a task are solved there. The blocks of the others
are chained: by min-plus products of their cost matrices, least costs reach every block from both ends, and the state in
which the frontier enters each block follows from the states in which it leaves the one before. Only the blocks' matrices
meet by conversation. A digest needs all text of a conversation in order, so there it is read as a stream by one task.

Defined cases: null conversations, turns, roles and texts count as one space in the damage's key, null roles and texts
are one space; a null turn sorts first and is no gap; turns with the same number go by role, the first 32 characters of
their text, then its MD5; rows alike in all are neighbours, the later ones duplicates, and are counted before they are
dealt; rows without a conversation are one conversation; a conversation that loses all its rows has zeros, an empty
audit and the digest of nothing; texts are compared by MD5; other columns are not read, whatever their names; an empty
table gives an empty table. An audit is one value, so a conversation's turns must be fewer than 2^31.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise

#: States: the initial of the turn before, `-` at the start.
STATES = "-sua"
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0.0, 3.0, 4.0, 3.0, 3.0
LEGAL = {"su", "ua", "au"}
#: By state the state that a speaker's turn leads to, and its role.
SPEAK = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: Bounds of a block, in turns and characters.
BLOCK_TURNS, BLOCK_CHARS = 4096, 4_000_000
FAULTS = ("", "blank", "duplicate", "truncated")
INF = float("inf")
Vector = tuple[float, float, float, float]


def moves(kind: str) -> list[tuple[str, int, int, float]]:
    """Ways to take one turn: letter, state before, state after, cost. `kind`: the initial and `!` where it is
    truncated; `x` where it must go."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if kind == "x":
        return out
    more = TRUNCATED if kind.endswith("!") else 0.0
    if kind[0] == "s":
        out.append(("K", 0, 1, KEEP_COST + more))
    for q, (to, role) in SPEAK.items():
        if kind[0] == role[0]:
            out.append(("K", q, to, KEEP_COST + more))
        out.append(("R", q, to, REROLE + more))
    return out


KINDS = ("x", *(c + t for c in "sua?" for t in ("", "!")))
MOVES = {k: moves(k) for k in KINDS}
START: Vector = (0.0, INF, INF, INF)


def _inserted(costs: list[float], backwards: bool = False) -> list[float]:
    """Costs with insertions: on the way from the start to each state, or from each state to the end."""
    for _ in range(2):
        for q, (to, _) in SPEAK.items():
            a, b = (q, to) if backwards else (to, q)
            costs[a] = min(costs[a], costs[b] + INSERT)
    return costs


#: Least cost to an end from each state: nothing, or a whole pair.
END: Vector = tuple(_inserted([0.0, INF, INF, 0.0], backwards=True))
_steps: dict[tuple, tuple[Vector, float]] = {}


def step(costs: Vector, kind: str, backwards: bool) -> tuple[Vector, float]:
    """Costs on the other side of a turn, less their minimum, and that; few vectors occur, so steps are remembered."""
    got = _steps.get((costs, kind, backwards))
    if got is None:
        new = [INF] * 4
        for _, q, to, cost in MOVES[kind]:
            a, b = (q, to) if backwards else (to, q)
            new[a] = min(new[a], costs[b] + cost)
        new = _inserted(new, backwards)
        low = min(new)
        got = _steps[costs, kind, backwards] = tuple(c - low for c in new), low
    return got


def sweep(kinds: list[str], costs: Vector, backwards: bool = False) -> tuple[list[Vector], list[float]]:
    """By level, first to last, the relative costs and their minimum."""
    vectors, lows, total = [costs], [0.0], 0.0
    for k in reversed(kinds) if backwards else kinds:
        costs, low = step(costs, k, backwards)
        total += low
        vectors.append(costs)
        lows.append(total)
    return (vectors[::-1], lows[::-1]) if backwards else (vectors, lows)


def traverse(kinds: list[str], before: Vector, after: Vector, enter: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """From state `enter` the tight arcs of least letters, as letters with the state after them, and the state left in.

    `before`: least costs to the states at the first level; `after`: from the states at the last level to the end.
    """
    f, f_low = sweep(kinds, before)
    b, b_low = sweep(kinds, after, backwards=True)
    best = min(x + y for x, y in zip(f[0], b[0])) + b_low[0]
    out, frontier, i, n = [], {enter}, 0, len(kinds)
    while i < n or last:
        base, arcs = f_low[i] - best, {}
        for q in frontier:
            to = SPEAK[q][0]
            if f[i][q] + INSERT + b[i][to] + base + b_low[i] == 0:
                arcs.setdefault("I", set()).add(to)
            if i < n:
                for letter, a, to, cost in MOVES[kinds[i]]:
                    if a == q and f[i][q] + cost + b[i + 1][to] + base + b_low[i + 1] == 0:
                        arcs.setdefault(letter, set()).add(to)
        if not arcs:
            break  # at the end
        letter = min(arcs)
        frontier = arcs[letter]
        i += letter != "I"
        out.append((letter, min(frontier)))
    return out, min(frontier)


# --- damage and faults ------------------------------------------------------------------------------------------------


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv`, `turn`, `role`, `text` and `copies` of the rows after damage; dropped rows have no copies."""
    c, t = F.col(f"`{conv}`"), F.col(f"`{turn}`").cast("long")
    what = F.crc32(F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(t.cast("string"), F.lit(" "))).cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    return df.select(
        c.alias("conv"), t.alias("turn"), F.when(what == 4, "user").otherwise(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" "))).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def untouched(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns without damage."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows alike in all as one with their number, and the first fault of the first; a conversation with dropped rows
    has a row without copies besides.

    Only texts that a conversation has several times are joined with the place of their first; a very common one is
    met where its rows lie.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), F.col("role"), F.col("text")).cast("binary"))
    there = rows.filter("copies > 0").withColumn("mark", mark)
    firsts = materialise(there.groupBy("mark").agg(F.sum("copies").alias("rows"), F.min(place).alias("first")).filter("rows > 1"))
    met = join_hot(there, firsts, "mark", "rows").drop("mark")
    again = met.filter("first IS NOT NULL").groupBy("conv", "turn", "role", "text", "first").agg(F.sum("copies").alias("copies"))
    every = met.filter("first IS NULL").select(*again.columns).unionByName(again)
    end = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(end == "", 1).when(F.col("first").isNotNull() & (place != F.col("first")), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    gone = rows.filter("copies = 0").select("conv").distinct()
    nothing = gone.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("fault"))
    return every.select("conv", "turn", "role", "text", "copies", fault.alias("fault")).unionByName(nothing)


# --- blocks -----------------------------------------------------------------------------------------------------------


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
BLOCK = "run long, whole boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", first_role string, last_role string, first_turn long, last_turn long, matrix array<double>, kinds array<string>, copies array<long>, roles array<string>, texts array<string>"


class _Block:
    """Neighbouring turns of one conversation, with what their sums need."""

    def __init__(self, conv):
        self.conv, self.chars = conv, 0
        self.rows: list[tuple] = []

    def summary(self, run: int, whole: bool) -> dict:
        counts, kinds, before, turn = dict.fromkeys(COUNTS, 0), [], None, None
        for t, role, _, copies, fault in self.rows:
            initial = role[:1]
            if before is not None:
                counts["illegal"] += before + initial not in LEGAL
            if fault:
                counts[FAULTS[fault]] += 1
            counts["blank" if fault == 1 else "duplicate"] += copies - 1
            counts["illegal"] += copies - 1
            counts["turns"] += t is not None and t != turn
            kinds.append("x" if fault in (1, 2) else (initial if initial in "sua" and initial else "?") + ("!" if fault == 3 else ""))
            before, turn = initial, t
        matrix = []
        if not whole:
            for q in range(4):
                vectors, lows = sweep(kinds, tuple(_inserted([0.0 if p == q else INF for p in range(4)])))
                matrix += [c + lows[-1] for c in vectors[-1]]
        known = [r[0] for r in self.rows if r[0] is not None]
        ends = {"first_role": self.rows[0][1][:1], "last_role": before} if self.rows else {"first_role": None, "last_role": None}
        return counts | ends | {"conv": self.conv, "run": run, "whole": whole, "first_turn": min(known, default=None), "last_turn": max(known, default=None), "matrix": matrix, "kinds": kinds, "copies": [r[3] for r in self.rows], "roles": [r[1] for r in self.rows], "texts": [r[2] for r in self.rows]}


def _schema(conv: pa.DataType, ddl: str) -> pa.Schema:
    plain = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([("conv", conv)] + [(n, pa.list_(plain[t[6:-1]]) if t.startswith("array") else plain[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted turns of a partition. The first and the last conversation may go on in another."""
    run, block, inner, schema = TaskContext.get().partitionId() << 33, None, False, None
    whole_blocks = 0  # of the conversation so far
    for batch in batches:
        schema = schema or _schema(batch.schema.field(0).type, BLOCK)
        out = []
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or conv != block.conv:
                if block is not None:
                    out.append(block.summary(run, inner and not whole_blocks))
                    run, inner, whole_blocks = run + 1, True, 0
                block = _Block(conv)
            elif len(block.rows) >= BLOCK_TURNS or block.chars >= BLOCK_CHARS:
                out.append(block.summary(run, False))
                run, whole_blocks, block = run + 1, whole_blocks + 1, _Block(conv)
            if row[3]:
                block.rows.append(tuple(row))
                block.chars += len(row[2])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if block is not None:
        yield pa.RecordBatch.from_pylist([block.summary(run, False)], schema)


def _chained(table: pa.Table) -> pa.Table:
    """By block of a conversation the least costs to its first level and from its last level to the end."""
    table = table.sort_by("run")
    matrices = [[m[4 * q : 4 * q + 4] for q in range(4)] for m in table.column("matrix").to_pylist()]
    before, costs = [], _inserted(list(START))
    for m in matrices:
        before.append([c - min(costs) for c in costs])
        costs = [min(costs[q] + m[q][p] for q in range(4)) for p in range(4)]
    after, costs = [], list(END)
    for m in reversed(matrices):
        after.append([c - min(costs) for c in costs])
        costs = [min(m[q][p] + costs[p] for p in range(4)) for q in range(4)]
    n = len(matrices)
    return pa.table({"run": table.column("run"), "before": pa.array(before, pa.list_(pa.float64())), "after": pa.array(after[::-1], pa.list_(pa.float64())), "last": pa.array([k == n - 1 for k in range(n)], pa.bool_())})


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By state in which the frontier enters a block the state in which it leaves it; -1 where no cheapest way enters."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            before, after = tuple(r["before"]), tuple(r["after"])
            b, lows = sweep(r["kinds"], after, backwards=True)
            best = min(x + y for x, y in zip(before, b[0]))
            rows.append({"conv": r["conv"], "run": r["run"], "leave": [traverse(r["kinds"], before, after, q, r["last"])[1] if before[q] + b[0][q] == best else -1 for q in range(4)]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _schema(batch.schema.field("conv").type, "run long, leave array<int>"))


def _entered(table: pa.Table) -> pa.Table:
    """By block the state in which the frontier enters it."""
    table, state, enter = table.sort_by("run"), 0, []
    for leave in table.column("leave").to_pylist():
        enter.append(state)
        state = leave[state]
    return pa.table({"run": table.column("run"), "enter": pa.array(enter, pa.int32())})


# --- results ----------------------------------------------------------------------------------------------------------


EDGES = ("first_role", "last_role", "first_turn", "last_turn")
PART = "run long, whole boolean, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", first_role string, last_role string, first_turn long, last_turn long, audit string, roles array<string>, texts array<string>"


def _edited(r: dict, before: Vector, after: Vector, enter: int, last: bool) -> dict:
    """What the edits make of a block: the repaired turns, the letters with those of later copies, and their cost."""
    arcs, _ = traverse(r["kinds"], before, after, enter, last)
    audit, roles, texts, cost, i = [], [], [], 0.0, 0
    for letter, state in arcs:
        audit.append(letter)
        speaker = "user" if STATES[state] == "u" else "assistant"
        if letter == "I":
            roles.append(speaker)
            texts.append("")
            cost += INSERT
            continue
        if letter != "D":
            roles.append(r["roles"][i] if letter == "K" else speaker)
            texts.append(r["texts"][i])
            cost += TRUNCATED * r["kinds"][i].endswith("!")
        later = r["copies"][i] - 1
        audit.append("D" * later)
        cost += {"K": KEEP_COST, "R": REROLE, "D": DELETE}[letter] + DELETE * later
        i += 1
    return {c: r[c] for c in ("conv", "run", "whole", *COUNTS, *EDGES)} | {"audit": "".join(audit), "roles": roles, "texts": texts, "cost": int(cost)}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if rows := [_edited(r, tuple(_inserted(list(START))), END, 0, True) for r in batch.to_pylist()]:
            yield pa.RecordBatch.from_pylist(rows, _schema(batch.schema.field("conv").type, PART))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if rows := [_edited(r, tuple(r["before"]), tuple(r["after"]), r["enter"], r["last"]) for r in batch.to_pylist()]:
            yield pa.RecordBatch.from_pylist(rows, _schema(batch.schema.field("conv").type, PART))


def solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By block of a conversation its counts, its ends, the letters and the repaired turns: of conversations that one
    task has as one block, and of the others."""
    kind = rows.schema["conv"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    order = ["conv", "turn", "role", "head", "md5"]
    dealt = rows.withColumn("head", F.substring(text, 1, 32)).withColumn("md5", F.md5(text.cast("binary"))).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = materialise(dealt.select("conv", "turn", "role", "text", "copies", "fault").mapInArrow(_packed, f"conv {kind}, {BLOCK}"))
    some = packed.filter("NOT whole")
    ends = materialise(some.select("conv", "run", "matrix").groupBy("conv").applyInArrow(_chained, "run long, before array<double>, after array<double>, last boolean"))
    left = some.select("conv", "run", "kinds").join(ends, "run").mapInArrow(_left, f"conv {kind}, run long, leave array<int>")
    states = ends.join(left.groupBy("conv").applyInArrow(_entered, "run long, enter int"), "run")
    ddl = f"conv {kind}, {PART}"
    return packed.filter("whole").mapInArrow(_whole, ddl), some.join(states, "run").mapInArrow(_parts, ddl)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns of a table that is taken as it is: `conv`, `run` and `at` (their order), `role`, `text`."""
    turns = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "t")
    whole, parts = solved(with_faults(untouched(df, conv, turn, role, text)))
    return whole.unionByName(parts).select("conv", "run", turns).select("conv", "run", "at", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Sum:
    """Blocks of one conversation, added in their order."""

    def __init__(self, conv):
        self.conv, self.counts, self.audit, self.hash, self.any = conv, dict.fromkeys((*COUNTS, "cost"), 0), [], hashlib.sha256(), False
        self.low = self.high = self.role = None

    def add(self, r: dict) -> None:
        for c in self.counts:
            self.counts[c] += r[c]
        if self.role is not None and r["first_role"] is not None:
            self.counts["illegal"] += self.role + r["first_role"] not in LEGAL
        self.role = r["last_role"] if r["last_role"] is not None else self.role
        if r["first_turn"] is not None:
            self.counts["turns"] -= self.high == r["first_turn"]
            self.low = r["first_turn"] if self.low is None else self.low
            self.high = r["last_turn"]
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"]):
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return self.counts | {"conv": self.conv, "gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that lie in order, conversation by conversation, as one row each."""
    now, schema = None, None
    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv").type, DIGEST)
        out = []
        for r in batch.to_pylist():
            if now is None or now.conv != r["conv"]:
                if now is not None:
                    out.append(now.row())
                now = _Sum(r["conv"])
            now.add(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def repair_digest(df: DataFrame) -> DataFrame:
    """Per conversation of the damaged table the faults, the least cost, the audit of edits and the repaired turns' digest."""
    whole, parts = solved(with_faults(damaged(df)))
    ddl = f"conv {whole.schema['conv'].dataType.simpleString()}, {DIGEST}"
    out = whole.mapInArrow(_added, ddl).unionByName(parts.repartition("conv").sortWithinPartitions("conv", "run").mapInArrow(_added, ddl))
    return out.withColumnRenamed("conv", "conv_id")
