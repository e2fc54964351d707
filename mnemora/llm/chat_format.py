"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant turns in alternation from user
to assistant. Dynamic programming over this automaton finds the cheapest edits: a turn is kept, relabelled to the
role that the automaton asks for, or merged into the turn before; where a turn is wanting an empty one is put in.
The repaired sequence is then rendered.

Conversations are dealt by id and sorted, and a task reads them one after the other. One of very many turns (`HOT`)
is cut into runs of neighbouring turns by a range partitioning of its own: the cost matrices of the runs, each least
cost from each state to each, are chained by min-plus products; then each run repairs its own turns, given what a way
costs up to its begin and the state in which the best way leaves it. Both routes choose the same of several best ways.

Defined cases: a null or unknown role costs nothing to relabel; a null text is empty; turns are ordered by turn
number (null first), then role and text; repeated rows are turns of their own; rows without a conversation id form
one conversation, however many they are; an empty table gives an empty table; other columns are not read. A rendered
conversation is one value, so its text must fit a row (2 GB); `repair` has a row a turn and no such bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

ROLES = ("system", "user", "assistant")
#: Other names of the roles that chat data use (fixed values).
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "developer": "system"}
#: States: the role of the turn written last, before any turn `start`.
STATES = ("start", *ROLES)
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Costs of the edits; an empty insertion costs most, as it invents a turn.
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
RELABEL_SYSTEM = 4.0
#: Conversations of more turns or characters are cut into runs, but at most `MOST` of each kind: beyond, the bound grows
#: with the table, to its `MOST`th part.
HOT_TURNS, HOT_CHARS, MOST = 2_000, 16_000_000, 100_000
TEMPLATE = "<|{role}|>\n{text}\n"
KEEP, RELABELLED, MERGED = "keep", "relabel", "merge"


def role_cost(role: str | None, to: str) -> float:
    """Cost of giving a turn of role `role` the role `to`."""
    if role == to or role not in ROLES:
        return 0.0
    return RELABEL_SYSTEM if "system" in (role, to) else RELABEL


def moves(role: str | None) -> list[tuple[int, int, float, str, tuple[str, ...]]]:
    """Ways to take one turn: state before, state after, cost, edit, and the roles of empty turns put in first."""
    out = []
    for a, state in enumerate(STATES):
        if state != "start":
            out.append((a, a, MERGE + role_cost(role, state), MERGED, ()))
        for first in NEXT[state]:
            kind = KEEP if role == first or role not in ROLES else RELABELLED
            out.append((a, STATES.index(first), role_cost(role, first), kind, ()))
            for second in NEXT[first]:
                kind = KEEP if role == second or role not in ROLES else RELABELLED
                out.append((a, STATES.index(second), INSERT + role_cost(role, second), kind, (first,)))
    return out


#: Cost of ending in a state: a conversation ends with an assistant turn, or is left without one after a user turn.
END = (0.0, INSERT + INSERT, 0.0, 0.0)
MOVES = {r: moves(r) for r in (*ROLES, None)}


Costs = tuple[float, float, float, float]
INFINITE = float("inf")
UNITS: tuple[Costs, ...] = tuple(tuple(0.0 if a == b else INFINITE for b in range(4)) for a in range(4))
_steps: dict[tuple[Costs, str | None], tuple[Costs, float, tuple]] = {}


def step(costs: Costs, role: str | None) -> tuple[Costs, float, tuple]:
    """Costs of the states after one more turn, less their minimum; this minimum; and by state the move that led to it.

    Of equal moves the one listed first is taken. Few cost vectors occur, as they are relative, so steps are remembered.
    """
    got = _steps.get((costs, role))
    if got is None:
        new, came = [INFINITE] * 4, [None] * 4
        for a, b, cost, kind, put in MOVES[role]:
            if costs[a] + cost < new[b]:
                new[b], came[b] = costs[a] + cost, (a, kind, put)
        low = min(new)
        got = _steps[costs, role] = tuple(c - low for c in new), low, tuple(came)
    return got


def forward(roles: list[str | None], costs: Costs) -> tuple[list[tuple], Costs, float]:
    """Moves by turn and state, and costs after the last turn with their minimum apart."""
    moves_, total = [], 0.0
    for r in roles:
        costs, low, came = step(costs, r)
        total += low
        moves_.append(came)
    return moves_, costs, total


def trace(moves_: list[tuple], leave: int) -> tuple[list[tuple[int, str, tuple[str, ...]]], int]:
    """Per turn the state after it, the edit and the insertions of the best way that leaves in `leave`; where it enters."""
    out, b = [], leave
    for came in reversed(moves_):
        a, kind, put = came[b]
        out.append((b, kind, put))
        b = a
    return out[::-1], b


def last_state(costs: Costs) -> int:
    return min(range(4), key=lambda b: costs[b] + END[b])


def _role(column: str):
    role = F.lower(F.trim(F.col(column).cast("string")))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, role), F.when(role.isin(*ROLES), role))


# --- what a run of turns becomes ----------------------------------------------------------------------------------


Rows = dict[str, list]
PART = pa.schema([("conv", pa.int64()), ("run", pa.int64()), ("rendered", pa.string()), ("n_turns", pa.int64()), ("cost", pa.float64()), ("n_relabelled", pa.int64()), ("n_merged", pa.int64()), ("n_inserted", pa.int64())])
PART_DDL = "conv long, run long, rendered string, n_turns long, cost double, n_relabelled long, n_merged long, n_inserted long"
TURN = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("edit", pa.string()), ("put", pa.list_(pa.string())), ("text", pa.string())])
TURN_DDL = "conv long, at long, turn long, role string, edit string, put array<string>, text string"


def turn_rows(conv, run: int, at: int, turns: list, roles: list, texts: list, found: list, enter: int, last: bool) -> Rows:
    n = len(roles)
    return {"conv": [conv] * n, "at": list(range(at, at + n)), "turn": turns, "role": [STATES[b] for b, _, _ in found], "edit": [k for _, k, _ in found], "put": [list(p) for _, _, p in found], "text": texts}


def part_row(conv, run: int, at: int, turns: list, roles: list, texts: list, found: list, enter: int, last: bool) -> Rows:
    """The rendered run: a turn begins a new line, but the first of the conversation; the last run ends it."""
    out, n, cost, edits = [], 0, 0.0, dict.fromkeys((KEEP, RELABELLED, MERGED, "put"), 0)
    for k, (role, text, (b, kind, put)) in enumerate(zip(roles, texts, found)):
        if kind == MERGED:
            out.append("\n" + text)
        else:
            out.append("" if k == 0 and enter == 0 else "\n")
            out += [TEMPLATE.format(role=p, text="") for p in put]
            out.append(f"<|{STATES[b]}|>\n{text}")
            n += 1 + len(put)
        cost += role_cost(role, STATES[b]) + MERGE * (kind == MERGED) + INSERT * len(put)
        edits["put"] += len(put)
        edits[kind] += 1
    if last:
        out.append("\n")
        if STATES[found[-1][0]] == "system":
            out += [TEMPLATE.format(role=p, text="") for p in ("user", "assistant")]
            n, cost, edits["put"] = n + 2, cost + END[1], edits["put"] + 2
    return {"conv": [conv], "run": [run], "rendered": ["".join(out)], "n_turns": [n], "cost": [cost], "n_relabelled": [edits[RELABELLED]], "n_merged": [edits[MERGED]], "n_inserted": [edits["put"]]}


Make = Callable[..., Rows]


def _batch(rows: list[Rows], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in r[f.name]], f.type) for f in schema], schema=schema)


# --- conversations that one task reads --------------------------------------------------------------------------


def _whole(make: Make, schema: pa.Schema):
    """Over sorted turns, partition by partition: each conversation when its last turn has come."""

    def solved(conv, turns, roles, texts) -> Rows:
        moves_, costs, _ = forward(roles, UNITS[0])
        found, enter = trace(moves_, last_state(costs))
        return make(conv, 0, 0, turns, roles, texts, found, enter, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, ([], [], [])
        for batch in batches:
            own, *columns = (batch.column(k).to_pylist() for k in range(4))
            out, begin = [], 0
            while begin < len(own):
                end = begin + 1
                while end < len(own) and own[end] == own[begin]:
                    end += 1
                if held[1] and own[begin] != conv:
                    out.append(solved(conv, *held))
                    held = [], [], []
                conv = own[begin]
                for h, c in zip(held, columns):
                    h += c[begin:end]
                begin = end
            if out:
                yield _batch(out, schema)
        if held[1]:
            yield _batch([solved(conv, *held)], schema)

    return run


# --- conversations in runs -------------------------------------------------------------------------------------------


def _matrix(table: pa.Table) -> pa.Table:
    """Least cost from each state to each through a run, and its turns."""
    roles = table.sort_by("seq").column("role").to_pylist()
    cost = []
    for unit in UNITS:
        _, costs, low = forward(roles, unit)
        cost += [c + low for c in costs]
    return pa.table({"conv": table.column("conv").slice(0, 1), "run": table.column("run").slice(0, 1), "cost": pa.array([cost], pa.list_(pa.float64())), "n": pa.array([len(roles)], pa.int64())})


def _chain(table: pa.Table) -> pa.Table:
    """By run of a conversation the costs of the states in which it is entered, the turns before it, whether it is the last."""
    table = table.sort_by("run")
    costs, at, before, places = UNITS[0], 0, [], []
    for m, n in zip(table.column("cost").to_pylist(), table.column("n").to_pylist()):
        before.append(list(costs))
        places.append(at)
        new = [min(costs[a] + m[4 * a + b] for a in range(4)) for b in range(4)]
        costs, at = tuple(c - min(new) for c in new), at + n
    return pa.table({"conv": table.column("conv"), "run": table.column("run"), "before": pa.array(before, pa.list_(pa.float64())), "at": pa.array(places, pa.int64()), "end": pa.array([None] * (len(before) - 1) + [last_state(costs)], pa.int32())})


def _entries(table: pa.Table) -> pa.Table:
    """By state in which a run is left the state in which the best way enters it."""
    roles = table.sort_by("seq").column("role").to_pylist()
    moves_, costs, _ = forward(roles, tuple(table.column("before")[0].as_py()))
    enter = [trace(moves_, b)[1] if costs[b] < INFINITE else -1 for b in range(4)]
    one = lambda c: table.column(c).slice(0, 1)
    return pa.table({"conv": one("conv"), "run": one("run"), "before": one("before"), "at": one("at"), "end": one("end"), "enter": pa.array([enter], pa.list_(pa.int32()))})


def _leaves(table: pa.Table) -> pa.Table:
    """By run the state in which the best way of the conversation leaves it."""
    table = table.sort_by("run")
    enter, leave = table.column("enter").to_pylist(), [0] * len(table)
    state = table.column("end")[-1].as_py()
    for k in range(len(table) - 1, -1, -1):
        leave[k] = state
        state = enter[k][state]
    return pa.table({"c": table.column("conv"), "u": table.column("run"), "before": table.column("before"), "at": table.column("at"), "leave": pa.array(leave, pa.int32()), "last": pa.array([k == len(table) - 1 for k in range(len(table))], pa.bool_())})


def _run(make: Make, schema: pa.Schema):
    def solved(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        conv, run, before, at, leave, last = (table.column(c)[0].as_py() for c in ("conv", "run", "before", "at", "leave", "last"))
        turns, roles, texts = (table.column(c).to_pylist() for c in ("turn", "role", "text"))
        found, enter = trace(forward(roles, tuple(before))[0], leave)
        return pa.Table.from_batches([_batch([make(conv, run, at, turns, roles, texts, found, enter, last)], schema)])

    return solved


def _in_runs(rows: DataFrame, runs: int, make: Make, schema: pa.Schema, ddl: str) -> DataFrame:
    """The conversations of `rows` by runs: neighbouring turns of one conversation within one of `runs` ranges."""
    order = ["conv", "turn", "role", "text", "tie"]  # rows that are alike in all else may lie in several ranges
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(runs, *order).sortWithinPartitions(*order)
    seq = F.monotonically_increasing_id()
    numbered = materialise(dealt.select("conv", "turn", "role", "text", seq.alias("seq")).withColumn("run", F.shiftright("seq", 33)))
    same = lambda d: F.col("conv").eqNullSafe(d["c"]) & (F.col("run") == d["u"])
    roles = numbered.select("conv", "run", "seq", "role")
    matrices = roles.groupBy("conv", "run").applyInArrow(_matrix, "conv long, run long, cost array<double>, n long")
    entered = materialise(matrices.groupBy("conv").applyInArrow(_chain, "conv long, run long, before array<double>, at long, end int"))
    begun = entered.withColumnsRenamed({"conv": "c", "run": "u"})
    ways = roles.join(begun, same(begun)).drop("c", "u").groupBy("conv", "run").applyInArrow(_entries, "conv long, run long, before array<double>, at long, end int, enter array<int>")
    states = materialise(ways.groupBy("conv").applyInArrow(_leaves, "c long, u long, before array<double>, at long, leave int, last boolean"))
    return numbered.join(states, same(states)).drop("c", "u").groupBy("conv", "run").applyInArrow(_run(make, schema), ddl)


def _solved(df: DataFrame, conv: str, turn: str, role: str, text: str, make: Make, schema: pa.Schema, ddl: str, hot_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """What `make` gives for the conversations that one task reads, and for those in runs, if there are any."""
    base = df.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), _role(f"`{role}`").alias("role"), text_of(f"`{text}`").alias("text"))
    sizes = base.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    turns, chars = max(hot_turns, every.n // MOST), max(HOT_CHARS, every.chars // MOST)
    hot = materialise(sizes.filter((F.col("n") > turns) | (F.col("chars") > chars)).withColumnsRenamed({"conv": "c"}))  # at most 2 MOST
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    order = ["conv", "turn", "role", "text"]
    if not total.n:
        return base.repartition("conv").sortWithinPartitions(*order).mapInArrow(_whole(make, schema), ddl), None
    ids = F.broadcast(hot.select("c"))
    usual = base.join(ids, F.col("conv").eqNullSafe(F.col("c")), "left_anti")
    long = base.join(ids, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    whole = usual.repartition("conv").sortWithinPartitions(*order).mapInArrow(_whole(make, schema), ddl)
    return whole, _in_runs(long, max(-(-total.n // turns), -(-total.chars // chars)), make, schema, ddl)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_turns: int = HOT_TURNS) -> DataFrame:
    """One row a turn: `conv`, `at` (place in the conversation), `turn`, `role`, `edit`, `put` (empty turns before), `text`."""
    whole, runs = _solved(df, conv, turn, role, text, turn_rows, TURN, TURN_DDL, hot_turns)
    return whole if runs is None else whole.unionByName(runs)


def render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_turns: int = HOT_TURNS) -> DataFrame:
    """One row a conversation: `conv`, `rendered`, counts of turns and edits, and the cost.

    A merged turn follows the text before it after one line feed; a conversation that ends with the system's turn gets
    an empty turn of both others.
    """
    whole, parts = _solved(df, conv, turn, role, text, part_row, PART, PART_DDL, hot_turns)
    if parts is None:
        return whole.drop("run")
    sums = [F.sum(c).alias(c) for c in ("n_turns", "cost", "n_relabelled", "n_merged", "n_inserted")]
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "rendered"))), lambda p: p["rendered"]), "")
    return whole.drop("run").unionByName(parts.groupBy("conv").agg(joined.alias("rendered"), *sums))


def chat_digest(df: DataFrame) -> DataFrame:
    """Per conversation the counts of edits, the cost, and the rendered text's length and digest."""
    return render(df).select(F.col("conv").alias("conv_id"), "n_turns", "cost", "n_relabelled", "n_merged", "n_inserted", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
