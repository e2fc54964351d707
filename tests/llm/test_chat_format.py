"""Chat repair: least cost against all ways by brute force, blocks against whole, rendering, edge cases."""

import itertools
import random

from pyspark.sql import functions as F

from mnemora.llm import chat_format as cf


def brute(roles):
    """Least cost over all ways, by trying every role or merge for every turn."""
    best = float("inf")
    for choice in itertools.product((*cf.ROLES, "merge"), repeat=len(roles)):
        cost, state = 0.0, "start"
        for role, c in zip(roles, choice):
            if c == "merge":
                if state == "start":
                    break
                cost += cf.MERGE + cf.role_cost(role, state)
                continue
            put = 0
            if c not in cf.NEXT[state]:
                if not any(c in cf.NEXT[x] for x in cf.NEXT[state]):
                    break
                put = 1
            cost += put * cf.INSERT + cf.role_cost(role, c)
            state = c
        else:
            best = min(best, cost + (2 * cf.INSERT if state == "system" else 0))
    return best


def legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line.endswith("|>")]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def conversations(seed, n=120, longest=6):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            rows.append((c, t, rnd.choice(("user", "assistant", "assistant", "system", None, "tool")), f"text {c} {t}"))
    return rows


def test_least_cost_whole_and_in_runs(spark):
    rows = conversations(1) + [(None, t, "user", f"none {t}") for t in range(3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, run string, cost int").repartition(3)
    want = {}
    for c in {r[0] for r in rows}:
        roles = [r[2] if r[2] in cf.ROLES else None for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        want[c] = brute(roles)
    whole = {r.conv: r for r in cf.render(df).collect()}
    assert len(whole) == cf.render(df).count() and {c: r.cost for c, r in whole.items()} == want
    assert all(legal(r.rendered) for r in whole.values())
    for c, t, _, x in rows:
        assert x in whole[c].rendered
    for hot in (1, 3):  # all but the shortest conversations in runs
        assert {r.conv: r for r in cf.render(df, hot_turns=hot).collect()} == whole
    turns = sorted(map(str, cf.repair(df).collect()))
    assert turns == sorted(map(str, cf.repair(df, hot_turns=2).collect())) and len(turns) == len(rows)


def test_hot_conversations_are_cut(spark):
    """A third of all turns without an id, many of them alike; one conversation of many turns: one row each."""
    rnd = random.Random(4)
    rows = [(None, None, "user", "same")] * 300 + [(777, t, rnd.choice(("user", "assistant", "system")), f"t{t}") for t in range(400)] + conversations(5, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert cf.chat_digest(df).count() == 62
    assert {r.conv: (r.rendered, r.cost) for r in cf.render(df, hot_turns=50).collect()} == {r.conv: (r.rendered, r.cost) for r in cf.render(df).collect()}


def test_render_and_edge_cases(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Human", "hi"), (1, 2, "user", "there"), (1, 3, "gpt", "hello"), (2, 0, "system", "only"), (3, 0, "user", None), (None, None, "user", "a"), (None, 0, "user", "b"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r.rendered for r in cf.render(df).collect()}
    assert got[1] == "<|system|>\nbe kind\n<|user|>\nhi\nthere\n<|assistant|>\nhello\n"
    assert got[2] == "<|user|>\nonly\n"  # one relabel is cheaper than two empty turns
    assert got[3] == "<|user|>\n\n" and got[None] == "<|user|>\na\nb\n" and got[4] == "<|user|>\nsame\nsame\n"
    assert cf.repair(df).count() == len(rows) and cf.chat_digest(df.limit(0)).count() == 0
    long = spark.range(3_000).select(F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    assert cf.render(long).agg(F.count("*"), F.sum("n_turns"), F.sum("cost")).first()[:] == (1, 3000, 0.0)
    assert cf.render(df.limit(0), hot_turns=0).count() == 0
