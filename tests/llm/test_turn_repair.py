"""Turn repair against a search over all edits, whole and in blocks, and the defined edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from mnemora.llm import queries as q
from mnemora.llm import turn_repair as tr
from tests.test_queries import FOLDER

COLUMNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (1 + (what == 3))
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by Dijkstra over (turns taken, initials so far cut to what decides), least audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(turns) and LEGAL.fullmatch(roles):
            return cost, audit, made
        state = (i, roles[-1:])
        if state in done:
            continue
        done.add(state)
        if len(audit) < 3 * len(turns) + 4:
            for r in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", roles + r[0]):
                    heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r[0], (*made, f"{r}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, made))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for r, letter, c in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if re.fullmatch("s?(ua)*u?", roles + r[:1]) and r[:1]:
                        heapq.heappush(heap, (cost + c + more, audit + letter, i + 1, roles + r[0], (*made, f"{r}:{text}")))


def brute(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    after = damage(rows)
    for conv in {r[0] for r in after}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.md5(r[3].encode()).hexdigest()))
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        known = [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, made = cheapest(turns)
        faults = [f for _, _, f in turns]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def digest(df):
    got = tr.repair_digest(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def table(seed, n=150, longest=9):
    rnd, rows = random.Random(seed), []
    texts = ("Fine.", "Cut", "  \t", "", "Why? ", "ok!\n", None, "So it is.")
    for c in range(n):
        for _ in range(rnd.randint(1, longest)):
            rows.append((c, rnd.choice((None, 0, 1, 2, 3, 5, 8, rnd.randint(0, 40))), rnd.choice(("user", "assistant", "assistant", "user", "system", "tool", None, "")), rnd.choice(texts)))
    return rows


def test_whole_table_like_brute_force(spark):
    got = q.QUERIES["op12_turn_repair"](spark, FOLDER)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got.columns[0] == "conv_id"
    assert digest(spark.read.parquet(f"{FOLDER}/conversations.parquet")) == brute(rows)
    assert {r.conv_id for r in got.collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("turns", [4096, 2, 1])
def test_random_conversations_in_blocks_of_any_size(spark, monkeypatch, turns):
    monkeypatch.setattr(tr, "BLOCK_TURNS", turns)
    rows = table(turns) + [(None, None, "user", "No id."), (None, 3, None, "No id?"), (None, 4, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", run int, `a.b` string").repartition(7)
    assert digest(df) == brute(rows)


def test_long_and_repeated(spark, monkeypatch):
    """One conversation of many turns over several partitions, a row repeated often, a very long text."""
    monkeypatch.setattr(tr, "BLOCK_TURNS", 16)
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(("user", "assistant")), rnd.choice((f"Turn {t}.", f"Turn {t}", "Again."))) for t in range(600)]
    rows += [(1, 77, "user", "Copied.")] * 300 + [(2, None, "assistant", "Same.")] * 200 + [(3, 1, "system", "word " * 200_000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert digest(df) == brute(rows)


def test_nothing_left_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Lost.")], COLUMNS)
    assert digest(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = tr.repair_digest(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == tr.repair_digest(df).dtypes


def test_repaired_turns_are_legal(spark):
    rows = table(11, n=40)
    got = tr.repair(spark.createDataFrame(rows, COLUMNS)).orderBy("conv", "run", "at").collect()
    for c in {r.conv for r in got}:
        assert LEGAL.fullmatch("".join(r.role[0] for r in got if r.conv == c))
