"""The ledger of model calls: what is asked, once, again, and not at all."""

import time
import uuid
from pathlib import Path

import pytest

from mnemora.operators.ledger import Ledger


@pytest.fixture
def log(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def calls(log):
    return sorted(f.read_text() for f in Path(log).iterdir())


def model(log, fails=(), slow=()):
    def answer(prompts):
        for p in prompts:
            (Path(log) / uuid.uuid4().hex).write_text(p)
        if any(p in fails for p in prompts):
            raise RuntimeError("no")
        if any(p in slow for p in prompts):
            time.sleep(3)
        return [p.upper() for p in prompts]

    return answer


def rows(df):
    return {r.id: (r.answer, r.error) for r in df.collect()}


def test_nothing_is_asked_twice(spark, tmp_path, log):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "id int, prompt string")
    out = ledger.answered(df, model(log), "m", wave=2, batch=1)
    want = {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, None), 5: ("C", None)}
    assert rows(out) == want and rows(out) == want and calls(log) == ["a", "b", "c"]
    more = df.union(spark.createDataFrame([(6, "d")], df.schema))
    assert rows(ledger.answered(more, model(log), "m"))[6] == ("D", None) and calls(log) == ["a", "b", "c", "d"]
    ledger.answered(df, model(log), "other model", batch=1)
    assert len(calls(log)) == 7
    assert ledger.answered(df.limit(0), model(log), "m").count() == 0


def test_failures_are_rows_and_are_tried_again(spark, tmp_path, log):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string").coalesce(1)
    got = rows(ledger.answered(df, model(log, fails=("b",)), "m", tries=2, batch=1))
    assert got == {1: ("A", None), 2: (None, "RuntimeError: no")} and calls(log) == ["a", "b", "b", "b"]
    assert rows(ledger.answered(df, model(log), "m")) == {1: ("A", None), 2: ("B", None)}
    assert calls(log) == ["a"] + ["b"] * 4
    assert rows(ledger.answered(df, lambda prompts: [None] * len(prompts), "silent", tries=1))[1][1] == "ValueError: an answer is missing"


def test_slow_calls_end(spark, tmp_path, log):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    got = rows(ledger.answered(df, model(log, slow=("b",)), "m", timeout=0.5, tries=1, batch=1))
    assert got[1] == ("A", None) and got[2][1].startswith("TimeoutError")
