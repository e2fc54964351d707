"""Cross-parsing against plain substring search, held-out accuracy, and the defined edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemora.llm import language_id as li
from mnemora.llm import queries as q
from tests.test_queries import FOLDER

DDL = "doc_id long, text string, lang string"


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy longest phrases that occur in the sample, segment by segment; an unknown byte is one."""
    n = 0
    for begin in range(0, len(text), li.SEGMENT):
        part, at = text[begin : begin + li.SEGMENT], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in sample:
                end += 1
            at, n = end, n + 1
    return n


@pytest.mark.parametrize("lanes", [3, 8192])
def test_phrases_like_substring_search(monkeypatch, lanes):
    monkeypatch.setattr(li, "LANES", lanes)
    rnd = random.Random(lanes)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
    samples = {"a": " ".join(word("abcé") for _ in range(300)), "b": " ".join(word("abxyß") for _ in range(200)), "漢": "漢字 と かな"}
    texts = [" ".join(word("abcdéxyß漢") for _ in range(n)) for n in (1, 2, 5, 40, 900, 3, 700)] + [None, "", "z"]
    model = li.fit(samples)
    names, scores = li.judged(model, pa.array(["skipped", *texts])[1:])
    for text, name, score in zip(texts, names, scores):
        if not text:
            assert (name, score) == ("und", 0.0)
            continue
        bits = np.array([phrases(text.encode(), samples[n].encode()) * np.log2(len(samples[n].encode()) + 1) for n in model.names])
        assert model.names.index(name) == bits.argmin()
        assert score == pytest.approx(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())


def test_automaton_holds_exactly_the_substrings():
    rnd = random.Random(2)
    for _ in range(30):
        text = bytes(rnd.choice(b"ab c") for _ in range(rnd.randint(1, 40)))
        following, walks = li.automaton(text), {b""}
        stack = [(0, b"")]
        while stack:
            state, walk = stack.pop()
            for c, to in following[state].items():
                walks.add(walk + bytes([c]))
                stack.append((to, walk + bytes([c])))
        assert walks == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_held_out_accuracy(spark):
    got = q.QUERIES["op11_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_learned_from_held_out_rows(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    rows = [(k, "uvuv wuwu vwuv", "xx") for k in held] + [(k, "abab caca bcab", "yy") for k in range(200) if k not in held]
    got = li.language_digest(spark.createDataFrame(rows, DDL)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["yy"]


def test_edges(spark):
    """Nulls, no letters, a very long text, a hot label, rare ones, one id for all rows, clashing columns."""
    rnd = random.Random(4)
    say = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(70, say("abcd", 30), "hot") for _ in range(900)] + [(k, say("efgh", 30), "rare") for k in range(1, 9)] + [(9, "ijkl jikl", None), (None, None, "hot"), (10, "12 ... 34", "rare"), (11, "", None)]
    rows += [(12, say("efgh", 40_000), None), (13, "ABCD dcba", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], DDL + ", score string").repartition(5)
    model = li.fit(li.samples_of(df, F.lit(True)))
    assert model.names == ["hot", "rare"]
    out = li.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.lang_pred == "hot" for r in got if r.doc_id == 70)
    one = {r.doc_id: r for r in got}
    assert (one[12].lang_pred, one[13].lang_pred) == ("rare", "hot")
    assert all((one[k].lang_pred, one[k]._score) == ("und", 0.0) for k in (None, 10, 11))
    nothing = li.language_digest(df.filter("lang IS NULL").drop("score"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    empty = li.language_digest(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == nothing.dtypes
