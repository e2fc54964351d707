"""The log of changes: what is appended, what reading makes of it, order, repeats, folding, and two writers."""

import pytest
from pyspark.sql import functions as F

from mnemora.api import MemoryStore
from mnemora.operators import changes as ch
from mnemora.schemas import TABLES
from mnemora.sources.store import Store


@pytest.fixture
def day():
    return lambda k: F.lit(f"2024-01-{k:02d} 00:00:00").cast("timestamp")


@pytest.fixture
def memory(spark, tmp_path, day):
    memory = MemoryStore(Store(spark, str(tmp_path / "store")))
    for k, text in enumerate(("alpha one", "alpha two", "beta three", "alpha four"), 1):
        assert memory.write(text, "insight", day(1)) == k
    return memory


def state(memory):
    return {r.id: (r.status, r.superseded_by, r.access_count, r.last_accessed and r.last_accessed.day, r.content, r.tags) for r in memory.store.read("memory_chunks").collect()}


def test_searches_append_only_what_they_found(memory, day):
    files = memory.store._manifest()["tables"]["memory_chunks"]
    assert memory.find("alpha", as_of=day(2)).count() == 3 and memory.find("four", as_of=day(3)).count() == 1
    now = memory.store._manifest()["tables"]
    assert now["memory_chunks"] == files and len(now["chunk_events"]) == 2
    assert memory.store._raw(["chunk_events"], now)["chunk_events"].count() == 4
    assert {k: v[2:4] for k, v in state(memory).items()} == {1: (1, 2), 2: (1, 2), 3: (0, None), 4: (2, 3)}


def test_all_kinds_and_the_fold(spark, memory, day):
    vectors = spark.createDataFrame([(k, "memory_chunk", k, [1.0], "m", None) for k in (1, 2, 3, 4)] + [(9, "message", 2, [1.0], "m", None)], TABLES["embeddings"])
    memory.store.commit(appended={"embeddings": vectors})
    assert memory.supersede(1, 2, "newer", day(2)) and not memory.supersede(77, 1, "none", day(2))
    assert memory.edit(3, day(4), content="beta edited", tags=["x", "y"]) and memory.edit(3, day(3), content="too late") and not memory.edit(77, day(3), content="")
    memory.find("four", as_of=day(5))
    assert memory.forget([2, 77], "gone", day(6)) == 1
    want = {1: ("superseded", None, 0, None, "alpha one", []), 3: ("active", None, 0, None, "beta edited", ["x", "y"]), 4: ("active", None, 1, 5, "alpha four", [])}
    assert state(memory) == want
    assert sorted(r.id for r in memory.store.read("embeddings").collect()) == [1, 3, 4, 9]
    assert memory.write("alpha five", "insight", day(7)) == 5  # a forgotten id is not given again
    memory.store.fold()
    assert not memory.store._manifest()["tables"]["chunk_events"]
    assert state(memory) == want | {5: ("active", None, 0, None, "alpha five", [])}
    assert sorted(r.id for r in memory.store.read("embeddings").collect()) == [1, 3, 4, 9]
    assert [r.reflection_type for r in memory.recent_reflections().collect()].count("manual_supersede") == 2
    assert sorted(r.id for r in memory.store.read("memory_reflections").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        memory.edit(3, day(8), category="nothing")
    with pytest.raises(ValueError):
        memory.edit(3, day(8), id=4)


def test_order_and_repeats(spark, memory, day):
    chunks = memory.store.read("memory_chunks")
    of = lambda *ids: ch.of_ids(spark, ids)
    log = [ch.events(of(1), ch.SUPERSEDED, day(3), "a", superseded_by=3), ch.events(of(1), ch.SUPERSEDED, day(2), "b", superseded_by=2), ch.events(of(1, 1), ch.SEEN, day(1), "c"), ch.events(of(1), ch.SEEN, day(1), "c")]
    log += [ch.events(of(2), ch.FORGOTTEN, day(1), "d"), ch.events(of(2), ch.EDITED, day(9), "e", content=F.lit("back")), ch.events(of(4), ch.SUPERSEDED, day(2), "f", superseded_by=1), ch.events(of(4), ch.EDITED, day(3), "g", status=F.lit("active"))]
    log += [ch.events(of(3), ch.EDITED, day(1), "h", content=F.lit("same time 1")), ch.events(of(3), ch.EDITED, day(1), "i", content=F.lit("same time 2")), ch.events(of(3), ch.EDITED, F.lit(None), "z", content=F.lit("no time"))]
    for order in (log, log[::-1]):
        every = order[0]
        for d in order[1:]:
            every = every.unionByName(d)
        got = {r.id: (r.status, r.superseded_by, r.access_count, r.content) for r in ch.folded(chunks, every).collect()}
        assert got == {1: ("superseded", 3, 1, "alpha one"), 3: ("active", None, 0, "same time 2"), 4: ("active", 1, 0, "alpha four")}
    assert ch.folded(chunks, every.limit(0)).count() == 4 and ch.folded(chunks.limit(0), every).count() == 0


def test_two_writers(spark, memory, day, monkeypatch):
    """Appends of both stay; what replaces or gives ids is refused after another commit."""
    store, other = memory.store, Store(spark, memory.store.root)
    rows = spark.createDataFrame([(1, "a", "h", None, 2)], TABLES["ingestion_log"])
    write = store._write

    def slow(name, df, first=[True]):
        folder = write(name, df)
        if first:
            first.clear()
            other.commit(appended={"ingestion_log": rows})
        return folder

    monkeypatch.setattr(store, "_write", slow)
    store.commit(appended={"ingestion_log": rows})
    assert store.read("ingestion_log").count() == 2
    for change in ({"replaced": {"ingestion_log": rows}}, {"appended": {"ingestion_log": rows}, "last_ids": {"ingestion_log": 1}}):
        slow.__defaults__ = ([True],)
        with pytest.raises(RuntimeError):
            store.commit(**change)
    assert store.read("ingestion_log").count() == 4
