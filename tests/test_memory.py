"""Ingest, streaming, store, tools, graph and reflection on small examples."""

import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemora import schemas
from mnemora.api import MemoryStore, console
from mnemora.operators import extract, graph, mutations, reflect
from mnemora.operators.embedding import embed, hashing_embedder
from mnemora.plans import reports
from mnemora.schemas import TABLES
from mnemora.sources import sessions, sinks
from mnemora.sources.store import Store
from mnemora.streaming.ingest import commit_batch, ingest_stream, windowed_messages

LINES = [
    {"type": "user", "uuid": "u1", "sessionId": "s1", "timestamp": "2024-01-01T10:00:00Z", "cwd": "/tmp", "message": {"role": "user", "content": "hello"}},
    {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "sessionId": "s1", "timestamp": "2024-01-01T10:05:00Z", "message": {"role": "assistant", "model": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"a": 1}}]}},
    {"type": "user", "uuid": "u3", "sessionId": "s1", "timestamp": "broken", "message": {"role": "user", "content": [{"type": "tool_result", "content": "x" * 600}]}},
    {"type": "summary", "sessionId": "s1"},
]


@pytest.fixture
def as_of(spark):
    return F.lit("2024-02-15 00:00:00").cast("timestamp")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "projects" / "-tmp-test-project"
    d.mkdir(parents=True)
    (d / "s1.jsonl").write_text("\n".join([*map(json.dumps, LINES), "", "not json"]))
    (d / "s2.jsonl").write_text(json.dumps({"type": "user", "message": {"role": "user", "content": "no session"}}))
    return tmp_path


def test_sessions(spark, folder, as_of):
    log = spark.createDataFrame([], schemas.INGESTION_LOG)
    conversations, messages, rows = sessions.ingest_sessions(spark, str(folder / "projects"), log, as_of)
    (c,) = conversations.collect()
    assert (c.session_id, c.message_count, c.model, c.project_path, c.project_name) == ("s1", 3, "m1", "/tmp/test/project", "project")
    m = messages.orderBy("line_no").collect()
    assert [r.role for r in m] == ["user", "assistant", "tool_result"]
    assert m[0].content == "hello" and m[1].content == "hi\n[Tool: Bash]" and m[1].tool_name == "Bash" and len(m[2].content) == 500
    assert json.loads(m[1].tool_calls[0].input) == {"a": 1}
    again = sessions.ingest_sessions(spark, str(folder / "projects"), rows, as_of)
    assert again[0].count() == 0 and again[2].count() == 0


def test_two_files_of_one_session(spark, tmp_path, as_of):
    """One conversation, each uuid once, whatever the order of the files; later files add only if asked to."""
    where = tmp_path / "projects" / "-tmp-p"
    where.mkdir(parents=True)
    (where / "a.jsonl").write_text("\n".join(map(json.dumps, [LINES[0], LINES[1], LINES[0]])))
    (where / "b.jsonl").write_text("\n".join(map(json.dumps, [LINES[0], LINES[1], LINES[2]])))
    for append, messages in ((False, 2), (True, 3)):
        store = Store(spark, str(tmp_path / f"store{append}"))
        for k in range(2):
            commit_batch(store, as_of, append_new=append)(sessions.read_files(spark, str(where), "*.jsonl"), k)
        assert [store.read(t).count() for t in ("conversations", "messages", "ingestion_log")] == [1, messages, 2]
        assert store.read("messages").select("uuid").distinct().count() == store.read("messages").select("id").distinct().count() == messages


def test_torn_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", "h", None, 2)], TABLES["ingestion_log"])
    assert store.commit(appended={"ingestion_log": rows}) == 1
    (tmp_path / "store" / "manifests" / "2").mkdir()  # a commit that failed half-way
    assert store.read("ingestion_log").count() == 1
    assert store.commit(appended={"ingestion_log": rows}) == 3 and store.read("ingestion_log").count() == 2


def test_backups_and_their_age(spark, tmp_path):
    store, target = Store(spark, str(tmp_path / "store")), str(tmp_path / "backups")
    store.commit(appended={"ingestion_log": spark.createDataFrame([(1, "a", "h", None, 2)], TABLES["ingestion_log"])})
    (tmp_path / "backups" / "notes").mkdir(parents=True)
    first = store.backup(target, datetime(2024, 1, 1))
    store.backup(target, datetime(2024, 1, 20))
    assert spark.read.parquet(f"{first}/ingestion_log").count() == 1
    store.backup(target, datetime(2024, 2, 5))
    assert sorted(p.name for p in (tmp_path / "backups").iterdir()) == ["20240120-000000", "20240205-000000", "notes"]


def test_long_transcripts_keep_their_end(spark):
    rows = [(k, 1, "user" if k % 2 else "assistant", f"{k} " + "x" * 90, k) for k in range(60)] + [(100, 2, "user", "y" * 300, 0)]
    df = spark.createDataFrame(rows, "id long, conversation_id long, role string, content string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    whole = {r.conversation_id: r.transcript for r in reports.transcripts(df, whole=10**6).collect()}
    assert {r.conversation_id: r.transcript for r in reports.transcripts(df, whole=1000).collect()} == {c: t[-1000:] for c, t in whole.items()}


def test_console_only_reads(spark):
    tables = {"rows": spark.range(3)}
    assert console(spark, "WITH x AS (SELECT * FROM rows) SELECT count(*) AS n FROM x", tables).first().n == 3
    assert console(spark, "EXPLAIN SELECT * FROM rows", tables).count() == 1
    for bad in ("DROP VIEW rows", "WITH x AS (SELECT 1) INSERT INTO rows SELECT * FROM x", "EXPLAIN DROP VIEW rows", "explain", ""):
        with pytest.raises(ValueError):
            console(spark, bad, tables)


def test_access_and_preload_are_tracked(spark, tmp_path, as_of):
    store = Store(spark, str(tmp_path / "store"))
    memory = MemoryStore(store, hashing_embedder(), project="p")
    memory.write("use parquet", "decision", as_of)
    memory.write("ann writes parquet", "contact", as_of)
    assert memory.find("parquet").count() == 2 and store.read("memory_chunks").agg(F.sum("access_count")).first()[0] == 0
    assert memory.find("use", as_of=as_of).count() == 1
    assert {r.id: r.access_count for r in store.read("memory_chunks").collect()} == {1: 1, 2: 0}
    chosen, people = memory.preload("p", as_of)
    assert [r.id for r in chosen.collect()] == [1] and [r.id for r in people.collect()] == [2]
    audit = store.read("memory_reflections").first()
    assert audit.affected_chunks == [1, 2] and audit.reasoning.endswith("(1 chunks + 1 contacts)")


def test_stream_ingests_once(spark, folder, tmp_path, as_of):
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(folder / "projects"), store, str(tmp_path / "checkpoint"), as_of).awaitTermination()
    assert [store.read(t).count() for t in ("conversations", "messages", "ingestion_log")] == [1, 3, 1]
    batch = sessions.read_files(spark, str(folder / "projects"), "*.jsonl")
    commit_batch(store, as_of)(batch, 0)  # a batch that runs again adds nothing
    assert store.read("messages").count() == 3
    (folder / "projects" / "-tmp-test-project" / "s1.jsonl").write_text("\n".join(map(json.dumps, [*LINES, LINES[0] | {"uuid": "u9"}])))
    commit_batch(store, as_of)(sessions.read_files(spark, str(folder / "projects"), "*.jsonl"), 1)
    assert store.read("messages").count() == 3
    (folder / "projects" / "-tmp-test-project" / "s1.jsonl").write_text("\n".join(map(json.dumps, [*LINES, LINES[0] | {"uuid": "u10"}])))
    commit_batch(store, as_of, append_new=True)(sessions.read_files(spark, str(folder / "projects"), "*.jsonl"), 2)
    assert store.read("messages").count() == 4
    assert windowed_messages(store.read("messages").filter("role = 'user'")).count() >= 1


def test_markdown_sources(spark, tmp_path):
    skill = tmp_path / "skills" / "demo"
    skill.mkdir(parents=True)
    (skill / "SKILL.md").write_text('---\nname: demo-skill\ndescription: Triggers on "run it, do it" only\nversion: 1.0\n---\n# Body\ntext')
    (tmp_path / "plan-abc123.md").write_text("# A plan\n" + "word " * 30)
    (tmp_path / "CLAUDE.md").write_text("Use {{project_name}} with ${coding_style}, please.")
    (s,) = sessions.parse_skills(sessions.read_files(spark, str(tmp_path), "SKILL.md")).collect()
    assert (s.name, s.version, s.triggers, s.body) == ("demo-skill", "1.0", ["run it", "do it"], "# Body\ntext")
    (p,) = sessions.parse_plans(sessions.read_files(spark, str(tmp_path), "plan*.md")).collect()
    assert p.title == "A plan" and p.session_id == str(uuid.uuid5(uuid.NAMESPACE_URL, p.path))
    (c,) = sessions.parse_prompts(sessions.read_files(spark, str(tmp_path), "CLAUDE.md")).collect()
    assert c.variables == ["coding_style", "project_name"]
    (tmp_path / "q.jsonl").write_text('// note\n\n# other\n{"id": "q1", "question": "?", "expected_substrings": ["Hi"]}\n')
    assert sessions.read_questions(spark, str(tmp_path / "q.jsonl")).first().expected_substrings == ["Hi"]


def test_store_and_tools(spark, tmp_path, as_of):
    store = Store(spark, str(tmp_path / "store"))
    memory = MemoryStore(store, hashing_embedder(), project="p")
    a = memory.write("use parquet", "decision", as_of, tags=["storage"])
    b = memory.write("use parquet with zstd", "decision", as_of, confidence=7)
    assert (a, b) == (1, 2) and store.read("memory_chunks").agg(F.max("confidence")).first()[0] == 1
    with pytest.raises(ValueError):
        memory.write("x", "nonsense", as_of)
    with pytest.raises(ValueError):
        MemoryStore(store, strict=True).scope("")
    texts = store.read("memory_chunks").select(F.lit("memory_chunk").alias("source_type"), F.col("id").alias("source_id"), "content")
    store.commit(appended={"embeddings": embed(texts, hashing_embedder(), "h", 64).withColumn("id", F.col("source_id"))})
    assert memory.search("use parquet").first().source_id == 1
    assert memory.supersede(a, b, "newer", as_of) and not memory.supersede(99, b, "none", as_of)
    assert [r.id for r in memory.find("parquet").collect()] == [2]
    assert memory.forget([b], "gone", as_of) == 1
    (left,) = store.read("memory_chunks").collect()
    assert left.superseded_by is None and left.status == "superseded" and store.read("embeddings").count() == 1
    assert memory.recent_reflections().count() == 3
    assert store.migrate({"002": {}, "001": {}}) == ["001", "002"] and store.migrate({"001": {}, "003": {}}) == ["003"]
    assert console(spark, "SELECT count(*) AS n FROM chunks", {"chunks": store.read("memory_chunks")}).first().n == 1
    with pytest.raises(ValueError):
        console(spark, "DROP TABLE chunks", {})
    assert sinks.csv_text(store.read("memory_chunks").select("id")).startswith(b"\xef\xbb\xbfid")
    sinks.write_csv(store.read("memory_chunks"), str(tmp_path / "csv"))
    assert "## Decision" in sinks.context_markdown(store.read("memory_chunks"), "p")


def test_graph_by_hand(spark):
    edges = spark.createDataFrame([(1, 2, "uses"), (2, 3, "uses"), (3, 1, "blocks"), (3, 4, "uses"), (5, 5, "uses"), (1, 2, "blocks")], "from_entity long, to_entity long, relation_type string")
    assert {(r.node, r.depth) for r in graph.distances(edges, 1).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert graph.path(edges, 1, 4).first().path == [1, 3, 4] and graph.path(edges, 2, 2).first().nodes == 1 and graph.path(edges, 1, 5).count() == 0
    assert sorted((r.hop, r.from_entity, r.to_entity) for r in graph.recall(edges, 1, 2).collect()) == [(1, 1, 2), (1, 1, 2), (1, 3, 1), (2, 3, 4)]
    names = spark.createDataFrame([(i, f"n{i}", 1) for i in range(1, 6)], "id long, name string, mention_count int")
    assert {r.id: r.degree for r in graph.degrees(names, edges).collect()} == {1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    assert graph.contradictions(edges).first().types == "blocks,uses"
    found = spark.createDataFrame([(1, 1, "uses", "c", 1), (1, 2, "uses", "c", 1), (1, 2, "uses", "c", 1), (1, 2, "likes", "c", 1)], "from_entity long, to_entity long, relation_type string, source_type string, source_id long")
    assert graph.new_relationships(found.limit(0), found, schemas.RELATION_TYPES).count() == 1


def test_reflection(spark):
    chunks = spark.createDataFrame([(1, "use a", "decision", "p", ["x"], 0.5, "active"), (2, "use a!", "decision", "p", ["y"], 0.7, None), (3, "use b", "decision", "p", ["X"], 0.9, "active"), (4, "old", "decision", "p", ["x"], 0.9, "stale"), (5, "on 2024-01-01", "insight", None, ["x"], 0.9, "active")], "id long, content string, category string, project_name string, tags array<string>, confidence double, status string").withColumn("created_at", F.col("id").cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
    pairs = reflect.with_texts(reflect.candidate_pairs(chunks), chunks)
    assert {(p.id_a, p.id_b) for p in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    merged = reflect.dedup(pairs, lambda p: {"duplicate": True, "confidence": 0.9}, 10)
    assert merged.merged[0]["tags"] == ["x", "y"] and merged.merged[0]["confidence"] == 0.7 and len(merged.merged) == 1
    assert {r.id: r.status for r in merged.apply(chunks).collect()} == {1: "merged", 2: "merged", 3: "active", 4: "stale", 5: "active"}
    lost = reflect.contradict(pairs, lambda p: {"contradicts": (p.id_a, p.id_b) != (1, 2), "confidence": 0.8})
    assert lost.status == {1: ("superseded", 3), 2: ("superseded", 3)}
    gone = reflect.expire(reflect.stale_candidates(chunks), lambda c: {"stale": True, "confidence": 1, "expires_at": "2024-01-02"}, "2024-02-01")
    assert gone.status == {5: ("stale", None)}
    assert {r.tag: r.size for r in reflect.tag_clusters(chunks, 2).collect()} == {"x": 2}
    joined = reflect.consolidate(chunks.withColumn("tags", F.array(F.lit("t"))), lambda c: {"content": "w" * 50}, 20)
    assert joined.merged[0]["merged_from"] == [1, 2, 3]
    assert mutations.parse_ids("1, 2 x 3,-4") == [1, 2, 3]
    assert reports.all_of(None, F.lit(True)) is not None


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "conversation_id long, transcript string")
    chunks = '```json\n[{"content": "use x", "category": "decision", "tags": ["t"], "confidence": 3}, {"content": "", "category": "decision"}, {"content": "y", "category": "no"}]\n```'
    answers = extract.ask(texts, lambda ts: [chunks if t == "a" else "no json" for t in ts])
    (c,) = extract.parse_chunks(answers).collect()
    assert (c.source_id, c.content, c.tags, float(c.confidence)) == (1, "use x", ["t"], 1.0)
    graph_answer = 'So: {"entities": [{"type": "person", "name": "Ánn"}, {"type": "ghost", "name": "x"}], "relationships": [{"from": "ann", "to": "Mnemora", "type": "works_on"}, {"from": "ann", "to": "ann", "type": "uses"}]}'
    entities, relations = extract.parse_graph(extract.ask(texts.limit(1), lambda ts: [graph_answer for _ in ts]))
    assert [e.canonical_name for e in entities.collect()] == ["ann"]
    found = spark.createDataFrame([(1, "ann", 7)], "conversation_id long, canonical_name string, id long")
    known = spark.createDataFrame([("mnemora", 3, "p", 1), ("mnemora", 4, None, 9)], "canonical_name string, id long, project_name string, mention_count int")
    (r,) = extract.with_ids(relations, found, known, "p").collect()
    assert (r.from_entity, r.to_entity, r.relation_type) == (7, 3, "works_on")
    rows = spark.createDataFrame([(1, "old"), (2, None)], "id long, summary string")
    titled = mutations.set_titles(rows, spark.createDataFrame([(2, "'New one.'")], "id long, title string"))
    assert {x.id: x.summary for x in titled.collect()} == {1: "old", 2: "New one"}
    assert {x.id: x.summary for x in mutations.delete(mutations.edit(rows, 2, summary="s"), [1]).collect()} == {2: "s"}


def test_command_line(spark, folder, tmp_path, capsys):
    from mnemora import cli

    root = ["--root", str(tmp_path / "cli")]
    assert cli.main([*root, "add", "decision", "use parquet"]) == 0
    assert cli.main([*root, "ingest", str(folder / "projects")]) == 0
    for command in (["search", "parquet"], ["stats"], ["sql", "SELECT count(*) AS n FROM messages"], ["recall", "nobody"], ["edit", "1", "use parquet only"], ["contact", "x"], ["project", "x"], ["forget", "1"], ["fold"], ["backup", str(tmp_path / "backups")], ["reflections"]):
        assert cli.main([*root, *command]) == 0
    assert "use parquet" not in cli.sinks.context_markdown(Store(spark, root[1]).read("memory_chunks"), "p")
    assert "|  3|" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([*root, "add", "nonsense", "x"])


def test_recall_with_project_types_and_mentions(spark, tmp_path, as_of):
    store = Store(spark, str(tmp_path / "store"))
    entity = lambda i, name, project, n: (i, "person", name, name.lower(), None, None, None, n, project, None, None)
    store.commit(appended={
        "entities": spark.createDataFrame([entity(1, "Ada", "p", 1), entity(2, "Ada", "q", 9), entity(3, "Bo", None, 2), entity(4, "Cy", "p", 3)], TABLES["entities"]),
        "relationships": spark.createDataFrame([(k, a, b, t, None, None, None, None, None, None, None) for k, (a, b, t) in enumerate([(1, 3, "uses"), (4, 3, "uses"), (4, 1, "blocks"), (2, 3, "uses")])], TABLES["relationships"]),
        "entity_mentions": spark.createDataFrame([(k, 1, "conversation", k, f"m{k}", datetime(2024, 1, 1 + k % 25, k // 25)) for k in range(30)], TABLES["entity_mentions"]),
    })
    memory = MemoryStore(store)
    assert memory.recall("ada")[0].id == 2 and memory.recall("ada", project="p")[0].id == 1 and memory.recall("ada", project="z")[0].id == 2 and memory.recall("nobody") == (None, None, None)
    seed, near, mentions = memory.recall("ada", 2, "p", ["uses"])
    assert sorted((r.hop, r.direction, r.relation_type, r.name) for r in near.collect()) == [(1, "outgoing", "uses", "Bo"), (2, "incoming", "uses", "Ada"), (2, "incoming", "uses", "Cy")]
    assert [r.source_id for r in mentions.collect()][:2] == [24, 23] and mentions.count() == 20
    assert memory.preload_summary() is None
    memory.write("use parquet", "decision", as_of, project="p")
    memory.preload("p", as_of)
    assert memory.preload_summary().affected_chunks == [1] and memory.preload_summary().action_taken == "session_start"
