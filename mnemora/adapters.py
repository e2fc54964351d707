"""The driver's star-schema tables seen as tables of the memory model, in Spark and as SQL text for DuckDB."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CATEGORIES

#: The instant that relative times count from.
AS_OF = "2024-02-15 00:00:00"


def stamp(minutes: str) -> str:
    return f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST({minutes} AS INT), 0)"


class Memory:
    """The tables of the model over the Parquet tables in a folder; a table is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @functools.cached_property
    def messages(self) -> DataFrame:
        return self.read("conversations").selectExpr(
            "conv_id * 1000 + turn AS id", "conv_id AS conversation_id", "role", "text AS content",
            "CASE WHEN turn % 3 = 2 THEN concat('tool', CAST(conv_id % 5 AS STRING)) END AS tool_name",
            "CAST((conv_id * 37 + turn * 11) % 5000 AS INT) AS duration_ms", f"{stamp('conv_id * 60 + turn * (1 + conv_id % 20)')} AS created_at",
        )

    @functools.cached_property
    def conversations(self) -> DataFrame:
        return self.messages.groupBy(F.col("conversation_id").alias("id")).agg(
            F.count("*").alias("message_count"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at")
        ).selectExpr(
            "id", "concat('proj', CAST(id % 7 AS STRING)) AS project_name", "concat('model-', CAST(id % 3 AS STRING)) AS model", "message_count", "started_at", "ended_at",
            "CASE WHEN id % 13 = 0 THEN NULL ELSE message_count * 100 END AS token_count_in", "message_count * 50 AS token_count_out",
            "CAST(id % 100 AS DECIMAL(10,4)) / 100 AS cost_usd", "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('summary of ', CAST(id AS STRING)) END AS summary",
        )

    @functools.cached_property
    def chunks(self) -> DataFrame:
        category = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END AS category"
        return self.read("documents").join(self.read("labels"), "doc_id", "left").selectExpr(
            "doc_id AS id", "text AS content", category, "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS project_name", "array(lang, source) AS tags",
            "CAST(0.50 + CAST(doc_id % 50 AS DECIMAL(4,2)) / 100 AS DECIMAL(3,2)) AS confidence", "CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'conversation' END AS source_type",
            "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 100 END AS source_id",
            "CASE WHEN toxic = 1 THEN 'stale' WHEN quality = 0 THEN 'superseded' WHEN quality IS NULL THEN NULL ELSE 'active' END AS status",
            f"{stamp('doc_id * 60')} AS created_at", "CAST(doc_id % 17 AS INT) AS access_count", f"CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {stamp('doc_id * 60 + (doc_id % 50) * 1440')} END AS last_accessed",
            "CASE WHEN quality = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by", "CASE WHEN doc_id % 97 = 0 THEN array(doc_id + 1, doc_id + 2) END AS merged_from",
        )

    @functools.cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id % 2 = 0 THEN 'memory_chunk' ELSE 'message' END AS source_type", "CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE (vec_id % 100) * 1000 END AS source_id", "embedding", "'model-a' AS model")

    @functools.cached_property
    def entities(self) -> DataFrame:
        def of(table: str, base: int, key: str, name: str, kind: str, project: str) -> DataFrame:
            return self.read(table).selectExpr(f"CAST({base} + {key} AS BIGINT) AS id", f"'{kind}' AS entity_type", f"{name} AS name", f"lower({name}) AS canonical_name", f"CAST(({key} * 7) % 23 AS INT) AS mention_count", f"{project} AS project_name", f"{stamp(f'{key} % 40000 * 3')} AS first_seen")

        proj = lambda key: f"concat('proj', CAST({key} % 7 AS STRING))"
        parts = (
            of("region", 1, "r_regionkey", "r_name", "concept", "CAST(NULL AS STRING)"), of("nation", 100, "n_nationkey", "n_name", "organization", proj("n_nationkey")),
            of("supplier", 1000, "s_suppkey", "s_name", "project", proj("s_suppkey")), of("customer", 100000, "c_custkey", "c_name", "person", proj("c_custkey")),
        )
        return functools.reduce(DataFrame.unionByName, parts)

    @functools.cached_property
    def relationships(self) -> DataFrame:
        def of(table: str, base: int, a: str, b: str, kind: str) -> DataFrame:
            return self.read(table).selectExpr(f"CAST({base} + {a} AS BIGINT) AS from_entity", f"CAST({b} AS BIGINT) AS to_entity", f"'{kind}' AS relation_type", f"CAST(0.50 + CAST({a} % 50 AS DECIMAL(4,2)) / 100 AS DECIMAL(3,2)) AS confidence", f"{stamp(a)} AS created_at")

        parts = (
            of("nation", 100, "n_nationkey", "1 + n_regionkey", "member_of"), of("supplier", 1000, "s_suppkey", "100 + s_nationkey", "relates_to"),
            of("customer", 100000, "c_custkey", "100 + c_nationkey", "relates_to"), of("supplier", 1000, "s_suppkey", "100 + s_nationkey", "works_on").filter("from_entity % 3 = 0"),
        )
        return functools.reduce(DataFrame.unionByName, parts)

    @functools.cached_property
    def mentions(self) -> DataFrame:
        return self.read("orders").selectExpr("o_orderkey AS id", "100000 + o_custkey AS entity_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'memory_chunk' ELSE 'conversation' END AS source_type", "o_orderkey % 100 AS source_id", "o_orderpriority AS context_snippet", "o_orderdate AS created_at")

    @functools.cached_property
    def reflections(self) -> DataFrame:
        return self.read("events").selectExpr("event_id AS id", "event_type AS reflection_type", "CASE WHEN event_id % 3 = 0 THEN 'merged' WHEN event_id % 3 = 1 THEN 'marked_superseded' ELSE 'kept' END AS action_taken", "CASE WHEN event_id % 5 = 0 THEN array() WHEN event_id % 5 = 1 THEN NULL ELSE array(event_id, event_id + 1) END AS affected_chunks", "props AS reasoning", "value AS confidence", "ts AS created_at")

    @functools.cached_property
    def ingestion_log(self) -> DataFrame:
        return self.read("documents").selectExpr("doc_id AS id", "concat(source, '/', CAST(doc_id AS STRING)) AS file_path", "sha2(text, 256) AS file_hash", f"{stamp('doc_id')} AS ingested_at", "n_chars AS record_count")

    @functools.cached_property
    def skills(self) -> DataFrame:
        return self.read("part").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS description", "p_brand AS path", "CAST(p_size % 11 AS INT) AS use_count", f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {stamp('p_partkey * 10')} END AS last_used", f"CASE WHEN p_partkey % 3 = 0 THEN {stamp('p_partkey * 20')} END AS file_modified", f"{stamp('p_partkey')} AS created_at")

    @functools.cached_property
    def prompts(self) -> DataFrame:
        return self.read("benchmark").selectExpr("item_id AS id", "concat('prompt ', CAST(item_id AS STRING)) AS name", "CASE item_id % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'system' END AS category", "text AS content", "CAST(item_id * 7 % 5 AS INT) AS usage_count", f"{stamp('item_id * 30')} AS updated_at", f"{stamp('item_id * 25')} AS created_at")

    @functools.cached_property
    def projects(self) -> DataFrame:
        people = """concat('[{"name":"', n_name, '","role":"lead"},{"name":"person ', CAST(n_nationkey AS STRING), '","role":"member"}]') AS contacts"""
        choices = """concat('[{"title":"choice ', CAST(n_nationkey AS STRING), '","date":"2024-01-0', CAST(1 + n_nationkey % 9 AS STRING), '"}]') AS decisions"""
        return self.read("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' ELSE 'archived' END AS status", people, choices, f"CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE {stamp('n_nationkey * 60')} END AS updated_at", "concat('work in region ', CAST(n_regionkey AS STRING)) AS description", f"{stamp('n_nationkey * 1500')} AS created_at")


_STAMP = "TIMESTAMP '2024-01-01' + to_minutes(CAST({} AS INT))"
_CATEGORY = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"


def _entity(table, base, key, name, kind, project):
    return f"SELECT CAST({base} + {key} AS BIGINT) AS id, '{kind}' AS entity_type, {name} AS name, lower({name}) AS canonical_name, CAST(({key} * 7) % 23 AS INT) AS mention_count, {project} AS project_name, {_STAMP.format(f'{key} % 40000 * 3')} AS first_seen FROM {table}"


def _relation(table, base, a, b, kind, where="true"):
    return f"SELECT CAST({base} + {a} AS BIGINT) AS from_entity, CAST({b} AS BIGINT) AS to_entity, '{kind}' AS relation_type, CAST(0.50 + ({a} % 50) / 100.0 AS DECIMAL(3,2)) AS confidence, {_STAMP.format(a)} AS created_at FROM {table} WHERE {where}"


#: The same tables as common table expressions over the views of the oracle.
CTES = {
    "messages": f"SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role, text AS content, CASE WHEN turn % 3 = 2 THEN 'tool' || (conv_id % 5) END AS tool_name, CAST((conv_id * 37 + turn * 11) % 5000 AS INT) AS duration_ms, {_STAMP.format('conv_id * 60 + turn * (1 + conv_id % 20)')} AS created_at FROM conversations",
    "convs": "SELECT id, 'proj' || (id % 7) AS project_name, 'model-' || (id % 3) AS model, message_count, started_at, ended_at, CASE WHEN id % 13 = 0 THEN NULL ELSE message_count * 100 END AS token_count_in, message_count * 50 AS token_count_out, CAST(id % 100 AS DECIMAL(10,4)) / 100 AS cost_usd, CASE WHEN id % 4 = 0 THEN NULL ELSE 'summary of ' || id END AS summary FROM (SELECT conversation_id AS id, count(*) AS message_count, min(created_at) AS started_at, max(created_at) AS ended_at FROM messages GROUP BY 1)",
    "chunks": f"SELECT doc_id AS id, text AS content, {_CATEGORY} AS category, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS project_name, [lang, source] AS tags, CAST(0.50 + (doc_id % 50) / 100.0 AS DECIMAL(3,2)) AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'conversation' END AS source_type, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 100 END AS source_id, CASE WHEN toxic = 1 THEN 'stale' WHEN quality = 0 THEN 'superseded' WHEN quality IS NULL THEN NULL ELSE 'active' END AS status, {_STAMP.format('doc_id * 60')} AS created_at, CAST(doc_id % 17 AS INT) AS access_count, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_STAMP.format('doc_id * 60 + (doc_id % 50) * 1440')} END AS last_accessed, CASE WHEN quality = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by, CASE WHEN doc_id % 97 = 0 THEN [doc_id + 1, doc_id + 2] END AS merged_from FROM documents LEFT JOIN labels USING (doc_id)",
    "vectors": "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'memory_chunk' ELSE 'message' END AS source_type, CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE (vec_id % 100) * 1000 END AS source_id, embedding, 'model-a' AS model FROM embeddings",
    "entities": " UNION ALL ".join((_entity("region", 1, "r_regionkey", "r_name", "concept", "CAST(NULL AS VARCHAR)"), _entity("nation", 100, "n_nationkey", "n_name", "organization", "'proj' || (n_nationkey % 7)"), _entity("supplier", 1000, "s_suppkey", "s_name", "project", "'proj' || (s_suppkey % 7)"), _entity("customer", 100000, "c_custkey", "c_name", "person", "'proj' || (c_custkey % 7)"))),
    "relationships": " UNION ALL ".join((_relation("nation", 100, "n_nationkey", "1 + n_regionkey", "member_of"), _relation("supplier", 1000, "s_suppkey", "100 + s_nationkey", "relates_to"), _relation("customer", 100000, "c_custkey", "100 + c_nationkey", "relates_to"), _relation("supplier", 1000, "s_suppkey", "100 + s_nationkey", "works_on", "(1000 + s_suppkey) % 3 = 0"))),
    "mentions": "SELECT o_orderkey AS id, 100000 + o_custkey AS entity_id, CASE WHEN o_orderkey % 4 = 0 THEN 'memory_chunk' ELSE 'conversation' END AS source_type, o_orderkey % 100 AS source_id, o_orderpriority AS context_snippet, o_orderdate AS created_at FROM orders",
    "reflections": "SELECT event_id AS id, event_type AS reflection_type, CASE WHEN event_id % 3 = 0 THEN 'merged' WHEN event_id % 3 = 1 THEN 'marked_superseded' ELSE 'kept' END AS action_taken, CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 5 = 1 THEN NULL ELSE [event_id, event_id + 1] END AS affected_chunks, props AS reasoning, value AS confidence, ts AS created_at FROM events",
    "skills": f"SELECT p_partkey AS id, p_name AS name, p_type AS description, p_brand AS path, CAST(p_size % 11 AS INT) AS use_count, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {_STAMP.format('p_partkey * 10')} END AS last_used, CASE WHEN p_partkey % 3 = 0 THEN {_STAMP.format('p_partkey * 20')} END AS file_modified, {_STAMP.format('p_partkey')} AS created_at FROM part",
    "prompts": f"SELECT item_id AS id, 'prompt ' || item_id AS name, CASE item_id % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'system' END AS category, text AS content, CAST(item_id * 7 % 5 AS INT) AS usage_count, {_STAMP.format('item_id * 30')} AS updated_at, {_STAMP.format('item_id * 25')} AS created_at FROM benchmark",
    "projects": f"SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' ELSE 'archived' END AS status, '[{{\"name\":\"' || n_name || '\",\"role\":\"lead\"}},{{\"name\":\"person ' || n_nationkey || '\",\"role\":\"member\"}}]' AS contacts, '[{{\"title\":\"choice ' || n_nationkey || '\",\"date\":\"2024-01-0' || (1 + n_nationkey % 9) || '\"}}]' AS decisions, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE {_STAMP.format('n_nationkey * 60')} END AS updated_at, 'work in region ' || n_regionkey AS description, {_STAMP.format('n_nationkey * 1500')} AS created_at FROM nation",
    "ingestion_log": f"SELECT doc_id AS id, source || '/' || doc_id AS file_path, sha256(text) AS file_hash, {_STAMP.format('doc_id')} AS ingested_at, n_chars AS record_count FROM documents",
}
NEEDS = {"convs": ("messages",)}


def sql(tables: str, body: str) -> str:
    """`body` behind the common table expressions of the named tables."""
    names = list(dict.fromkeys(n for t in tables.split() for n in (*NEEDS.get(t, ()), t)))
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    if not ctes:
        return body
    head, rest = ("WITH RECURSIVE ", body[len("WITH RECURSIVE ") :]) if body.startswith("WITH RECURSIVE ") else ("WITH ", body)
    if head.startswith("WITH RECURSIVE") or body.startswith("WITH "):
        rest = rest.removeprefix("WITH ")
        return f"{head}{ctes}, {rest}"
    return f"{head}{ctes} {body}"
