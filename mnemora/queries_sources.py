"""Registered queries of the readers and of what is read out of model answers: files are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import extract as ex
from .queries import as_of
from .registry import table_query
from .sources import sessions as ss


def _table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def session_files(spark, folder: str) -> DataFrame:
    """A session file a conversation: text turns as strings, every third as blocks; a blank and a broken line in each."""
    stamp = F.date_format(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(conv_id * 60 + turn AS INT), 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blocks = "to_json(array(named_struct('type', 'thinking', 'thinking', 'hm', 'text', NULL, 'name', NULL), named_struct('type', 'text', 'thinking', NULL, 'text', text, 'name', NULL), named_struct('type', 'tool_use', 'thinking', NULL, 'text', NULL, 'name', 'Read')))"
    bare = "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"
    content = F.expr(f"CASE WHEN turn % 3 = 2 THEN {blocks} ELSE {bare} END")
    head = F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), stamp.alias("timestamp")))
    line = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    rows = _table(spark, folder, "conversations").withColumn("head", head).withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    text = F.concat(F.lit("\n{broken\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return rows.groupBy("conv_id").agg(F.encode(text, "UTF-8").alias("content")).select(F.concat(F.lit("/p/-home-user-proj"), F.col("conv_id") % 7, F.lit("/s"), "conv_id", F.lit(".jsonl")).alias("path"), "content")


_TIME = "TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + {} AS INT))"


@table_query("session_conversations", f"SELECT 's' || conv_id AS session_id, '/home/user/proj' || (conv_id % 7) AS project_path, 'proj' || (conv_id % 7) AS project_name, count(*)::INT AS message_count, {_TIME.format('min(turn)')} AS started_at, {_TIME.format('max(turn)')} AS ended_at FROM conversations GROUP BY conv_id")
def _(spark, folder):
    found, _ = ss.parse_sessions(session_files(spark, folder), as_of().cast("timestamp"))
    utc = lambda c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c)
    return found.select("session_id", "project_path", "project_name", "message_count", utc("started_at"), utc("ended_at"))


@table_query("session_messages", "SELECT 's' || conv_id AS session_id, conv_id || '-' || turn AS uuid, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS role, sha256(CASE WHEN turn % 3 = 2 THEN text || chr(10) || '[Tool: Read]' ELSE text END) AS digest, CASE WHEN turn % 3 = 2 THEN 'Read' END AS tool_name FROM conversations")
def _(spark, folder):
    _, found = ss.parse_sessions(session_files(spark, folder), as_of().cast("timestamp"))
    return found.select("session_id", "uuid", "role", F.sha2("content", 256).alias("digest"), "tool_name")


def _files(df: DataFrame, path, text) -> DataFrame:
    return df.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"))


@table_query("skill_files", "SELECT 'skill ' || p_partkey AS name, p_name AS description, '1.' || p_size AS version, 'Body of ' || p_type AS body FROM part")
def _(spark, folder):
    parts = _table(spark, folder, "part")
    text = F.concat(F.lit('---\nname: "skill '), "p_partkey", F.lit('"\ndescription: '), "p_name", F.lit("\nversion: 1."), "p_size", F.lit("\n---\n\nBody of "), "p_type", F.lit("\n"))
    return ss.parse_skills(_files(parts, F.concat(F.lit("/skills/s"), "p_partkey", F.lit("/SKILL.md")), text)).select("name", "description", "version", "body")


@table_query("plan_files", "SELECT 'Plan ' || item_id AS title, sha256(t) AS file_hash, length(t)::INT AS n FROM (SELECT item_id, '# Plan ' || item_id || chr(10) || text AS t FROM benchmark) WHERE length(trim(t)) >= 120")
def _(spark, folder):
    text = F.concat(F.lit("# Plan "), "item_id", F.lit("\n"), "text")
    found = ss.parse_plans(_files(_table(spark, folder, "benchmark"), F.concat(F.lit("/plans/p"), "item_id", F.lit(".md")), text), least=120)
    return found.select("title", "file_hash", F.length("text").alias("n"))


@table_query("prompt_files", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'name_' || (item_id % 5) || ',user' ELSE 'name_' || (item_id % 5) END AS variables, 'repo' || (item_id % 3) AS project FROM benchmark")
def _(spark, folder):
    items = _table(spark, folder, "benchmark")
    text = F.concat(F.lit("Use {{ name_"), F.col("item_id") % 5, F.lit(" }} and {{name_"), F.col("item_id") % 5, F.lit("}}"), F.when(F.col("item_id") % 2 == 0, F.lit(" for ${user}")).otherwise(""), F.lit(" here: "), "text")
    files = _files(items, F.concat(F.lit("/Users/x/GitHub/repo"), F.col("item_id") % 3, F.lit("/CLAUDE"), "item_id", F.lit(".md")), text)
    return ss.parse_prompts(files).select(F.regexp_extract("path", r"CLAUDE(\d+)", 1).cast("long").alias("item_id"), F.array_join("variables", ",").alias("variables"), "project")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_LINE = _STRIP.format("split_part(regexp_replace(" + _STRIP.format("text") + """, '^["''„«»]+|["''„«».]+$', '', 'g'), chr(10), 1)""")


@table_query("title_clean", f"SELECT doc_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 77) || '...' ELSE t END AS title FROM (SELECT doc_id, {_LINE} AS t FROM documents)")
def _(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", tx.clean_title("text").alias("title"))


@table_query("context_snippets", "SELECT doc_id, substring(text, greatest(1, p - 80), p - greatest(1, p - 80) + 2 + 150)[1:300] AS snippet FROM (SELECT *, instr(lower(text), 'on') AS p FROM documents) WHERE p > 0")
def _(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", tx.context_snippet("text", F.lit("on")).alias("snippet")).filter("snippet IS NOT NULL")


@table_query("trigram_names", "SELECT a.p_partkey, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM (SELECT p_partkey, {0} AS x, {1} AS y FROM part) a".format(*("list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))".format(c) for c in ("p_name", "p_type"))))
def _(spark, folder):
    return _table(spark, folder, "part").select("p_partkey", F.round(tx.trigram_similarity("p_name", "p_type"), 6).alias("similarity"))


@table_query("extracted_chunks", "SELECT doc_id AS source_id, 'note ' || doc_id AS content, CASE doc_id % 3 WHEN 0 THEN 'decision' ELSE 'insight' END AS category, least(1, greatest(0, (doc_id % 15) / 10.0))::DOUBLE AS confidence FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 7 <> 6")
def _(spark, folder):
    # fenced, bare and wordy answers; a category that does not exist; broken ones
    category = F.element_at(F.array(F.lit("decision"), F.lit("insight"), F.lit("nonsense")), (F.col("doc_id") % 3 + 1).cast("int"))
    item = F.concat(F.lit('[{"content": "note '), "doc_id", F.lit('", "category": "'), category, F.lit('", "confidence": '), ((F.col("doc_id") % 15) / 10).cast("string"), F.lit("}]"))
    answer = F.when(F.col("doc_id") % 7 == 6, F.lit("[{broken")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), item, F.lit(" as asked.")))
    found = ex.parse_chunks(_table(spark, folder, "documents").select(F.col("doc_id").alias("conversation_id"), answer.alias("answer")))
    return found.select("source_id", "content", "category", F.col("confidence").cast("double").alias("confidence"))
