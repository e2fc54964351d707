"""Registered queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapters import AS_OF, Memory, sql
from .functions import text as tx
from .operators import graph as g
from .operators import mutations as mu
from .operators import reflect as rf
from .operators import retrieval as rt
from .plans import reports as rp
from .registry import QUERIES, SQL, query, table_query

__all__ = ["QUERIES", "SQL"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


NOW = f"TIMESTAMP '{AS_OF}'"
MIN = "date_diff('microsecond', started_at, ended_at) / 6e7"
ACT = "coalesce(status, 'active') = 'active'"
FILTERS = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in ("decision", "pattern", "insight", "preference", "contact", "error_solution", "project_context", "workflow"))
#: A fixed query vector of 64 dimensions, rounded like stored ones.
VECTOR = [round(float(np.sin(i + 1)), 7) for i in range(64)]
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(("decision", "pattern", "insight", "preference", "contact", "error_solution", "project_context", "workflow"))) + " END"

# --- rollups -------------------------------------------------------------------------------------------------


@query("coverage_by_project", sql("chunks", f"SELECT coalesce(project_name, '(none)') AS project, count(*) AS total, {FILTERS}, round(avg(confidence::DOUBLE), 4) AS avg_confidence FROM chunks GROUP BY 1"))
def _(m):
    return rp.coverage_by_project(m.chunks)


@query("conversation_stats", sql("convs", "SELECT project_name, count(*) AS conversations, sum(message_count)::BIGINT AS messages, round(avg(token_count_in + token_count_out), 2) AS avg_tokens, sum(cost_usd)::DOUBLE AS cost FROM convs GROUP BY 1"))
def _(m):
    return rp.conversation_stats(m.conversations)


@query("dashboard_counts", sql("chunks convs messages entities relationships", "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM convs) AS conversations, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relationships) AS relationships"))
def _(m):
    return rp.counts(chunks=m.chunks, conversations=m.conversations, messages=m.messages, entities=m.entities, relationships=m.relationships)


@query("graph_stats", sql("entities relationships mentions", "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(*) FROM mentions) AS mentions, (SELECT count(DISTINCT source_id) FROM mentions) AS sources"))
def _(m):
    return rp.counts(entities=m.entities, relationships=m.relationships, mentions=m.mentions, sources=m.mentions.select("source_id").distinct())


@query("chunks_by_category", sql("chunks", "SELECT category, count(*) AS n FROM chunks GROUP BY 1"))
def _(m):
    return rp.count_by(m.chunks, "category")


@query("messages_by_role", sql("messages", "SELECT role, count(*) AS n FROM messages GROUP BY 1"))
def _(m):
    return rp.count_by(m.messages, "role")


@query("top_projects", sql("convs", "SELECT project_name, count(*) AS n FROM convs GROUP BY 1 ORDER BY n DESC, project_name LIMIT 5"))
def _(m):
    return rp.count_by(m.conversations, "project_name").orderBy(F.desc("n"), "project_name").limit(5)


@query("status_counts", sql("chunks", f"SELECT count(*) FILTER (WHERE {ACT}) AS active, count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'merged') AS merged, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE access_count > 0) AS accessed, count(*) AS total FROM chunks"))
def _(m):
    return rp.status_counts(m.chunks)


@query("audit_rollup", sql("reflections", "SELECT reflection_type, count(*) AS n, count(*) FILTER (WHERE action_taken LIKE 'merged%' OR action_taken LIKE '%superseded%' OR action_taken IN ('expired', 'consolidated')) AS mutated FROM reflections GROUP BY 1"))
def _(m):
    return rp.reflection_rollup(m.reflections)


@query("daily_activity_14d", sql("convs", "SELECT d::DATE AS day, coalesce(n, 0)::BIGINT AS n FROM generate_series(DATE '2024-01-04', DATE '2024-01-17', INTERVAL 1 DAY) AS s(d) LEFT JOIN (SELECT started_at::DATE AS day, count(*) AS n FROM convs WHERE started_at >= TIMESTAMP '2024-01-17 12:00:00' - INTERVAL 14 DAY GROUP BY 1) x ON x.day = d::DATE"))
def _(m):
    return rp.daily_activity(m.conversations, F.lit("2024-01-17 12:00:00").cast("timestamp_ntz"))


@query("monthly_activity", sql("convs", f"SELECT strftime(started_at, '%Y-%m') AS month, count(*) AS conversations, sum(message_count)::BIGINT AS messages, round(sum(cost_usd::DOUBLE), 4) AS cost, round(avg({MIN}), 1) AS avg_minutes FROM convs GROUP BY 1"))
def _(m):
    return rp.monthly(m.conversations)


@query("tool_usage_by_day", sql("convs", "SELECT project_name, created_at::DATE AS day, tool_name, count(*) AS calls, round(avg(duration_ms), 2) AS avg_ms FROM messages JOIN convs ON convs.id = conversation_id WHERE tool_name IS NOT NULL GROUP BY 1, 2, 3"))
def _(m):
    return rp.tool_activity(m.messages, m.conversations)


@query("project_time", sql("convs", f"SELECT project_name, count(DISTINCT id) AS sessions, sum(message_count)::BIGINT AS messages, round(sum({MIN})) AS minutes, round(sum(cost_usd::DOUBLE), 2) AS cost FROM convs WHERE ended_at IS NOT NULL GROUP BY 1"))
def _(m):
    return rp.project_time(m.conversations)


@query("session_roles", sql("convs", f"SELECT convs.id, project_name, count(m.id) FILTER (WHERE role = 'user') AS n_user, count(m.id) FILTER (WHERE role = 'assistant') AS n_assistant, count(m.id) FILTER (WHERE role = 'system') AS n_system, any_value({MIN}) AS minutes FROM convs LEFT JOIN messages m ON m.conversation_id = convs.id GROUP BY 1, 2"))
def _(m):
    return rp.session_roles(m.conversations, m.messages)


@query("weekly_tool_usage", sql("messages", "SELECT tool_name, date_trunc('week', created_at)::DATE AS week, count(*) AS uses FROM messages WHERE tool_name IS NOT NULL GROUP BY 1, 2"))
def _(m):
    return rp.weekly_tool_usage(m.messages)


# --- lists ---------------------------------------------------------------------------------------------------


@query("decisions_for_project", sql("chunks convs", f"SELECT chunks.id, created_at::DATE AS day, confidence, summary FROM chunks LEFT JOIN convs ON source_type = 'conversation' AND convs.id = source_id WHERE category = 'decision' AND chunks.project_name = 'src8' AND {ACT}"))
def _(m):
    return rp.decisions_for_project(m.chunks, m.conversations, "src8")


@query("low_confidence", sql("chunks", "SELECT id, confidence, substring(content, 1, 120) AS preview FROM chunks WHERE confidence < 0.80 ORDER BY confidence, created_at, id LIMIT 25"))
def _(m):
    return rp.low_confidence(m.chunks)


@query("long_sessions", sql("convs", f"SELECT id, project_name, round({MIN}, 1) AS minutes FROM convs WHERE {MIN} > 30"))
def _(m):
    return rp.long_sessions(m.conversations, 30)


@query("stale_chunks", sql("chunks", f"SELECT id, category, last_accessed, date_diff('day', created_at, {NOW}) AS age_days FROM chunks WHERE {ACT} AND (last_accessed IS NULL OR last_accessed < {NOW} - INTERVAL 90 DAY) AND created_at < {NOW} - INTERVAL 30 DAY"))
def _(m):
    return rp.stale_chunks(m.chunks, as_of())


@query("hot_chunks", sql("chunks", f"SELECT id, access_count, last_accessed, substring(content, 1, 120) AS preview FROM chunks WHERE {ACT} ORDER BY access_count DESC NULLS LAST, last_accessed DESC NULLS LAST, id LIMIT 10"))
def _(m):
    return rp.hot_chunks(m.chunks)


@query("error_solutions", sql("chunks", "SELECT id, project_name, created_at FROM chunks WHERE category = 'error_solution'"))
def _(m):
    return rp.error_solutions(m.chunks)


@query("search_chunks", sql("chunks", f"SELECT id, category, confidence, created_at FROM chunks WHERE (content ILIKE '%src3%' OR list_contains(tags, 'src3') OR project_name ILIKE '%src3%') AND {ACT} ORDER BY confidence DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 20"))
def _(m):
    return rp.search_chunks(m.chunks, "src3")


@query("search_conversations", sql("convs", "SELECT id, project_name, started_at FROM convs WHERE id IN (SELECT DISTINCT conversation_id FROM messages WHERE content ILIKE '%tion the%') ORDER BY started_at DESC NULLS FIRST, id LIMIT 10"))
def _(m):
    return rp.search_conversations(m.messages, m.conversations, "tion the")


@query("chunks_of_project", sql("chunks", f"SELECT id, category, {RANK} AS rank, confidence FROM chunks WHERE project_name ILIKE '%src1%'"))
def _(m):
    return rp.by_project(m.chunks, "src1")


@query("chunk_list", sql("chunks", f"SELECT id, category, project_name, status FROM chunks WHERE category = 'insight' AND project_name ILIKE '%src%' AND content ILIKE '%the%' AND {ACT} ORDER BY created_at DESC NULLS FIRST, id LIMIT 300"))
def _(m):
    return rp.chunk_list(m.chunks, "insight", "src", "the", "active")


@query("tag_contains", sql("chunks", "SELECT id, array_to_string(tags, ', ') AS tags FROM chunks WHERE list_has_all(tags, ['en', 'src2'])"))
def _(m):
    return rp.with_all_tags(m.chunks, ["en", "src2"])


@query("supersede_links", sql("chunks", "SELECT a.id, a.superseded_by, substring(b.content, 1, 80) AS newer FROM chunks a JOIN chunks b ON a.superseded_by = b.id"))
def _(m):
    return rp.supersede_links(m.chunks)


@query("merge_links", sql("chunks", "SELECT id, status, nullif(coalesce(len(merged_from), 0), 0)::INT AS merged FROM chunks WHERE status IN ('superseded', 'merged') OR len(merged_from) > 0 ORDER BY created_at DESC NULLS LAST, id LIMIT 100"))
def _(m):
    return rp.merge_links(m.chunks)


@query("reflection_log", sql("reflections", "SELECT id, reflection_type, action_taken, nullif(len(affected_chunks), 0)::INT AS affected, substring(reasoning, 1, 200) AS reasoning FROM reflections ORDER BY created_at DESC NULLS LAST, id LIMIT 50"))
def _(m):
    return rp.reflection_log(m.reflections)


@query("recent_conversations", sql("convs", "SELECT id, project_name, message_count FROM convs ORDER BY started_at DESC NULLS LAST, id LIMIT 5"))
def _(m):
    return rp.recent(m.conversations, "started_at", "project_name", "message_count", limit=5)


@query("ingestion_log_recent", sql("ingestion_log", "SELECT id, file_path, record_count FROM ingestion_log ORDER BY ingested_at DESC NULLS LAST, id LIMIT 10"))
def _(m):
    return rp.recent(m.ingestion_log, "ingested_at", "file_path", "record_count", limit=10)


def search_tables(m: Memory) -> dict[str, DataFrame]:
    return {"conversations": m.conversations, "messages": m.messages, "memory_chunks": m.chunks, "skills": m.skills, "projects": m.projects, "prompts": m.prompts}


def _scope(scope, source, where, order, shown, n):
    return f"(SELECT '{scope}' AS scope, id, substring(replace({shown}, chr(10), ' '), 1, 200) AS snippet FROM {source} WHERE {where} ORDER BY {order}, id LIMIT {n})"


def _holds(term, *columns):
    return " OR ".join(f"{c} ILIKE '%{term}%'" for c in columns)


def search_sql(term: str) -> str:
    return sql("chunks convs skills projects prompts", " UNION ALL ".join((
        _scope("conversation", "convs", _holds(term, "summary", "project_name"), "started_at DESC NULLS FIRST", "summary", 20),
        _scope("message", "messages", _holds(term, "content"), "created_at DESC NULLS FIRST", "content", 30),
        _scope("memory", "chunks", _holds(term, "content", "project_name") + f" OR list_contains(tags, '{term}')", "confidence DESC NULLS FIRST", "content", 30),
        _scope("skill", "skills", _holds(term, "name", "description"), "coalesce(file_modified, last_used, created_at) DESC NULLS LAST", "name", 20),
        _scope("project", "projects", _holds(term, "name", "description"), "created_at DESC NULLS LAST", "name", 20),
        _scope("prompt", "prompts", _holds(term, "name", "content"), "updated_at DESC NULLS LAST", "name", 20),
    )))


@query("global_search", search_sql("on"))
def _(m):
    return rp.global_search(search_tables(m), "on")


@query("global_search_tag", search_sql("src3"))
def _(m):
    return rp.global_search(search_tables(m), "src3")


def calendar_tables(m: Memory) -> dict[str, DataFrame]:
    return search_tables(m) | {"entities": m.entities, "memory_reflections": m.reflections, "ingestion_log": m.ingestion_log}


SINCE = "2024-01-03 00:00:00"
_CALENDAR = f"""
    SELECT id, CASE WHEN length(t) > 60 THEN substring(t, 1, 57) || '...' ELSE t END AS title, start, 'conversation' AS type
    FROM (SELECT id, CASE WHEN length(trim(summary)) > 0 THEN summary ELSE 'Session #' || id END AS t, started_at AS start FROM convs)
    UNION ALL (SELECT chunks.id, '[' || category || '] ' || CASE WHEN length(content) > 80 THEN substring(content, 1, 80) || '...' ELSE content END, coalesce(started_at, created_at) AS start, 'memory'
        FROM chunks LEFT JOIN convs ON source_type = 'conversation' AND convs.id = source_id WHERE {ACT} AND coalesce(started_at, created_at) >= TIMESTAMP '{SINCE}' ORDER BY start, chunks.id LIMIT 1000)
    UNION ALL SELECT id, 'Skill: ' || name, coalesce(file_modified, last_used, created_at), 'skill' FROM skills
    UNION ALL SELECT id, 'Project: ' || name, created_at, 'project' FROM projects
    UNION ALL SELECT id, 'Prompt: ' || name, created_at, 'prompt' FROM prompts
    UNION ALL (SELECT id, entity_type || ': ' || name, first_seen, 'entity' FROM entities WHERE first_seen >= TIMESTAMP '{SINCE}' ORDER BY mention_count DESC NULLS FIRST, id LIMIT 300)
    UNION ALL SELECT id, reflection_type || ': ' || action_taken, created_at, 'reflection' FROM reflections
    UNION ALL SELECT id, 'Ingest: ' || split_part(file_path, '/', -1) || ' (' || record_count || ' rec)', ingested_at, 'ingestion' FROM ingestion_log"""
_CALENDAR_TABLES = "chunks convs skills projects prompts entities reflections ingestion_log"


def _calendar(m: Memory) -> DataFrame:
    return rp.calendar(calendar_tables(m), F.lit(SINCE).cast("timestamp_ntz"))


@query("calendar_union", sql(_CALENDAR_TABLES, f"SELECT * FROM ({_CALENDAR}) WHERE start >= TIMESTAMP '{SINCE}'"))
def _(m):
    return _calendar(m)


@query("event_type_counter", sql(_CALENDAR_TABLES, f"SELECT type, count(*) AS n FROM ({_CALENDAR}) WHERE start >= TIMESTAMP '{SINCE}' GROUP BY 1 ORDER BY n DESC, 1"))
def _(m):
    return rp.count_by(_calendar(m), "type").orderBy(F.desc("n"), "type")


@query("project_options", sql("chunks", "SELECT DISTINCT project_name FROM chunks WHERE project_name IS NOT NULL"))
def _(m):
    return rp.distinct_values(m.chunks, "project_name")


@query("skills_top", sql("skills", "SELECT id, name, use_count FROM skills ORDER BY use_count DESC NULLS FIRST, name, id LIMIT 10"))
def _(m):
    return rp.top_skills(m.skills)


@query("skills_list", sql("skills", "SELECT id, name, CASE WHEN last_used IS NOT NULL THEN 'used' WHEN file_modified IS NOT NULL THEN 'file' ELSE 'scanned' END AS kind, coalesce(file_modified, last_used, created_at) AS sort_date FROM skills ORDER BY sort_date DESC NULLS LAST, use_count DESC NULLS LAST, name, id LIMIT 500"))
def _(m):
    return rp.skill_list(m.skills)


@query("skills_search", sql("skills", "SELECT id, name, description FROM skills WHERE name ILIKE '%bolt%' OR description ILIKE '%econ%' ORDER BY use_count DESC NULLS LAST, id LIMIT 20"))
def _(m):
    return m.skills.filter(rp.like("name", "bolt") | rp.like("description", "econ")).orderBy(F.desc_nulls_last("use_count"), "id").limit(20).select("id", "name", "description")


@query("names_with_keywords", sql("entities", "SELECT id, name FROM entities WHERE (name ILIKE '%customer%' AND name ILIKE '%7%')"))
def _(m):
    return m.entities.filter(rp.keywords("name", "customer, 7 customer", every=True)).select("id", "name")


@query("prompts_list", sql("prompts", "SELECT id, name, category, usage_count FROM prompts WHERE category = 'skill' AND (name ILIKE '%the%' OR content ILIKE '%the%') ORDER BY usage_count DESC NULLS LAST, id LIMIT 500"))
def _(m):
    return rp.prompt_list(m.prompts, "skill", "the", "most_used")


@query("projects_list", sql("projects", "SELECT id, name, status FROM projects ORDER BY updated_at DESC NULLS LAST, name"))
def _(m):
    return rp.project_list(m.projects)


@query("contacts", sql("projects", "SELECT name AS project, p->>'name' AS person, p->>'role' AS role FROM (SELECT name, unnest(CAST(contacts AS JSON[])) AS p FROM projects) WHERE p->>'name' ILIKE '%n_1%'"))
def _(m):
    return rp.contacts(m.projects, "n_1")


@query("project_decisions", sql("projects", "SELECT name AS project, d->>'title' AS title, CAST(d->>'date' AS DATE) AS day FROM (SELECT name, unnest(CAST(decisions AS JSON[])) AS d FROM projects)"))
def _(m):
    return rp.project_decisions(m.projects)


@query("recent_errors_since", sql("chunks convs", f"SELECT chunks.id, chunks.created_at, convs.project_name AS session_project FROM chunks LEFT JOIN convs ON source_type = 'conversation' AND convs.id = source_id WHERE category = 'error_solution' AND created_at >= {NOW} - INTERVAL 30 DAY"))
def _(m):
    origin = m.conversations.select(F.col("id").alias("source_id"), F.col("project_name").alias("session_project")).withColumn("source_type", F.lit("conversation"))
    return m.chunks.filter((F.col("category") == "error_solution") & (F.col("created_at") >= rp.since("30d", as_of()))).join(origin, ["source_type", "source_id"], "left").select("id", "created_at", "session_project")


@query("conversation_detail", sql("messages", "SELECT id, role, content FROM messages WHERE conversation_id = 7"))
def _(m):
    return rp.conversation_detail(m.messages, 7)


@query("graph_attribute_conflicts", sql("mentions", "SELECT entity_id AS from_entity, source_id AS to_entity, source_type AS relation_type, count(DISTINCT context_snippet) AS n FROM mentions GROUP BY 1, 2, 3 HAVING count(DISTINCT context_snippet) > 1"))
def _(m):
    attributes = F.to_json(F.create_map(F.lit("priority"), "context_snippet"))
    return g.attribute_conflicts(m.mentions.select(F.col("entity_id").alias("from_entity"), F.col("source_id").alias("to_entity"), F.col("source_type").alias("relation_type"), attributes.alias("attributes")))


@query("graph_attribute_keys", sql("reflections", "SELECT id, id % 7 AS mention_count, 1::BIGINT AS entries, unnest(json_keys(reasoning)) AS key FROM reflections ORDER BY mention_count DESC NULLS FIRST, id, key LIMIT 20"))
def _(m):
    return g.attribute_keys(m.reflections.select("id", (F.col("id") % 7).alias("mention_count"), F.col("reasoning").alias("attributes")))


# --- queues --------------------------------------------------------------------------------------------------


@query("pending_extraction", sql("convs chunks", "SELECT id, message_count FROM convs WHERE message_count >= 5 AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_type = 'conversation' AND c.source_id = convs.id) ORDER BY started_at DESC, id LIMIT 20"))
def _(m):
    return rp.pending_extraction(m.conversations, m.chunks)


@query("pending_entities", sql("convs mentions", "SELECT id, message_count FROM convs WHERE message_count >= 3 AND NOT EXISTS (SELECT 1 FROM mentions x WHERE x.source_type = 'conversation' AND x.source_id = convs.id) ORDER BY started_at DESC, id LIMIT 100"))
def _(m):
    return rp.pending_entities(m.conversations, m.mentions)


@query("missing_titles", sql("convs", "SELECT id, message_count FROM convs WHERE (summary IS NULL OR summary = '') AND message_count >= 2 ORDER BY started_at DESC NULLS FIRST, id LIMIT 50"))
def _(m):
    return rp.missing_titles(m.conversations)


@query("pending_embeddings", sql("chunks messages vectors", "SELECT * FROM (SELECT 'memory_chunk' AS source_type, id AS source_id FROM chunks UNION ALL SELECT 'message', id FROM messages WHERE role IN ('user', 'assistant') AND length(content) >= 100) w WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.source_type = w.source_type AND v.source_id = w.source_id AND v.model = 'model-a' AND v.embedding IS NOT NULL)"))
def _(m):
    return rp.pending_embeddings(m.chunks, m.messages, m.embeddings, "model-a")


# --- texts ---------------------------------------------------------------------------------------------------


@query("transcript_build", sql("messages", "SELECT conversation_id, sha256(t) AS digest, length(t) AS n FROM (SELECT conversation_id, right(string_agg('[' || upper(role) || ']' || chr(10) || CASE WHEN length(content) > 1000 THEN substring(content, 1, 1000) || '...[gekürzt]' ELSE content END || chr(10), chr(10) ORDER BY created_at, id), 80000) AS t FROM messages WHERE role IN ('user', 'assistant') AND coalesce(content, '') <> '' GROUP BY 1) WHERE length(t) >= 200"))
def _(m):
    return rp.transcripts(m.messages).select("conversation_id", F.sha2("transcript", 256).alias("digest"), F.length("transcript").cast("long").alias("n"))


@query("preview_build", sql("messages", "SELECT conversation_id, sha256(t) AS digest FROM (SELECT conversation_id, substring(string_agg('[' || role || '] ' || cut, chr(10) ORDER BY k), 1, 4000) AS t FROM (SELECT *, coalesce(sum(length(cut)) OVER (PARTITION BY conversation_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM (SELECT *, substring(content, 1, 500) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS k FROM messages) WHERE k <= 30 AND role <> 'tool_result' AND coalesce(content, '') <> '')) WHERE so_far <= 4000 GROUP BY 1) WHERE length(t) >= 100"))
def _(m):
    return rp.previews(m.messages).select("conversation_id", F.sha2("preview", 256).alias("digest"))


PRELOADED = "category IN ('decision', 'preference', 'pattern', 'error_solution', 'project_context')"


@query("context_preload", sql("chunks", f"SELECT id, priority, category, confidence FROM (SELECT *, 1 AS priority FROM chunks WHERE project_name ILIKE '%src5%' AND {PRELOADED} UNION ALL SELECT *, 2 FROM chunks WHERE (project_name IS NULL OR project_name NOT ILIKE '%src5%') AND {PRELOADED}) ORDER BY priority, confidence DESC NULLS LAST, created_at DESC NULLS FIRST, id LIMIT 20"))
def _(m):
    return rp.context_preload(m.chunks, "src5")


def redact_sql(text: str) -> str:
    """All rules, in their order, for an engine whose word boundaries are of ASCII."""
    for rule, by in tx.REDACTIONS:
        plain = rule.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")
        text = f"regexp_replace({text}, '{plain}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return text


def _redacted(text: str) -> str:
    return sql("chunks", f"SELECT id, sha256(r) AS digest, greatest(0, (length(r) - length(replace(r, '<REDACTED', ''))) // 9 - (length(t) - length(replace(t, '<REDACTED', ''))) // 9)::INT AS n FROM (SELECT id, t, {redact_sql('t')} AS r FROM (SELECT id, {text} AS t FROM chunks))")


def _digests(df: DataFrame) -> DataFrame:
    return df.withColumn("r", tx.redact("t")).select("id", F.sha2("r", 256).alias("digest"), tx.redactions("t", "r").alias("n"))


@query("redact_text", _redacted("content"))
def _(m):
    return _digests(m.chunks.select("id", F.col("content").alias("t")))


#: One made-up string for each rule, and some that no rule takes.
PLANTED = " ".join((
    "-----BEGIN RSA PRIVATE KEY-----abc-----END RSA PRIVATE KEY-----", "sk-ant-" + "a1" * 12, "sk-proj-" + "b2" * 12, "sk-" + "c3" * 16, "ghp_" + "d4" * 16, "AKIA" + "E5" * 8, "AIza" + "f" * 35,
    "xoxb-" + "1" * 12, "sk_live_" + "g6" * 12, "eyJ" + "h" * 10 + "." + "i" * 10 + "." + "j" * 10, "Authorization: Bearer " + "k7" * 6, "password = hunter22", "api_key:abcdef", "ann@example.org", "/Users/ann/x", "/home/bob/y",
    "sk-short", "AKIA1", "a token of esteem", "mail at example", "ghost", "/User/x",
))


@query("redact_planted", _redacted(f"content || ' {PLANTED}'"))
def _(m):
    return _digests(m.chunks.select("id", F.concat("content", F.lit(f" {PLANTED}")).alias("t")))


@table_query("json_props", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@table_query("exact_dup_hash", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@table_query("title_extract", "SELECT page_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 77) || '...' ELSE t END AS title FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages)")
def _(spark, folder):
    t = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t).alias("title"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@table_query("trigram_topk", f"SELECT p_partkey, p_name, round(s, 6) AS similarity FROM (SELECT p_partkey, p_name, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM (SELECT *, {_GRAMS.format('p_name')} AS a, {_GRAMS.format(chr(39) + 'cold widgets' + chr(39))} AS b FROM part)) WHERE s > 0.3 ORDER BY s DESC, p_partkey LIMIT 10")
def _(spark, folder):
    return rt.trigram_search(spark.read.parquet(f"{folder}/part.parquet"), "p_name", "cold widgets", "p_partkey")


# --- vectors -------------------------------------------------------------------------------------------------

_DIST = f"1 - list_dot_product(embedding::DOUBLE[], {VECTOR_SQL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL})))"
_SCORED = f"SELECT source_type, source_id, project_name, category, {_DIST} AS distance FROM (SELECT v.*, c.project_name, c.category FROM vectors v JOIN chunks c ON v.source_type = 'memory_chunk' AND c.id = v.source_id UNION ALL SELECT v.*, convs.project_name, NULL FROM vectors v JOIN messages m ON v.source_type = 'message' AND m.id = v.source_id JOIN convs ON convs.id = m.conversation_id)"


def _nearest(m: Memory, **wanted) -> DataFrame:
    return _shown(rt.nearest(m.embeddings, m.chunks, m.messages, m.conversations, VECTOR, **wanted))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source_type", "source_id", "project_name", F.round("distance", 6).alias("distance"))


_KNN = "SELECT source_type, source_id, project_name, round(distance, 6) AS distance FROM ({} ORDER BY distance, source_type, source_id LIMIT 10)"


@query("knn_search", sql("vectors chunks convs", _KNN.format(f"SELECT * FROM ({_SCORED})")))
def _(m):
    return _nearest(m)


@query("knn_project_scoped", sql("vectors chunks convs", _KNN.format(f"SELECT * FROM ({_SCORED}) WHERE project_name = 'src4'")))
def _(m):
    return _nearest(m, project="src4")


@query("knn_scope_after_limit", sql("vectors chunks convs", _KNN.format(f"SELECT * FROM ({_SCORED})") + " WHERE source_type = 'memory_chunk'"))
def _(m):
    return _nearest(m, scope="memory_chunk")


@query("knn_threshold", sql("vectors chunks convs", _KNN.format(f"SELECT * FROM ({_SCORED}) WHERE 1 - distance > 0.1")))
def _(m):
    return _nearest(m, least=0.1)


@query("similar_to_source", sql("vectors", "SELECT v.id, v.source_type, v.source_id, round(1 - list_dot_product(v.embedding::DOUBLE[], o.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(o.e, o.e))), 6) AS distance FROM vectors v, (SELECT embedding::DOUBLE[] AS e FROM vectors WHERE source_type = 'memory_chunk' AND source_id = 10 ORDER BY id LIMIT 1) o WHERE NOT (v.source_type = 'memory_chunk' AND v.source_id = 10) ORDER BY distance, v.id LIMIT 8"))
def _(m):
    return rt.similar_to(m.embeddings, "memory_chunk", 10)


# --- graph ---------------------------------------------------------------------------------------------------


@query("graph_resolve", sql("entities", "WITH t AS (SELECT *, CASE WHEN canonical_name = 'europe' THEN 0 WHEN name ILIKE '%europe%' THEN 1 END AS tier FROM entities) SELECT id, entity_type, name, mention_count FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY mention_count DESC NULLS FIRST, id LIMIT 10"))
def _(m):
    return g.resolve(m.entities, "Europe ")


@query("graph_neighbors", sql("entities relationships", "SELECT * FROM (SELECT to_entity AS other, 'out' AS direction, relation_type, confidence FROM relationships WHERE from_entity = 103 UNION ALL SELECT from_entity, 'in', relation_type, confidence FROM relationships WHERE to_entity = 103) JOIN (SELECT id AS other, name AS other_name FROM entities) USING (other)"))
def _(m):
    return g.neighbours(m.entities, m.relationships, 103)


_EDGES = "e AS (SELECT from_entity AS a, to_entity AS b FROM relationships UNION SELECT to_entity, from_entity FROM relationships)"
_WALK = f"WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT 1003::BIGINT, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < {{}}), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)"


@query("graph_distances", sql("relationships", _WALK.format(6) + " SELECT node, depth::INT AS depth FROM d"))
def _(m):
    return g.distances(m.relationships, 1003)


#: All shortest ways, by distances from both ends, and the smallest of them.
_SHORTEST = (
    _WALK.format(6).replace("1003::", "103::") + ", v(node, depth) AS (SELECT 118::BIGINT, 0 UNION SELECT e.b, v.depth + 1 FROM v JOIN e ON e.a = v.node WHERE v.depth < 6), f AS (SELECT node, min(depth) AS depth FROM v GROUP BY 1), "
    "p(node, path) AS (SELECT 103::BIGINT, [103::BIGINT] UNION ALL SELECT e.b, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.node JOIN d ON d.node = e.b AND d.depth = len(p.path) JOIN f ON f.node = e.b AND f.depth + len(p.path) = (SELECT depth FROM d WHERE node = 118)) "
    "SELECT len(path)::INT AS nodes, array_to_string(path, '>') AS path FROM p WHERE node = 118 ORDER BY p.path LIMIT 1"
)


@query("graph_path", sql("relationships", _SHORTEST))
def _(m):
    return g.path(m.relationships, 103, 118).select("nodes", F.array_join("path", ">").alias("path"))


@query("graph_khop", sql("relationships", _WALK.format(2) + " SELECT b.depth::INT AS hop, from_entity, to_entity, relation_type FROM relationships r JOIN d a ON a.node IN (r.from_entity, r.to_entity) JOIN d b ON b.node = CASE WHEN a.node = r.from_entity THEN r.to_entity ELSE r.from_entity END WHERE b.depth = a.depth + 1"))
def _(m):
    return g.recall(m.relationships, 1003, 2)


@query("graph_degree", sql("entities relationships", "SELECT id, name, mention_count, count(*) AS degree FROM entities JOIN (SELECT from_entity AS id FROM relationships UNION ALL SELECT to_entity FROM relationships WHERE to_entity <> from_entity) USING (id) GROUP BY 1, 2, 3"))
def _(m):
    return g.degrees(m.entities, m.relationships)


@query("graph_top", sql("entities", "SELECT id, name, mention_count FROM entities WHERE entity_type = 'project' ORDER BY mention_count DESC NULLS FIRST, id LIMIT 20"))
def _(m):
    return m.entities.filter("entity_type = 'project'").orderBy(F.desc_nulls_first("mention_count"), "id").limit(20).select("id", "name", "mention_count")


@query("graph_contradictions", sql("relationships", "SELECT from_entity, to_entity, array_to_string(list_sort(list(DISTINCT relation_type)), ',') AS types, count(DISTINCT relation_type) AS n_types FROM relationships GROUP BY 1, 2 HAVING count(DISTINCT relation_type) > 1"))
def _(m):
    return g.contradictions(m.relationships)


@query("graph_timeline", sql("entities relationships mentions convs", "SELECT 'mention' AS kind, x.created_at, convs.project_name AS detail FROM mentions x LEFT JOIN convs ON x.source_type = 'conversation' AND convs.id = x.source_id WHERE entity_id = 100007 UNION ALL SELECT 'relation', r.created_at, a.name || ' ' || relation_type || ' ' || b.name FROM relationships r JOIN entities a ON a.id = from_entity JOIN entities b ON b.id = to_entity WHERE 100007 IN (from_entity, to_entity)"))
def _(m):
    return g.timeline(m.entities, m.relationships, m.mentions, m.conversations, 100007)


@query("graph_keyword_subgraph", sql("entities relationships", "WITH s AS (SELECT id FROM entities WHERE name ILIKE '%asia%' OR name ILIKE '%america%'), n AS (SELECT id FROM s UNION SELECT to_entity FROM relationships JOIN s ON s.id = from_entity UNION SELECT from_entity FROM relationships JOIN s ON s.id = to_entity), k AS (SELECT e.id FROM entities e JOIN n USING (id) WHERE mention_count >= 0 ORDER BY mention_count DESC NULLS LAST, e.id LIMIT 200) SELECT from_entity, to_entity, relation_type FROM relationships WHERE from_entity IN (SELECT id FROM k) AND to_entity IN (SELECT id FROM k)"))
def _(m):
    return g.subgraph(m.entities, m.relationships, ["asia", "america"])


@query("graph_best_match", sql("entities", "SELECT canonical_name, id, mention_count FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY (project_name = 'proj3') DESC NULLS LAST, mention_count DESC NULLS FIRST, id) AS k FROM entities) WHERE k = 1"))
def _(m):
    return g.best_match(m.entities, "proj3")


@query("entity_upsert_merge", sql("entities mentions", "WITH f AS (SELECT e.entity_type, e.canonical_name, e.project_name, count(*) AS n FROM mentions x JOIN entities e ON e.id = x.entity_id GROUP BY 1, 2, 3) SELECT entity_type, canonical_name, project_name, (e.mention_count + coalesce(n, 0))::BIGINT AS mention_count, greatest(0.8, CASE WHEN n IS NOT NULL THEN 0.9 END)::DOUBLE AS confidence FROM entities e LEFT JOIN f USING (entity_type, canonical_name, project_name)"))
def _(m):
    found = m.mentions.join(m.entities.drop("mention_count"), m.mentions.entity_id == m.entities.id).select("entity_type", "canonical_name", "project_name", F.lit(1).alias("mention_count"), F.lit(0.9).alias("confidence"))
    return g.upsert_entities(m.entities.select("entity_type", "canonical_name", "project_name", "mention_count", F.lit(0.8).alias("confidence")), found).withColumn("mention_count", F.col("mention_count").cast("long"))


# --- maintenance ---------------------------------------------------------------------------------------------


@query("dedup_pairs", sql("chunks", f"SELECT a.id AS id_a, b.id AS id_b, a.category FROM chunks a JOIN chunks b ON a.category = b.category AND coalesce(a.project_name, '') = coalesce(b.project_name, '') AND a.id < b.id WHERE coalesce(a.status, 'active') = 'active' AND coalesce(b.status, 'active') = 'active' ORDER BY a.category, coalesce(a.project_name, ''), 1, 2 LIMIT 80"))
def _(m):
    return rf.candidate_pairs(m.chunks)


@query("stale_candidates", sql("chunks", rf"SELECT id FROM chunks WHERE {ACT} AND (" + " OR ".join(f"contains(lower(content), '{w}')" for w in tx.STALE_WORDS) + r" OR regexp_matches(lower(content), '\b(\d{1,2}\.\d{1,2}\.(\d{2,4})?|\d{4}-\d{2}-\d{2}|q[1-4]/\d{2,4}|kw\s?\d{1,2})\b'))"))
def _(m):
    return rf.stale_candidates(m.chunks).select("id")


@query("tag_clusters", sql("chunks", f"SELECT category, coalesce(project_name, '') AS project, lower(tag) AS tag, count(DISTINCT id) AS size FROM (SELECT *, unnest(tags) AS tag FROM chunks WHERE {ACT}) GROUP BY 1, 2, 3 HAVING count(DISTINCT id) >= 3"))
def _(m):
    return rf.tag_clusters(m.chunks).select("category", "project", "tag", "size")


@query("supersede_apply", sql("chunks", "SELECT id, CASE WHEN id IN (5, 9) THEN 'superseded' ELSE status END AS status, CASE WHEN id IN (5, 9) THEN 11 ELSE superseded_by END AS superseded_by FROM chunks"))
def _(m):
    return mu.supersede(m.chunks, [5, 9], 11).select("id", "status", "superseded_by")


@query("forget_cascade", sql("chunks vectors", "SELECT 'chunk' AS kind, id, CASE WHEN superseded_by IN (4, 8, 15) THEN NULL ELSE superseded_by END AS ref FROM chunks WHERE id NOT IN (4, 8, 15) UNION ALL SELECT 'embedding', id, source_id FROM vectors WHERE NOT (source_type = 'memory_chunk' AND source_id IN (4, 8, 15))"))
def _(m):
    chunks, embeddings = mu.forget_chunks(m.chunks, m.embeddings, [4, 8, 15])
    return chunks.select(F.lit("chunk").alias("kind"), "id", F.col("superseded_by").alias("ref")).unionByName(embeddings.select(F.lit("embedding").alias("kind"), "id", F.col("source_id").alias("ref")))


@query("upsert_latest_wins", sql("chunks", "SELECT project_name AS name, id, created_at, id <> first_id AS updated FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY created_at DESC, id DESC) AS k, min(id) OVER (PARTITION BY project_name) AS first_id FROM chunks WHERE project_name IS NOT NULL) WHERE k = 1"))
def _(m):
    rows = m.chunks.filter("project_name IS NOT NULL").select(F.col("project_name").alias("name"), "id", "created_at")
    firsts = rows.groupBy("name").agg(F.min("id").alias("id")).join(rows, ["name", "id"])
    return mu.upsert(firsts, rows, ["name"], ["created_at", "id"]).join(firsts.select("name", F.col("id").alias("first_id")), "name").select("name", "id", "created_at", (F.col("id") != F.col("first_id")).alias("updated"))


@query("access_tracking", sql("chunks", f"SELECT id, (access_count + CASE WHEN id IN (1, 2, 3) THEN 1 ELSE 0 END)::INT AS access_count, CASE WHEN id IN (1, 2, 3) THEN {NOW} ELSE last_accessed END AS last_accessed FROM chunks"))
def _(m):
    return mu.touch(m.chunks, m.chunks.filter("id IN (1, 2, 3)").select("id"), as_of()).select("id", "access_count", "last_accessed")


@query("new_files", sql("ingestion_log", "SELECT id, file_path FROM ingestion_log l WHERE NOT EXISTS (SELECT 1 FROM ingestion_log x JOIN labels ON doc_id = x.id WHERE x.file_path = l.file_path AND x.file_hash = l.file_hash)"))
def _(m):
    logged = m.ingestion_log.join(m.read("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return mu.not_yet(m.ingestion_log, logged, ["file_path", "file_hash"]).select("id", "file_path")


@query("memory_decay", sql("chunks", f"SELECT id, round(confidence::DOUBLE * CASE WHEN last_accessed > {NOW} - INTERVAL 7 DAY THEN 1.0 WHEN last_accessed > {NOW} - INTERVAL 30 DAY THEN 0.8 WHEN last_accessed > {NOW} - INTERVAL 90 DAY THEN 0.5 ELSE 0.2 END, 6) AS weight FROM chunks WHERE {ACT}"))
def _(m):
    return m.chunks.filter(rp.active()).select("id", F.round(F.col("confidence").cast("double") * tx.decay("last_accessed", as_of()), 6).alias("weight"))


@table_query("eval_recall", "SELECT count(*) AS questions, sum(hit)::BIGINT AS hits, round(avg(hit), 4) AS recall FROM (SELECT item_id, max(CASE WHEN contains(lower(coalesce(d.text, '')), lower(b.text)) THEN 1 ELSE 0 END) AS hit FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY 1)")
def _(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("id"), F.array("text").alias("expected"))
    answers = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return rp.eval_recall(items, answers)
