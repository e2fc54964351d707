"""Tables of the memory model as Spark schemas (DDL), and its enumerations in their order of declaration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and the value lists that writers check.
CATEGORIES = ("decision", "pattern", "insight", "preference", "contact", "error_solution", "project_context", "workflow")
ROLES = ("user", "assistant", "system", "tool_result")
PRELOADED = ("decision", "preference", "pattern", "error_solution", "project_context")
PROJECT_STATES = ("active", "paused", "completed", "archived")
CHUNK_STATES = ("active", "superseded", "merged", "stale")
ENTITY_TYPES = ("person", "project", "technology", "decision", "concept", "organization")
RELATION_TYPES = ("works_on", "uses", "decided", "blocks", "relates_to", "member_of", "reports_to", "depends_on", "replaces")


CONVERSATIONS = "id long, session_id string, project_path string, project_name string, model string, entrypoint string, git_branch string, started_at timestamp, ended_at timestamp, message_count int, token_count_in int, token_count_out int, cost_usd decimal(10,4), summary string, tags array<string>, metadata string, created_at timestamp, updated_at timestamp"
MESSAGES = "id long, conversation_id long, uuid string, parent_uuid string, role string, content string, content_blocks string, tool_calls string, tool_name string, token_count int, is_sidechain boolean, model string, duration_ms int, created_at timestamp, metadata string"
CHUNKS = "id long, source_type string, source_id long, content string, category string, tags array<string>, confidence decimal(3,2), project_name string, expires_at timestamp, created_at timestamp, superseded_by long, superseded_at timestamp, status string, merged_from array<long>, access_count int, last_accessed timestamp"
EMBEDDINGS = "id long, source_type string, source_id long, embedding array<float>, model string, created_at timestamp"
ENTITIES = "id long, entity_type string, name string, canonical_name string, attributes map<string,string>, first_seen timestamp, last_seen timestamp, mention_count int, project_name string, confidence decimal(3,2), metadata string"
RELATIONSHIPS = "id long, from_entity long, to_entity long, relation_type string, valid_from timestamp, valid_until timestamp, confidence decimal(3,2), source_type string, source_id long, attributes map<string,string>, created_at timestamp"
MENTIONS = "id long, entity_id long, source_type string, source_id long, context_snippet string, created_at timestamp"
REFLECTIONS = "id long, reflection_type string, affected_chunks array<long>, action_taken string, reasoning string, confidence decimal(3,2), created_at timestamp"
INGESTION_LOG = "id long, file_path string, file_hash string, ingested_at timestamp, record_count int"
SKILLS = "id long, name string, version string, description string, path string, triggers array<string>, last_used timestamp, use_count int, config string, created_at timestamp, updated_at timestamp, file_created timestamp, file_modified timestamp"
PROMPTS = "id long, name string, category string, content string, variables array<string>, source_path string, usage_count int, tags array<string>, created_at timestamp, updated_at timestamp"
PROJECTS = "id long, name string, description string, contacts array<struct<name:string,role:string>>, decisions array<struct<title:string,date:string>>, status string, created_at timestamp, updated_at timestamp"
CHUNK_EVENTS = "event string, kind string, id long, at timestamp, place int, superseded_by long, content string, category string, tags array<string>, confidence decimal(3,2), project_name string, status string, expires_at timestamp"
MIGRATIONS = "migration_name string, applied_at timestamp"

TABLES = {
    "conversations": CONVERSATIONS, "messages": MESSAGES, "memory_chunks": CHUNKS, "embeddings": EMBEDDINGS, "entities": ENTITIES,
    "relationships": RELATIONSHIPS, "entity_mentions": MENTIONS, "memory_reflections": REFLECTIONS, "ingestion_log": INGESTION_LOG,
    "skills": SKILLS, "prompts": PROMPTS, "projects": PROJECTS, "applied_migrations": MIGRATIONS, "chunk_events": CHUNK_EVENTS,
}


def category_rank(column: str | Column = "category") -> Column:
    """Place of a category in its declaration, which is how the enumeration sorts."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(c == CATEGORIES[0], 0)
    for i, name in enumerate(CATEGORIES[1:], 1):
        out = out.when(c == name, i)
    return out


def active(column: str | Column = "status") -> Column:
    """A chunk without a status is active."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("active")) == "active"
