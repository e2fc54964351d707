"""The catalogue of reports: each takes tables of the memory model and returns a DataFrame.

Where an order decides which rows a limit keeps, ties are settled by id, and the place of nulls is always said.
`as_of` is a timestamp column; nothing reads the clock.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import CATEGORIES, PRELOADED, active, category_rank

MINUTES = "timestampdiff(MICROSECOND, started_at, ended_at) / 6e7"


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return functools.reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def like(column: str, term: str) -> Column:
    """Substring in any case; wildcards in the term keep their meaning."""
    return F.col(column).ilike(f"%{term}%")


def before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


# --- rollups -------------------------------------------------------------------------------------------------


def conversation_stats(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("project_name").agg(F.count("*").alias("conversations"), F.sum("message_count").alias("messages"), F.round(F.avg(F.col("token_count_in") + F.col("token_count_out")), 2).alias("avg_tokens"), F.sum("cost_usd").cast("double").alias("cost"))


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    one = [t.agg(F.count("*").alias(n)) for n, t in tables.items()]
    return functools.reduce(lambda a, b: a.crossJoin(b), one)  # one row each


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def status_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_if(active()).alias("active"), *(F.count_if(F.col("status") == s).alias(s) for s in ("superseded", "merged", "stale")),
        F.count_if(F.col("access_count") > 0).alias("accessed"), F.count("*").alias("total"),
    )


def reflection_rollup(reflections: DataFrame) -> DataFrame:
    changed = F.col("action_taken").like("merged%") | F.col("action_taken").like("%superseded%") | F.col("action_taken").isin("expired", "consolidated")
    return reflections.groupBy("reflection_type").agg(F.count("*").alias("n"), F.count_if(changed).alias("mutated"))


def coverage_by_project(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("project_name", F.lit("(none)")).alias("project")).agg(F.count("*").alias("total"), *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("avg_confidence"))


def daily_activity(conversations: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Conversations started on each of the last days, days without any included."""
    last = F.to_date(as_of)
    spine = conversations.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    per_day = conversations.filter(F.col("started_at") >= before(as_of, days)).groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def monthly(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy(F.date_format("started_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("conversations"), F.sum("message_count").alias("messages"), F.round(F.sum(F.col("cost_usd").cast("double")), 4).alias("cost"), F.round(F.avg(F.expr(MINUTES)), 1).alias("avg_minutes"))


def tool_activity(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    both = messages.filter(F.col("tool_name").isNotNull()).join(conversations.select(F.col("id").alias("conversation_id"), "project_name"), "conversation_id")
    return both.groupBy("project_name", F.to_date("created_at").alias("day"), "tool_name").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"))


def project_time(conversations: DataFrame) -> DataFrame:
    return conversations.filter("ended_at IS NOT NULL").groupBy("project_name").agg(F.countDistinct("id").alias("sessions"), F.sum("message_count").alias("messages"), F.round(F.sum(F.expr(MINUTES))).alias("minutes"), F.round(F.sum(F.col("cost_usd").cast("double")), 2).alias("cost"))


def session_roles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conversation its messages by role and its length in minutes."""
    per = messages.groupBy("conversation_id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")))
    return conversations.join(per, conversations.id == per.conversation_id, "left").select("id", "project_name", *(F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in ("user", "assistant", "system")), F.expr(MINUTES).alias("minutes"))


def weekly_tool_usage(messages: DataFrame) -> DataFrame:
    return messages.filter("tool_name IS NOT NULL").groupBy("tool_name", F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(F.count("*").alias("uses"))


# --- lists ---------------------------------------------------------------------------------------------------


def decisions_for_project(chunks: DataFrame, conversations: DataFrame, project: str) -> DataFrame:
    c = chunks.filter(all_of(F.col("category") == "decision", F.col("project_name") == project, active()))
    source = conversations.select(F.col("id").alias("source_id"), "summary").withColumn("source_type", F.lit("conversation"))
    return c.join(source, ["source_type", "source_id"], "left").select("id", F.to_date("created_at").alias("day"), "confidence", "summary").orderBy(F.desc("day"), "id")


def low_confidence(chunks: DataFrame, below: float = 0.80, limit: int = 25) -> DataFrame:
    return chunks.filter(F.col("confidence") < below).orderBy(F.asc_nulls_last("confidence"), F.asc_nulls_last("created_at"), "id").limit(limit).select("id", "confidence", F.substring("content", 1, 120).alias("preview"))


def long_sessions(conversations: DataFrame, minutes: int) -> DataFrame:
    return conversations.filter(F.expr(MINUTES) > minutes).select("id", "project_name", F.round(F.expr(MINUTES), 1).alias("minutes")).orderBy(F.desc("minutes"), "id")


def stale_chunks(chunks: DataFrame, as_of: Column, idle: int = 90, old: int = 30) -> DataFrame:
    never = F.col("last_accessed").isNull() | (F.col("last_accessed") < before(as_of, idle))
    return chunks.filter(all_of(active(), never, F.col("created_at") < before(as_of, old))).select("id", "category", "last_accessed", F.datediff(as_of, F.col("created_at")).cast("long").alias("age_days")).orderBy(F.asc_nulls_first("last_accessed"), "id")


def hot_chunks(chunks: DataFrame, limit: int = 10) -> DataFrame:
    return chunks.filter(active()).orderBy(F.desc_nulls_last("access_count"), F.desc_nulls_last("last_accessed"), "id").limit(limit).select("id", "access_count", "last_accessed", F.substring("content", 1, 120).alias("preview"))


def error_solutions(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("category") == "error_solution").select("id", "project_name", "created_at").orderBy(F.asc_nulls_last("project_name"), F.desc("created_at"), "id")


def search_chunks(chunks: DataFrame, term: str, limit: int = 20, only_active: bool = True) -> DataFrame:
    """Chunks whose text or project holds the term or which have it as a tag, the surest and newest first."""
    hit = like("content", term) | F.array_contains("tags", term) | like("project_name", term)
    return chunks.filter(all_of(hit, active() if only_active else None)).orderBy(F.desc_nulls_first("confidence"), F.desc_nulls_first("created_at"), "id").limit(limit).select("id", "category", "confidence", "created_at")


def search_conversations(messages: DataFrame, conversations: DataFrame, term: str, limit: int = 10) -> DataFrame:
    hits = messages.filter(like("content", term)).select(F.col("conversation_id").alias("id")).distinct()
    return conversations.join(hits, "id", "left_semi").select("id", "project_name", "started_at").orderBy(F.desc_nulls_first("started_at"), "id").limit(limit)


def by_project(chunks: DataFrame, project: str) -> DataFrame:
    """Chunks of the projects whose name holds the term, by category as declared, the surest first."""
    return chunks.filter(like("project_name", project)).select("id", "category", category_rank().alias("rank"), "confidence").orderBy("rank", F.desc_nulls_first("confidence"), "id")


def chunk_list(chunks: DataFrame, category: str | None = None, project: str | None = None, text: str | None = None, status: str | None = None, limit: int = 300) -> DataFrame:
    wanted = all_of(F.col("category") == category if category else None, like("project_name", project) if project else None, like("content", text) if text else None, (active() if status == "active" else F.col("status") == status) if status else None)
    return chunks.filter(wanted).orderBy(F.desc_nulls_first("created_at"), "id").limit(limit).select("id", "category", "project_name", "status")


def with_all_tags(chunks: DataFrame, tags: list[str]) -> DataFrame:
    return chunks.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0).select("id", F.array_join("tags", ", ").alias("tags"))


def supersede_links(chunks: DataFrame) -> DataFrame:
    """Chunks with the chunk that took their place."""
    newer = chunks.select(F.col("id").alias("superseded_by"), F.substring("content", 1, 80).alias("newer"))
    return chunks.filter("superseded_by IS NOT NULL").join(newer, "superseded_by").select("id", "superseded_by", "newer")


def merge_links(chunks: DataFrame, limit: int = 100) -> DataFrame:
    linked = F.col("status").isin("superseded", "merged") | (F.coalesce(F.size("merged_from"), F.lit(0)) > 0)
    return chunks.filter(linked).orderBy(F.desc_nulls_last("created_at"), "id").limit(limit).select("id", "status", F.nullif(F.greatest(F.coalesce(F.size("merged_from"), F.lit(0)), F.lit(0)), F.lit(0)).alias("merged"))


def reflection_log(reflections: DataFrame, limit: int = 50) -> DataFrame:
    return reflections.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit).select("id", "reflection_type", "action_taken", F.nullif(F.size("affected_chunks"), F.lit(0)).alias("affected"), F.substring("reasoning", 1, 200).alias("reasoning"))


def recent(df: DataFrame, stamp: str, *columns: str, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(stamp), "id").limit(limit).select("id", *columns)


def global_search(tables: dict[str, DataFrame], term: str) -> DataFrame:
    """Hits of the six scopes, each in its order and with its own limit.

    `tables` has conversations, messages, memory_chunks, skills, projects and prompts.
    """
    holds = lambda *columns: functools.reduce(operator.or_, [like(c, term) for c in columns])
    shown_last = F.coalesce("file_modified", "last_used", "created_at")
    scopes = (
        ("conversation", "conversations", holds("summary", "project_name"), F.desc_nulls_first("started_at"), "summary", 20),
        ("message", "messages", holds("content"), F.desc_nulls_first("created_at"), "content", 30),
        ("memory", "memory_chunks", holds("content", "project_name") | F.array_contains("tags", term), F.desc_nulls_first("confidence"), "content", 30),
        ("skill", "skills", holds("name", "description"), F.desc_nulls_last(shown_last), "name", 20),
        ("project", "projects", holds("name", "description"), F.desc_nulls_last("created_at"), "name", 20),
        ("prompt", "prompts", holds("name", "content"), F.desc_nulls_last("updated_at"), "name", 20),
    )
    found = []
    for scope, table, wanted, order, shown, limit in scopes:
        rows = tables[table].filter(wanted).orderBy(order, "id").limit(limit)
        snippet = F.substring(F.regexp_replace(shown, "\n", " "), 1, 200)
        found.append(rows.select(F.lit(scope).alias("scope"), "id", snippet.alias("snippet")))
    return functools.reduce(DataFrame.unionByName, found)


def _short(text: str | Column, most: int) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def calendar(tables: dict[str, DataFrame], since: Column, most_chunks: int = 1000, most_entities: int = 300) -> DataFrame:
    """Events of the eight sources in one form: type, id, title, start. The limits are features of the list.

    `tables` has conversations, memory_chunks, skills, projects, prompts, entities, memory_reflections, ingestion_log.
    """
    t = tables
    summary = F.col("summary")
    untitled = F.concat(F.lit("Session #"), F.col("id").cast("string"))
    named = F.when(F.length(F.trim(summary)) > 0, summary).otherwise(untitled)
    origin = t["conversations"].select(F.col("id").alias("source_id"), F.col("started_at").alias("at")).withColumn("source_type", F.lit("conversation"))
    dated = t["memory_chunks"].filter(active()).join(origin, ["source_type", "source_id"], "left").withColumn("start", F.coalesce("at", "created_at")).filter(F.col("start") >= since)
    kind = lambda label, column="name": F.concat(F.lit(label), F.lit(": "), F.col(column))
    of = lambda df, title, start: df.select("id", title.alias("title"), start.alias("start"))
    entities = t["entities"].filter(F.col("first_seen") >= since).orderBy(F.desc_nulls_first("mention_count"), "id").limit(most_entities)
    file_name = F.element_at(F.split("file_path", "/"), -1)
    parts = {
        "conversation": of(t["conversations"], F.when(F.length(named) > 60, F.concat(F.substring(named, 1, 57), F.lit("..."))).otherwise(named), F.col("started_at")),
        "memory": of(dated.orderBy("start", "id").limit(most_chunks), F.concat(F.lit("["), "category", F.lit("] "), _short("content", 80)), F.col("start")),
        "skill": of(t["skills"], kind("Skill"), F.coalesce("file_modified", "last_used", "created_at")),
        "project": of(t["projects"], kind("Project"), F.col("created_at")),
        "prompt": of(t["prompts"], kind("Prompt"), F.col("created_at")),
        "entity": of(entities, F.concat("entity_type", F.lit(": "), "name"), F.col("first_seen")),
        "reflection": of(t["memory_reflections"], F.concat("reflection_type", F.lit(": "), "action_taken"), F.col("created_at")),
        "ingestion": of(t["ingestion_log"], F.concat(F.lit("Ingest: "), file_name, F.lit(" ("), F.col("record_count").cast("string"), F.lit(" rec)")), F.col("ingested_at")),
    }
    return functools.reduce(DataFrame.unionByName, [d.filter(F.col("start") >= since).withColumn("type", F.lit(k)) for k, d in parts.items()])


def conversation_list(conversations: DataFrame, messages: DataFrame, project: str | None = None, model: str | None = None, text: str | None = None, limit: int = 500) -> DataFrame:
    """Conversations of a project and a model with a text in their messages, each filter optional, the newest first."""
    rows = conversations.filter(all_of(F.col("project_name") == project if project else None, F.col("model") == model if model else None))
    if text:
        rows = rows.join(messages.filter(like("content", text)).select(F.col("conversation_id").alias("id")), "id", "left_semi")
    return rows.orderBy(F.desc_nulls_first("started_at"), "id").limit(limit).select("id", F.col("summary").alias("title"), F.col("project_name").alias("project"), "model", "started_at", F.col("message_count").alias("messages"))


def options(**columns: tuple[DataFrame, str]) -> DataFrame:
    """The distinct values of some columns, as lists to choose from: `list` and `value`."""
    return functools.reduce(DataFrame.unionByName, [df.filter(F.col(c).isNotNull()).select(F.lit(name).alias("list"), F.col(c).alias("value")).distinct() for name, (df, c) in columns.items()])


def by_id(df: DataFrame, row_id: int) -> DataFrame:
    """All columns of one row, but vectors."""
    return df.filter(F.col("id") == row_id).drop(*(c for c in df.columns if c.startswith("embedding")))


def conversation_chunks(chunks: DataFrame, conversation: int) -> DataFrame:
    """The chunks that were read out of a conversation."""
    return chunks.filter((F.col("source_type") == "conversation") & (F.col("source_id") == conversation)).orderBy(F.desc_nulls_first("confidence"), "id").select("id", "category", "content", "confidence")


def chunks_with_projects(chunks: DataFrame, projects: DataFrame, as_of: Column, decayed: Column) -> DataFrame:
    """Active chunks that have not expired, their confidence by age, and the project of their name where there is one."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > as_of) if "expires_at" in chunks.columns else F.lit(True)
    named = projects.select(F.col("name").alias("project_name"), F.col("status").alias("project_status"))
    return chunks.filter(active() & alive).join(named, "project_name", "left").select("id", "project_name", "project_status", F.round(F.col("confidence").cast("double") * decayed, 6).alias("weight"))


def skill_usage(messages: DataFrame, skills: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """Uses of each skill by week: answers in the last weeks whose tool has the skill's name."""
    recent_answers = messages.filter((F.col("role") == "assistant") & (F.col("created_at") > before(as_of, 7 * weeks)))
    used = recent_answers.join(skills.select(F.col("name").alias("tool_name")), "tool_name")
    return used.groupBy(F.col("tool_name").alias("name"), F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(F.count("*").alias("uses"))


def skill_calls(messages: DataFrame, skills: DataFrame, tool: str = "Skill") -> DataFrame:
    """Uses of each skill by week: messages of one tool whose blocks (a JSON array) name the skill, once a message."""
    blocks = F.from_json("content_blocks", "array<struct<skill:string>>")
    named = messages.filter(F.col("tool_name") == tool).select("created_at", F.explode(F.array_distinct(F.transform(blocks, lambda b: b["skill"]))).alias("name"))
    return named.join(skills.select("name"), "name").groupBy("name", F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(F.count("*").alias("uses"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def top_skills(skills: DataFrame, limit: int = 10) -> DataFrame:
    return skills.orderBy(F.desc_nulls_first("use_count"), "name", "id").limit(limit).select("id", "name", "use_count")


def skill_list(skills: DataFrame, limit: int = 500) -> DataFrame:
    """Skills by their last sign of life; its kind says where that comes from."""
    kind = F.when(F.col("last_used").isNotNull(), "used").when(F.col("file_modified").isNotNull(), "file").otherwise("scanned")
    return skills.withColumn("sort_date", F.coalesce("file_modified", "last_used", "created_at")).orderBy(F.desc_nulls_last("sort_date"), F.desc_nulls_last("use_count"), "name", "id").limit(limit).select("id", "name", kind.alias("kind"), "sort_date")


def keywords(column: str, text: str, every: bool) -> Column:
    """Names that hold every, or one, of the words in a text parted by commas and spaces."""
    words = list(dict.fromkeys(w for w in text.replace(",", " ").split() if w))
    if not words:
        return F.lit(True)
    return functools.reduce(operator.and_ if every else operator.or_, [like(column, w) for w in words])


#: Orders of the list of prompts.
PROMPT_ORDERS = {
    "name": lambda: [F.asc("name")], "newest": lambda: [F.desc_nulls_last("updated_at")], "oldest": lambda: [F.asc_nulls_last("updated_at")],
    "most_used": lambda: [F.desc_nulls_last("usage_count")], "category": lambda: [F.asc_nulls_last("category"), F.asc("name")],
}


def prompt_list(prompts: DataFrame, category: str | None = None, text: str | None = None, order: str = "newest", limit: int = 500) -> DataFrame:
    wanted = all_of(F.col("category") == category if category else None, like("name", text) | like("content", text) if text else None)
    return prompts.filter(wanted).orderBy(*PROMPT_ORDERS[order](), "id").limit(limit).select("id", "name", "category", "usage_count")


def project_list(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc_nulls_last("updated_at"), "name").select("id", "name", "status")


def contacts(projects: DataFrame, name: str) -> DataFrame:
    """People of the projects whose contacts hold the name."""
    people = projects.select("name", F.explode(F.from_json("contacts", "array<struct<name:string,role:string>>")).alias("p"))
    return people.select(F.col("name").alias("project"), F.col("p.name").alias("person"), F.col("p.role").alias("role")).filter(like("person", name))


def contact_notes(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks on contacts whose text holds a name, the surest first."""
    return chunks.filter((F.col("category") == "contact") & like("content", name)).orderBy(F.desc_nulls_first("confidence"), "id").select("id", "content", "confidence", "project_name", F.array_join("tags", ", ").alias("tags"))


def project_decisions(projects: DataFrame) -> DataFrame:
    """Decisions that the projects' JSON lists, one row each."""
    rows = projects.select(F.col("name").alias("project"), F.explode(F.from_json("decisions", "array<struct<title:string,date:string>>")).alias("d"))
    return rows.select("project", F.col("d.title").alias("title"), F.to_date("d.date").alias("day"))


def since(preset: str, as_of: Column) -> Column | None:
    """Where a period begins: the month, 30 or 90 days, or everything."""
    return {"month": lambda: F.date_trunc("month", as_of), "30d": lambda: before(as_of, 30), "90d": lambda: before(as_of, 90), "all": lambda: None}[preset]()


def conversation_detail(messages: DataFrame, conversation: int, newest_first: bool = False) -> DataFrame:
    """The redacted turns of one conversation."""
    order = (F.desc if newest_first else F.asc)
    return messages.filter(F.col("conversation_id") == conversation).orderBy(order("created_at"), order("id")).select("id", "role", tx.redact("content").alias("content"))


# --- queues of work ------------------------------------------------------------------------------------------


def pending_extraction(conversations: DataFrame, chunks: DataFrame, least: int = 5, limit: int = 20) -> DataFrame:
    done = chunks.filter("source_type = 'conversation'").select(F.col("source_id").alias("id"))
    return conversations.filter(F.col("message_count") >= least).join(done, "id", "left_anti").orderBy(F.desc_nulls_first("started_at"), "id").limit(limit).select("id", "message_count")


def pending_entities(conversations: DataFrame, mentions: DataFrame, least: int = 3, limit: int = 100) -> DataFrame:
    done = mentions.filter("source_type = 'conversation'").select(F.col("source_id").alias("id"))
    return conversations.filter(F.col("message_count") >= least).join(done, "id", "left_anti").orderBy(F.desc_nulls_first("started_at"), "id").limit(limit).select("id", "message_count")


def missing_titles(conversations: DataFrame, least: int = 2, limit: int = 50) -> DataFrame:
    return conversations.filter(all_of(F.col("summary").isNull() | (F.col("summary") == ""), F.col("message_count") >= least)).orderBy(F.desc_nulls_first("started_at"), "id").limit(limit).select("id", "message_count")


def pending_embeddings(chunks: DataFrame, messages: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks, and long messages of users and assistants, that have no vector of the model."""
    have = embeddings.filter(all_of(F.col("model") == model, F.col("embedding").isNotNull())).select("source_type", "source_id")
    wanted = chunks.select(F.lit("memory_chunk").alias("source_type"), F.col("id").alias("source_id")).unionByName(
        messages.filter(F.col("role").isin("user", "assistant") & (F.length("content") >= 100)).select(F.lit("message").alias("source_type"), F.col("id").alias("source_id"))
    )
    return wanted.join(have, ["source_type", "source_id"], "left_anti")


# --- texts ---------------------------------------------------------------------------------------------------


def transcripts(messages: DataFrame, most: int = 1000, whole: int = 80_000, least: int = 200) -> DataFrame:
    """The turns of users and assistants of each conversation as one text, its end if it is too long."""
    turn = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), tx.shortened("content", most), F.lit("\n"))
    rows = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    # only turns that reach into the kept end are collected, however long the conversation
    later = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conversation_id", "created_at", "id", turn.alias("turn")).withColumn("after", F.coalesce(F.sum(F.length("turn") + 1).over(later), F.lit(0))).filter(F.col("after") < whole)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "turn"))), lambda x: x["turn"]), "\n")
    return rows.groupBy("conversation_id").agg(tx.tail(text, whole).alias("transcript")).filter(F.length("transcript") >= least)


def previews(messages: DataFrame, each: int = 500, most: int = 4000, first: int = 30, least: int = 100) -> DataFrame:
    """A short text of each conversation's first messages: until more than `most` characters are in."""
    order = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    rows = messages.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= first).filter((F.col("role") != "tool_result") & (F.coalesce("content", F.lit("")) != "")).withColumn("cut", F.substring("content", 1, each))
    shown = rows.withColumn("so_far", F.coalesce(F.sum(F.length("cut")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("so_far") <= most)
    line = F.concat(F.lit("["), "role", F.lit("] "), "cut")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n")
    return shown.groupBy("conversation_id").agg(F.substring(text, 1, most).alias("preview")).filter(F.length("preview") >= least)


def context_preload(chunks: DataFrame, project: str, limit: int = 20) -> DataFrame:
    """What a session starts with, of the categories that are preloaded: the project's own chunks first, then all others."""
    wanted = chunks.filter(F.col("category").isin(*PRELOADED))
    own = wanted.filter(like("project_name", project)).withColumn("priority", F.lit(1))
    others = wanted.filter(F.col("project_name").isNull() | ~like("project_name", project)).withColumn("priority", F.lit(2))
    return own.unionByName(others).orderBy("priority", F.desc_nulls_last("confidence"), F.desc_nulls_first("created_at"), "id").limit(limit).select("id", "priority", "category", "confidence")


def preload_contacts(chunks: DataFrame, project: str, limit: int = 10) -> DataFrame:
    """The contacts of a project and those of none, the surest and newest first."""
    wanted = (F.col("category") == "contact") & (like("project_name", project) | F.col("project_name").isNull())
    return chunks.filter(wanted).orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_first("created_at"), "id").limit(limit).select("id", "category", "confidence")


def preload_audit(chosen: DataFrame, contacts_: DataFrame, project: str, as_of: Column) -> DataFrame:
    """The audit row of what a session was started with: at most some tens of ids."""
    ids = chosen.select(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("k"), "id").unionByName(contacts_.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("k"), "id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "id"))), lambda x: x["id"])
    row = ids.agg(listed.alias("affected_chunks"), F.count_if(F.col("part") == 0).alias("n"), F.count_if(F.col("part") == 1).alias("m"))
    reason = F.concat(F.lit(f"SessionStart preload for project={project!r} ("), F.col("n").cast("string"), F.lit(" chunks + "), F.col("m").cast("string"), F.lit(" contacts)"))
    return row.filter("n + m > 0").select(F.lit("preload").alias("reflection_type"), "affected_chunks", F.lit("session_start").alias("action_taken"), reason.alias("reasoning"), F.lit(1.0).cast("decimal(3,2)").alias("confidence"), as_of.alias("created_at"))


def preload_summary(reflections: DataFrame) -> DataFrame:
    """The audit row of the latest preload; no row if there was none."""
    last = reflections.filter("reflection_type = 'preload'").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(1)
    return last.select("id", "reflection_type", "affected_chunks", "action_taken", "reasoning", "confidence", "created_at")


def eval_recall(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of questions of whose expected substrings one stands in an answer, in any case.

    `questions` has `id` and `expected` (array); `hits` has `id` and `answer`.
    """
    found = questions.join(hits, "id", "left").withColumn("hit", F.exists("expected", lambda x: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(x))))
    return found.groupBy("id").agg(F.max(F.col("hit").cast("int")).alias("hit")).agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 4).alias("recall"))


def recall_delta(with_memory: DataFrame, without: DataFrame) -> DataFrame:
    """Two results of `eval_recall` side by side, and what the memory adds."""
    a = with_memory.select("questions", F.col("hits").alias("hits_with"), F.col("recall").alias("recall_with"))
    b = without.select(F.col("hits").alias("hits_without"), F.col("recall").alias("recall_without"))
    return a.crossJoin(b).withColumn("delta", F.round(F.col("recall_with") - F.col("recall_without"), 4))  # one row each
