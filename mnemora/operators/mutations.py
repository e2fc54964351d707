"""Changes of the memory tables as functions from tables to tables; `store` commits what they return."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..schemas import CATEGORIES


def validated(rows: DataFrame) -> DataFrame:
    """New chunks with a known category and text, their confidence within 0 and 1."""
    return rows.filter(F.col("category").isin(*CATEGORIES) & (F.trim("content") != "")).withColumn("confidence", F.least(F.greatest("confidence", F.lit(0)), F.lit(1)).cast("decimal(3,2)"))


def supersede(chunks: DataFrame, old: Sequence[int], new: int, at: Column | None = None) -> DataFrame:
    """Chunks with the old ones marked as superseded by the new one."""
    hit = F.col("id").isin(*old)
    out = chunks.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(hit, new).otherwise(F.col("superseded_by")))
    return out.withColumn("superseded_at", F.when(hit, at).otherwise(F.col("superseded_at"))) if at is not None and "superseded_at" in chunks.columns else out


def forget_chunks(chunks: DataFrame, embeddings: DataFrame, ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chunks; references to them become null, while the status of what refers stays."""
    gone = F.col("id").isin(*ids)
    left = chunks.filter(~gone).withColumn("superseded_by", F.when(~F.col("superseded_by").isin(*ids), F.col("superseded_by")))
    return left, embeddings.filter(~((F.col("source_type") == "memory_chunk") & F.col("source_id").isin(*ids)))


def forget_entity(entities: DataFrame, relationships: DataFrame, mentions: DataFrame, entity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without an entity, its relations and its mentions."""
    return entities.filter(F.col("id") != entity), relationships.filter((F.col("from_entity") != entity) & (F.col("to_entity") != entity)), mentions.filter(F.col("entity_id") != entity)


def forget_conversation(conversations: DataFrame, messages: DataFrame, conversation: int) -> tuple[DataFrame, DataFrame]:
    return conversations.filter(F.col("id") != conversation), messages.filter(F.col("conversation_id") != conversation)


def touch(chunks: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Chunks with one more access for those in `ids`."""
    seen = chunks.join(ids.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    return seen.withColumn("access_count", F.col("access_count") + F.when(F.col("seen"), 1).otherwise(0)).withColumn("last_accessed", F.when(F.col("seen"), at).otherwise(F.col("last_accessed"))).drop("seen")


def not_yet(rows: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet; nulls in a key never match."""
    return rows.join(have.select(*key), key, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """One row a key: the newest of the new rows, else the existing one."""
    order = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in newest))
    latest = rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")
    return existing.join(latest.select(*key), key, "left_anti").unionByName(latest)


def edit(rows: DataFrame, row_id: int, **values) -> DataFrame:
    """Rows with new values in some columns of one of them."""
    return rows.withColumns({c: F.when(F.col("id") == row_id, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete(rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    return rows.filter(~F.col("id").isin(*ids))


def set_titles(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """Conversations with cleaned titles as summaries where `titles` (id, title) has one."""
    new = titles.select("id", clean_title("title").alias("new_title")).filter("new_title != ''")
    return conversations.join(new, "id", "left").withColumn("summary", F.coalesce("new_title", "summary")).drop("new_title")


def log_reflection(kind: str, action: str, reasoning: Column, affected: Column, confidence: Column, at: Column, source: DataFrame) -> DataFrame:
    """Audit rows for the rows of `source`; reasons are cut at 4,000 characters."""
    return source.select(F.lit(kind).alias("reflection_type"), affected.cast("array<long>").alias("affected_chunks"), F.lit(action).alias("action_taken"), F.substring(reasoning, 1, 4000).alias("reasoning"), confidence.cast("decimal(3,2)").alias("confidence"), at.alias("created_at"))


def parse_ids(text: str) -> list[int]:
    """Whole numbers in a list parted by commas or white space; anything else is left out."""
    return [int(x) for x in re.split(r"[,\s]+", text.strip()) if re.fullmatch(r"\d+", x)]
