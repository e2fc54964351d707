"""What a language model reads out of transcripts: calls go through a pluggable model, answers are parsed by expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import CATEGORIES, ENTITY_TYPES, RELATION_TYPES

Model = Callable[[Sequence[str]], list[str]]
CHUNKS = "array<struct<content:string,category:string,tags:array<string>,confidence:double,project:string>>"
GRAPH = "struct<entities:array<struct<type:string,name:string,attributes:map<string,string>>>,relationships:array<struct<`from`:string,`to`:string,type:string,confidence:double>>>"


def ask(prompts: DataFrame, model: Model) -> DataFrame:
    """`conversation_id` and the model's `answer` for each `transcript`, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conversation_id": b["conversation_id"], "answer": model(b["transcript"].tolist())})

    return prompts.select("conversation_id", "transcript").mapInPandas(run, "conversation_id long, answer string")


def parse_chunks(answers: DataFrame) -> DataFrame:
    """Valid chunks of the answers: text and a known category; confidence within 0 and 1, 0.8 if absent."""
    rows = answers.select("conversation_id", F.explode(F.from_json(tx.json_of("answer"), CHUNKS)).alias("c"))
    rows = rows.filter((tx.strip("c.content") != "") & F.col("c.category").isin(*CATEGORIES))
    return rows.select(F.lit("conversation").alias("source_type"), F.col("conversation_id").alias("source_id"), F.col("c.content").alias("content"), F.col("c.category").alias("category"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), F.least(F.greatest(F.coalesce("c.confidence", F.lit(0.8)), F.lit(0.0)), F.lit(1.0)).cast("decimal(3,2)").alias("confidence"), F.col("c.project").alias("project_name"))


def parse_graph(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of the answers, of known types and with names, the names in canonical form."""
    rows = answers.select("conversation_id", F.from_json(tx.json_of("answer", "{", "}"), GRAPH).alias("g"))
    entities = rows.select("conversation_id", F.explode("g.entities").alias("e")).filter(F.col("e.type").isin(*ENTITY_TYPES) & (tx.strip("e.name") != ""))
    relations = rows.select("conversation_id", F.explode("g.relationships").alias("r")).filter(F.col("r.type").isin(*RELATION_TYPES))
    return (
        entities.select("conversation_id", F.col("e.type").alias("entity_type"), F.col("e.name").alias("name"), tx.canonical("e.name").alias("canonical_name"), F.col("e.attributes").alias("attributes")),
        relations.select("conversation_id", tx.canonical("r.from").alias("from_name"), tx.canonical("r.to").alias("to_name"), F.col("r.type").alias("relation_type"), F.coalesce("r.confidence", F.lit(0.8)).alias("confidence")),
    )


def with_ids(relations: DataFrame, found: DataFrame, known: DataFrame, project: str) -> DataFrame:
    """Relations with the ids of their ends: of the same conversation's entities, else the best known; others drop out.

    `found` has conversation_id, canonical_name, id; `known` has canonical_name, id, project_name, mention_count.
    """
    order = Window.partitionBy("canonical_name").orderBy(F.desc_nulls_last(F.col("project_name") == project), F.desc_nulls_first("mention_count"), "id")
    best = known.withColumn("k", F.row_number().over(order)).filter("k = 1")
    out = relations
    for end in ("from", "to"):
        own = found.groupBy("conversation_id", F.col("canonical_name").alias(f"{end}_name")).agg(F.min("id").alias("own"))
        any_ = best.select(F.col("canonical_name").alias(f"{end}_name"), F.col("id").alias("any"))
        out = out.join(own, ["conversation_id", f"{end}_name"], "left").join(any_, f"{end}_name", "left").withColumn(f"{end}_entity", F.coalesce("own", "any")).drop("own", "any")
    return out.filter("from_entity IS NOT NULL AND to_entity IS NOT NULL AND from_entity != to_entity")
