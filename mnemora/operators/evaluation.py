"""Evaluation of the memory: all questions of a table are answered with and without what is retrieved for them, and graded.

One job retrieves for all questions (`knn_join`). A model is called twice a question, batch by batch in the tasks, and its
answers are written before they are graded, so that reading the result asks nothing again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .embedding import Embedder
from .extract import Model
from .knn_join import nearest_many
from .retrieval import sources_of

#: Characters of a retrieved text that a prompt shows, and what it says where nothing was found (fixed values).
SHOWN, NOTHING = 400, "(no memory chunks retrieved)"


def embed_questions(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """`q`, `embedding`, `project` of `questions` (id, question, scope_project)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q": b["id"], "embedding": embedder(b["question"].fillna("").tolist()), "project": b["scope_project"]})

    return questions.select("id", "question", "scope_project").mapInPandas(run, f"q {questions.schema['id'].dataType.simpleString()}, embedding array<double>, project string")


def contexts(near: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """By question `q` the retrieved ids and the lines of a prompt, the closest first; ids without a text stay with an empty one."""
    texts = chunks.select(F.lit("memory_chunk").alias("source_type"), F.col("id").alias("source_id"), "content").unionByName(messages.select(F.lit("message").alias("source_type"), F.col("id").alias("source_id"), "content"))
    flat = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "\n", " "))
    short = F.when(F.length(flat) > SHOWN, F.concat(F.substring(flat, 1, SHOWN), F.lit("…"))).otherwise(flat)
    line = F.concat(F.lit("- ["), F.coalesce("category", F.lit("?")), F.lit(" · "), F.coalesce("project_name", F.lit("—")), F.lit("] "), short)
    rows = near.join(texts, ["source_type", "source_id"], "left").select("q", "place", "source_id", line.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("place", "source_id", "line")))
    return rows.groupBy("q").agg(listed.alias("found")).select("q", F.transform("found", lambda x: x["source_id"]).alias("retrieved"), F.array_join(F.transform("found", lambda x: x["line"]), "\n").alias("context"))


def answers(prompts: DataFrame, model: Model) -> DataFrame:
    """`prompts` (id, prompt, cold_prompt) with the model's `answer` and `cold_answer`, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "answer": model(b["prompt"].tolist()), "cold_answer": model(b["cold_prompt"].tolist())})

    return written(prompts.select("id", "prompt", "cold_prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, answer string, cold_answer string"))


def graded(answer: str, expected: str) -> Column:
    """The first expected substring that an answer holds in any case; null if it holds none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.try_element_at(F.filter(expected, lambda x: F.contains(low, F.lower(x))), F.lit(1))


def evaluate(questions: DataFrame, embedded: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame, DataFrame], model: Model, limit: int = 6) -> DataFrame:
    """One row a question: its retrieved ids, both answers, and the expected substring that each holds.

    `questions` has id, category, question, expected_substrings; `embedded` is their `embed_questions`; `tables` are
    embeddings, chunks, messages, conversations. Repeated ids are asked once.
    """
    _, chunks, messages, _ = tables
    asked = questions.dropDuplicates(["id"])
    near = written(nearest_many(embedded, sources_of(*tables), limit))
    found = contexts(near, chunks, messages).withColumnRenamed("q", "id")
    prompts = asked.join(found, "id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<long>"))).withColumn("context", F.coalesce("context", F.lit(NOTHING)))
    question = F.coalesce("question", F.lit(""))
    prompts = prompts.withColumn("prompt", F.concat(F.lit(f"Known from earlier sessions (the {limit} closest memories):\n"), F.col("context"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer in one to three sentences.")))
    prompts = written(prompts.withColumn("cold_prompt", F.concat(F.lit("Question: "), question, F.lit("\nAnswer in one to three sentences. Say so if you do not know."))))
    out = prompts.drop("prompt", "cold_prompt").join(answers(prompts, model), "id")
    return out.withColumn("match", graded("answer", "expected_substrings")).withColumn("cold_match", graded("cold_answer", "expected_substrings"))


def recall(results: DataFrame) -> DataFrame:
    """Hits with and without memory, and the difference, over all questions."""
    hits = results.select(F.col("match").isNotNull().cast("long").alias("a"), F.col("cold_match").isNotNull().cast("long").alias("b"))
    return hits.agg(F.count("*").alias("questions"), F.coalesce(F.sum("a"), F.lit(0)).alias("hits_with"), F.coalesce(F.sum("b"), F.lit(0)).alias("hits_cold"), F.coalesce(F.sum(F.col("a") - F.col("b")), F.lit(0)).alias("delta"))
