"""Search by cosine distance and by trigrams. Scores are exact; the query vector is the only literal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity
from ..shared import written


def distances(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """`vectors` without `embedding`, with its cosine `distance` from the query, scored batch by batch.

    A vector that is null, zero, or of another length has no distance. Distances are rounded to twelve places, so that
    equal vectors are equally far whatever their place in a batch.
    """
    q = np.round(np.asarray(query, np.float64), 7)  # like its stored form
    size = float(np.sqrt(q @ q))
    rest = [f for f in vectors.schema.fields if f.name != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            out = np.full(len(batch), np.nan)
            whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), len(q)), False))
            if whole.any():
                kept = lists.filter(pa.array(whole))
                m = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
                norms = np.sqrt(np.einsum("ij,ij->i", m, m)) * size
                out[whole] = 1 - np.einsum("ij,j->i", m, q) / np.where(norms == 0, np.nan, norms)
            far = pa.array(np.round(out, 12), mask=np.isnan(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], far], names=[*(f.name for f in rest), "distance"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "distance double"])
    return vectors.select(*(f"`{f.name}`" for f in rest), "embedding").mapInArrow(run, ddl)


def with_sources(far: DataFrame, chunks: DataFrame, messages: DataFrame, conversations: DataFrame, project: str | None = None, value: str = "distance") -> DataFrame:
    """Distances, or what `value` names, with the project and category of what they belong to; the project filter stands in both branches."""
    memory = far.filter("source_type = 'memory_chunk'").join(chunks.select(F.col("id").alias("source_id"), "project_name", "category"), "source_id")
    owner = messages.select(F.col("id").alias("source_id"), "conversation_id").join(conversations.select(F.col("id").alias("conversation_id"), "project_name"), "conversation_id").drop("conversation_id")
    said = far.filter("source_type = 'message'").join(owner, "source_id").withColumn("category", F.lit(None).cast("string"))
    if project:
        memory, said = (d.filter(F.col("project_name") == project) for d in (memory, said))
    columns = ["source_type", "source_id", "project_name", "category", value]
    return memory.select(columns).unionByName(said.select(columns))


def sources_of(embeddings: DataFrame, chunks: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Vectors with the project and category of what they belong to, for many questions (`knn_join.nearest_many`)."""
    return with_sources(embeddings.select("source_type", "source_id", "embedding"), chunks, messages, conversations, value="embedding")


def nearest(embeddings: DataFrame, chunks: DataFrame, messages: DataFrame, conversations: DataFrame, query: Sequence[float], limit: int = 10, scope: str | None = None, project: str | None = None, least: float | None = None, index=None, model: str | None = None) -> DataFrame:
    """The closest sources: a scope filters after the limit, a project and a least similarity before it.

    With an `index` (`vector_index.VectorIndex`) only the cells near the query are read, of vectors of one `model`; more
    of them where too few rows have a source, so the limit is reached as long as there are rows.

    Vectors are scored where they lie; only distances are joined. Without a project a few times the limit of the
    closest are joined first, and all only if more there are and too few of these have a source. What is found is
    written once, so that no vector is scored again when the result is read.
    """
    order = [F.asc_nulls_last("distance"), "source_type", "source_id"]
    if index is not None:
        own = {"model": model} if model else {}
        most = 4 * limit + 16
        far = index.search(query, most, **own) if not project else None
        found = None if far is None else written(with_sources(F.broadcast(far), chunks, messages, conversations).orderBy(*order).limit(limit))
        if found is None or found.count() < limit:
            keys = ["source_type", "source_id"]
            there = with_sources(embeddings.select(*keys, F.lit(0.0).alias("distance")), chunks, messages, conversations, project).select(*keys)
            far = index.search(query, limit, where=lambda rows: rows.join(there, keys, "left_semi"), **own)
            found = with_sources(F.broadcast(far), chunks, messages, conversations, project).orderBy(*order).limit(limit)
        found = found if least is None else found.filter(1 - F.col("distance") > least)
        return found.filter(F.col("source_type") == scope) if scope else found
    far = distances(embeddings.select("source_type", "source_id", "embedding"), query)
    if least is not None:
        far = far.filter(1 - F.col("distance") > least)
    found = None
    if not project:
        most = 4 * limit + 16
        first = written(far.orderBy(*order).limit(most))
        found = written(with_sources(F.broadcast(first), chunks, messages, conversations).orderBy(*order).limit(limit))
        if found.count() < limit and first.count() == most:
            found = None
    if found is None:
        found = with_sources(far, chunks, messages, conversations, project).orderBy(*order).limit(limit)
    return found.filter(F.col("source_type") == scope) if scope else found


def search_memory(embeddings: DataFrame, chunks: DataFrame, query: Sequence[float], least: float = 0.70, limit: int = 10, source_type: str | None = None, project: str | None = None) -> DataFrame:
    """Vectors of at least a similarity, of one source type or all, with their chunk where they have one; by project or all."""
    vectors = embeddings.filter(F.col("source_type") == source_type) if source_type else embeddings
    far = distances(vectors.select("id", "source_type", "source_id", "embedding"), query).filter(1 - F.col("distance") > least)
    own = chunks.select(F.col("id").alias("source_id"), "project_name", "category").withColumn("source_type", F.lit("memory_chunk"))
    found = far.join(own, ["source_type", "source_id"], "left")
    if project:
        found = found.filter(F.col("project_name") == project)
    return found.withColumn("similarity", 1 - F.col("distance")).orderBy("distance", "id").limit(limit)


def similar_conversations(embeddings: DataFrame, conversations: DataFrame, query: Sequence[float], least: float = 0.75, limit: int = 10) -> DataFrame:
    """Conversations whose own vectors are closer than a similarity."""
    far = distances(embeddings.filter("source_type = 'conversation'").select("id", "source_id", "embedding"), query).filter(1 - F.col("distance") > least)
    own = conversations.select(F.col("id").alias("source_id"), "project_name", "summary", "started_at", "message_count")
    return far.join(own, "source_id").withColumn("similarity", 1 - F.col("distance")).orderBy("distance", "id").limit(limit)


def similar_to(embeddings: DataFrame, source_type: str, source_id: int, limit: int = 8) -> DataFrame:
    """The sources closest to a given one, itself left out."""
    same = (F.col("source_type") == source_type) & (F.col("source_id") == source_id)
    wanted = embeddings.filter(same).orderBy("id").limit(1).select("embedding").first()
    rest = embeddings.filter(~same).select("id", "source_type", "source_id", "embedding")
    if wanted is None or wanted.embedding is None:
        return rest.limit(0).select("id", "source_type", "source_id", F.lit(None).cast("double").alias("distance"))
    found = distances(rest, wanted.embedding)
    return found.orderBy(F.asc_nulls_last("distance"), "id").limit(limit).select("id", "source_type", "source_id", F.round("distance", 6).alias("distance"))


def trigram_search(df: DataFrame, column: str, term: str, key: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    found = df.withColumn("similarity", trigram_similarity(F.col(column), F.lit(term))).filter(F.col("similarity") > least)
    return found.orderBy(F.desc("similarity"), key).limit(limit).select(key, column, F.round("similarity", 6).alias("similarity"))
