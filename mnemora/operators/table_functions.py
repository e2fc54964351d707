"""Searches as table functions that SQL can join laterally.

The functions are SQL text over views of the memory's tables, so a statement with them is one plan of joins and windows.
A lateral join scores each row of the left side against all vectors, pair by pair and without a compiled loop: some hundred
queries over ten thousand vectors take minutes. For more `knn_join.search_memory_many` finds the same by matrix products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def register_search_memory(spark: SparkSession, embeddings: DataFrame, chunks: DataFrame, name: str = "search_memory") -> None:
    """Make `name(query, least, most, source_type, project)` a table function of this session.

    It returns the vectors of at least a similarity, closest first, with their chunk where they have one, as
    `retrieval.search_memory`: `place`, `source_type`, `source_id`, `project_name`, `category`, `similarity`. A null
    source type or project asks for all. A query that is null, zero or of another length finds nothing.
    """
    own = chunks.select(F.col("id").alias("source_id"), "project_name", "category").withColumn("source_type", F.lit("memory_chunk"))
    known = embeddings.select("id", "source_type", "source_id", "embedding").join(own, ["source_type", "source_id"], "left")
    size = F.expr(f"sqrt({_DOT.format(a='embedding', b='embedding')})")
    known.withColumn("norm", size).filter("norm > 0").createOrReplaceTempView(f"{name}_vectors")
    query = f"transform({name}.query, x -> round(CAST(x AS DOUBLE), 7))"  # like its stored form
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, least DOUBLE, most INT, source_type STRING, project STRING)
        RETURNS TABLE(place INT, source_type STRING, source_id BIGINT, project_name STRING, category STRING, similarity DOUBLE)
        RETURN SELECT place, source_type, source_id, project_name, category, similarity FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
                SELECT id, v.source_type, v.source_id, v.project_name, v.category,
                    round({_DOT.format(a="v.embedding", b=query)} / nullif(v.norm * sqrt({_DOT.format(a=query, b=query)}), 0D), 12) AS similarity
                FROM {name}_vectors v
                WHERE size(v.embedding) = size({name}.query) AND ({name}.source_type IS NULL OR v.source_type = {name}.source_type) AND ({name}.project IS NULL OR v.project_name = {name}.project)
            ) WHERE similarity > {name}.least
        ) WHERE place <= {name}.most""")
