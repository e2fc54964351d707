"""The join of many queries with their nearest vectors, by both ways, against plain scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import retrieval
from mnemora.operators.knn_join import knn_join, nearest_many, search_memory_many
from mnemora.operators.table_functions import register_search_memory

DDL = "id long, project_name string, embedding array<float>"


def plain(queries, rows, limit):
    out = {}
    for q, vector, project in queries:
        found = []
        for i, p, v in rows:
            if v is None or vector is None or None in v or len(v) != len(vector) or not any(v) or not any(vector) or (project is not None and p != project):
                continue
            a, b = np.round(np.array(vector, float), 7), np.array(v, np.float32).astype(float)
            found.append((round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 12), i))
        for place, (d, i) in enumerate(sorted(found)[:limit], 1):
            out[q, place] = (i, round(d, 9))
    return out


def got(df):
    return {(r.q, r.place): (r.id, round(r.distance, 9)) for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"query_bytes": 1500, "stored_bytes": 4000}])
def test_like_plain_scoring(spark, sizes):
    rnd = np.random.default_rng(1)
    rows = [(i, f"p{i % 3}" if i % 7 else None, rnd.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, "hot", rows[0][2]) for i in range(150)]  # one vector that a third of the rows have
    rows += [(500, "p1", None), (501, "p1", [0.0] * 6), (502, "p1", [1.0, 2.0]), (503, "p0", []), (504, "p0", [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    queries = [(f"q{k}", rnd.normal(size=6).tolist(), [None, "p1", "hot", "nowhere"][k % 4]) for k in range(40)]
    queries += [("same", rows[0][2], None), ("short", [0.5, 0.1], None), ("none", None, None), ("zero", [0.0] * 6, None)]
    out = knn_join(spark.createDataFrame(queries, "q string, embedding array<double>, project string"), spark.createDataFrame(rows, DDL).repartition(5), 7, **sizes)
    assert got(out) == plain(queries, rows, 7)
    assert knn_join(spark.createDataFrame(queries, "q string, embedding array<double>, project string").limit(0), spark.createDataFrame(rows, DDL), 7, **sizes).count() == 0
    assert knn_join(spark.createDataFrame(queries, "q string, embedding array<double>, project string"), spark.createDataFrame([], DDL), 7, **sizes).count() == 0


def test_many_questions_like_one_by_one(spark):
    from mnemora.adapters import Memory
    from tests.test_queries import FOLDER

    m = Memory(spark, FOLDER)
    asked = [(k, r.embedding, [None, "memory_chunk"][k % 2], [None, None, "src4"][k % 3]) for k, r in enumerate(m.embeddings.orderBy("id").limit(6).collect())]
    questions = spark.createDataFrame(asked, "q int, embedding array<float>, scope string, project string")
    many = nearest_many(questions, retrieval.sources_of(m.embeddings, m.chunks, m.messages, m.conversations), 5).select("q", "source_type", "source_id", F.round("distance", 9).alias("d")).collect()
    for q, vector, scope, project in asked:
        one = retrieval.nearest(m.embeddings, m.chunks, m.messages, m.conversations, vector, 5, scope, project).collect()
        assert sorted((r.source_type, r.source_id, r.d) for r in many if r.q == q) == sorted((r.source_type, r.source_id, round(r.distance, 9)) for r in one)


@pytest.mark.parametrize("sizes", [{}, {"query_bytes": 1500, "stored_bytes": 40_000}])
def test_searches_like_the_lateral_join(spark, sizes):
    """The table function of SQL and the join give the same rows, in the query too, which goes by the join."""
    from mnemora.adapters import Memory
    from mnemora.queries import QUERIES
    from tests.test_queries import FOLDER

    m = Memory(spark, FOLDER)
    asked = m.embeddings.filter("id % 10 = 0").select(F.col("id").alias("q"), "embedding", F.when(F.col("id") % 30 == 0, "src4").when(F.col("id") % 70 == 0, "none").alias("project"))
    register_search_memory(spark, m.embeddings, m.chunks)
    asked.createOrReplaceTempView("asked")
    for kind in ("memory_chunk", None):
        lateral = spark.sql(f"SELECT q, place, source_type, source_id, project_name, category, round(similarity, 7) AS s FROM asked, LATERAL search_memory(embedding, 0.05D, 5, {f"'{kind}'" if kind else 'NULL'}, project)")
        many = search_memory_many(asked, m.embeddings, m.chunks, 0.05, 5, kind, **sizes).withColumn("s", F.round("similarity", 7)).select(lateral.columns)
        assert lateral.count() > 50 and sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, lateral.collect()), key=repr)
    # pairs are scored by matrix products in Arrow batches, not one by one in a nested loop
    plan = QUERIES["search_memory_lateral"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan
