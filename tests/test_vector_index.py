"""The vector index: recall against exact neighbours of the stated queries, changes without a rebuild, hot and bad rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.adapters import Memory
from mnemora.operators import retrieval, vector_index
from mnemora.operators.knn_join import knn_join
from mnemora.operators.vector_index import VectorIndex, recall, search_many
from tests.test_queries import FOLDER

KEYS = ("source_type", "source_id")
DDL = "source_type string, source_id long, model string, embedding array<float>"


def keys_of(df):
    return [(r.source_type, r.source_id) for r in df.orderBy("distance", *KEYS).collect()]


def test_recall_of_the_stated_queries(spark, tmp_path):
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    vectors = Memory(spark, FOLDER.replace("sf0.001", "sf0.1")).embeddings.withColumn("source_id", F.col("id"))
    index = VectorIndex(spark, str(tmp_path / "index")).build(vectors)
    queries = vectors.filter("id % 50 = 0").select(F.col("id").alias("q"), "embedding")
    exact = knn_join(queries, vectors.select(*KEYS, "embedding"), 10, KEYS)
    assert exact.count() == 10 * queries.count()
    cells = sum(map(len, index.centres.values()))
    assert cells > 50 and index._rows().count() == vectors.count()
    assert recall(index, queries, exact, model="model-a", probes=cells) == 1.0
    assert index.probes["model-a", 64] < cells and recall(index, queries, exact, model="model-a") >= 0.9
    # one by one like all at once, and equal distances to the exact ones
    (q,) = queries.filter("q = 50").collect()
    one = index.search(q.embedding, 10, "model-a", probes=cells)
    assert keys_of(one) == keys_of(exact.filter("q = 50"))
    many = search_many(index, queries.filter("q = 50"), 10, "model-a", probes=cells)
    assert [round(r.distance, 9) for r in one.orderBy("distance", *KEYS).collect()] == [round(r.distance, 9) for r in many.orderBy("place").collect()]


@pytest.fixture
def small(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [("chunk", i, "a", rnd.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [("hot", i, "a", rows[0][3]) for i in range(120)]
    rows += [("bad", 1, "a", None), ("bad", 2, "a", []), ("bad", 3, "a", [0.0] * 8), ("bad", 4, "a", [float("nan")] * 8), ("chunk", 1, "b", [1.0, 2.0]), ("chunk", 2, None, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, DDL).repartition(3)
    return vectors, VectorIndex(spark, str(tmp_path / "index")).build(vectors)


def exact(vectors, query, limit, model="a"):
    rows = vectors.filter(F.coalesce("model", F.lit("")) == model).select(*KEYS, "embedding")
    return [(r.source_type, r.source_id) for r in retrieval.distances(rows, query).filter("distance IS NOT NULL AND NOT isnan(distance)").orderBy("distance", *KEYS).limit(limit).collect()]


def test_changes_are_seen_without_a_rebuild(spark, small):
    vectors, index = small
    query = vectors.filter("source_type = 'chunk' AND source_id = 7").first().embedding
    before = keys_of(index.search(query, 5, "a", probes=1000))
    assert before == exact(vectors, query, 5) and before[0] == ("chunk", 7)
    new = spark.createDataFrame([("new", 1, "a", [x * 2 for x in query])], DDL)
    index.add(new)
    assert keys_of(index.search(query, 2, "a", probes=1)) == [("chunk", 7), ("new", 1)]
    index.delete(spark.createDataFrame([("chunk", 7), ("new", 1), ("none", 0)], "source_type string, source_id long"))
    assert keys_of(index.search(query, 4, "a", probes=1000)) == before[1:]
    index.add(new)  # a deleted key comes back
    assert keys_of(index.search(query, 1, "a")) == [("new", 1)]
    everything = index._live(index._rows()).select(*KEYS).orderBy(*KEYS).collect()
    index.compact()
    again = VectorIndex(spark, index.root)
    assert again._rows().select(*KEYS).orderBy(*KEYS).collect() == everything and len(again._folders("cells")) > 1
    assert keys_of(again.search(query, 1, "a")) == [("new", 1)]
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([("new", 2, "c", [1.0] * 8)], DDL))


def test_hot_bad_and_filtered(spark, small):
    vectors, index = small
    hot = vectors.filter("source_type = 'hot'").first().embedding
    assert keys_of(index.search(hot, 15, "a", probes=1)) == exact(vectors, hot, 15)
    assert keys_of(index.search([1.0, 2.0], 5, "b")) == [("chunk", 1)] and keys_of(index.search([1.0, 2.0], 5)) == [("chunk", 2)]
    assert index.search([0.0] * 8, 5, "a").count() == index.search([1.0] * 5, 5, "a").count() == 0
    # a filter before the limit: probes grow until enough rows are found
    found = keys_of(index.search(hot, 5, "a", probes=1, where=lambda rows: rows.filter("source_id > 195 AND source_type = 'chunk'")))
    assert len(found) == 4 and {k for _, k in found} == {196, 197, 198, 199}
    assert index._rows().filter("source_type = 'bad'").count() == 0


@pytest.mark.parametrize("query_bytes", [1_000_000, 2_000])
@pytest.mark.parametrize("probes", [1, 3, 1000])
def test_many_queries_like_one_by_one(small, query_bytes, probes):
    """Both ways of meeting, over the cells that a single search reads."""
    vectors, index = small
    queries = vectors.filter("model = 'a' AND source_id % 9 = 0").select((F.col("source_id") + F.when(F.col("source_type") == "hot", 1000).otherwise(0)).alias("q"), "embedding")
    many = search_many(index, queries, 6, "a", probes, query_bytes).collect()
    found: dict = {}
    for r in sorted(many, key=lambda r: r.place):
        found.setdefault(r.q, []).append((r.source_type, r.source_id))
    for q in (0, 9, 27, 1000, 1009):
        query = queries.filter(F.col("q") == q).first().embedding
        near = vector_index._order(index.centres["a", 8], np.array(query) / np.linalg.norm(query))[:probes]
        read = index._rows().filter(F.col("model") == "a").filter(F.col("size") == 8).filter(F.col("cell").isin(near.tolist()))
        assert found[q] == exact(read, query, 6), q


def test_a_query_is_held_once_however_many_cells_it_reads(spark):
    """Searching 2,000 queries in 4,000 cells held 2,000 * 4,000 vectors; now a task holds a bounded number of pairs."""
    rnd = np.random.default_rng(4)
    centres, queries = (rnd.normal(size=(n, 16)) for n in (4000, 2000))
    tracemalloc.start()
    reach = vector_index._reach(centres, queries, 1500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
    assert ((vector_index._far(centres, queries[:50]) <= reach[:50, None]).sum(axis=1) == 1500).all()
    assert (vector_index._reach(centres, queries, 4000) == np.inf).all()


def test_search_of_sources_by_the_index(spark, tmp_path):
    """The same sources as without the index, scopes and projects too."""
    m = Memory(spark, FOLDER)
    index = VectorIndex(spark, str(tmp_path / "index")).build(m.embeddings)
    index.centres, index.probes = index.centres, {k: len(c) for k, c in index.centres.items()}
    query = m.embeddings.filter("id = 10").first().embedding
    tables = (m.embeddings, m.chunks, m.messages, m.conversations)
    shown = lambda df: [(r.source_type, r.source_id, round(r.distance, 9)) for r in df.collect()]
    for wanted in ({}, {"scope": "memory_chunk"}, {"project": "src4"}, {"least": 0.1}):
        assert shown(retrieval.nearest(*tables, query, 10, index=index, model="model-a", **wanted)) == shown(retrieval.nearest(*tables, query, 10, **wanted)), wanted


def test_only_probed_cells_are_read(small):
    vectors, index = small
    rows = index._rows().filter("model = 'a' AND size = 8 AND cell IN (1, 2)")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:300]


def test_empty(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame([], DDL))
    assert index.search([1.0, 2.0], 5).count() == 0
    with pytest.raises(LookupError):
        VectorIndex(spark, str(tmp_path / "none")).search([1.0], 1)
