"""Paths from both ends against a plain search and the search of a single pair."""

import random

from pyspark.sql import functions as F

from mnemora.operators import graph
from mnemora.operators import paths as ps


def plain(edges, start, end, deepest):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    level, seen = {start: [start]}, {start}
    for _ in range(deepest + 1):
        if end in level:
            return level[end]
        new = {}
        for v, p in level.items():
            for w in near.get(v, ()):
                if w not in seen and (w not in new or [*p, w] < new[w]):
                    new[w] = [*p, w]
        seen |= set(new)
        level = new
    return None


def test_like_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(ps, "HUB", 8)
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(100, k) for k in range(0, 60, 2)]  # a hub of several rows
    edges += [(200 + k, 201 + k) for k in range(9)] + [(5, 5), (None, 1), (1, None), edges[0]]
    df = spark.createDataFrame(edges, "from_entity long, to_entity long").repartition(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)] + [(200, 206), (200, 207), (209, 203), (1, 200), (7, 7), (999, 999), (None, 1), (3, None), (999, 1)]
    pairs.append(pairs[0])
    adjacency = ps.Adjacency.build(df)
    assert adjacency.spark.read.parquet(adjacency.root).groupBy("node").count().agg(F.max("count")).first()[0] > 1
    got = ps.shortest_paths(spark.createDataFrame(pairs, "start long, end long"), adjacency).collect()
    want = {(a, b): p for a, b in pairs if a is not None and b is not None and (p := plain(edges, a, b, 6)) is not None}
    assert {(r.start, r.end): list(r.path) for r in got} == want and len(got) == len(want) and all(r.nodes == len(r.path) for r in got)
    assert (200, 206) in want and (200, 207) not in want and (7, 7) in want
    (one,) = graph.path(df, 200, 206).collect()
    assert list(one.path) == want[200, 206]


def test_small_frontiers_read_few_partitions(spark):
    edges = spark.range(5000).select(F.col("id").alias("from_entity"), (F.col("id") + 1).alias("to_entity"))
    adjacency = ps.Adjacency.build(edges)
    plan = adjacency.of(spark.createDataFrame([(17,)], "node long"))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "node" in plan.split("PushedFilters: [")[1].split("]")[0]
    empty = ps.Adjacency.build(edges.limit(0))
    assert ps.shortest_paths(spark.createDataFrame([(1, 2), (3, 3)], "start long, end long"), empty).collect() == ps.shortest_paths(spark.createDataFrame([(3, 3)], "start long, end long"), empty).collect()
