"""Shortest paths of many pairs at once, grown from both ends over an adjacency table.

The neighbours of each node are laid out once, in Parquet partitions by a hash of the node and sorted by it; a hub's lie in
several rows. Each round grows, for each pair, the side whose frontier is smaller, and reads of the table only the
partitions of the nodes in these frontiers, and with few nodes only their row groups. The sides meet half-way, so a path
of d steps reads frontiers of about d / 2 steps.

Of several shortest paths the smallest as an array is returned. Defined cases: a pair of one node is a path of that node,
whether it has neighbours or not; pairs without a path within `deepest` steps have no row; pairs may repeat, and have one
row then; null ends have none; edges may repeat and may join a node to itself; an empty table has no neighbours.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, written
from .graph import DEEPEST, undirected

#: Partitions of the table, neighbours in one row, and nodes of a frontier that are named in the scan.
BUCKETS, HUB, NAMED = 64, 10_000, 1_000


def _bucket(node: str):
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


class Adjacency:
    """The neighbours of all nodes, below one folder that all nodes of the cluster share."""

    SCHEMA = "node long, near array<long>, bucket int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def build(cls, relationships: DataFrame, root: str | None = None) -> Adjacency:
        """Lay out the undirected neighbours. A hub's are dealt over several tasks before they are listed."""
        root = root or f"{shared_dir(relationships.sparkSession)}/adjacency-{uuid.uuid4().hex}"
        edges = written(undirected(relationships).filter("a IS NOT NULL AND b IS NOT NULL AND a != b"))
        hubs = edges.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("parts")).filter("parts > 1")  # at most one for HUB edges
        dealt = edges.join(hubs, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)))
        rows = dealt.groupBy(F.col("a").alias("node"), "part").agg(F.collect_list("b").alias("near")).select("node", "near", _bucket("node").alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(root)
        return cls(relationships.sparkSession, root)

    def of(self, nodes: DataFrame) -> DataFrame:
        """`node` and `near` of some nodes: only their partitions are read."""
        own = nodes.select("node").distinct()
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.root)
        few = [r.node for r in own.limit(NAMED + 1).collect()]
        buckets = [r.bucket for r in own.select(_bucket("node").alias("bucket")).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(buckets))
        rows = rows.filter(F.col("node").isin(few)) if len(few) <= NAMED else rows.join(own, "node", "left_semi")
        return rows.select("node", "near")


def shortest_paths(pairs: DataFrame, adjacency: Adjacency, deepest: int = DEEPEST) -> DataFrame:
    """`start`, `end`, `nodes` (their number) and `path` of the pairs (`start`, `end`) that are joined within `deepest` steps."""
    asked = pairs.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start IS NOT NULL AND end IS NOT NULL").distinct()
    side = lambda name, node: F.struct(F.lit(name).alias("side"), F.col(node).alias("node"), F.array(node).alias("path"))
    found = written(asked.filter("start = end").select("start", "end", F.array("start").alias("path")))
    frontier = written(asked.filter("start != end").select("start", "end", F.explode(F.array(side("a", "start"), side("b", "end"))).alias("s")).select("start", "end", "s.*"))
    seen = frontier.select("start", "end", "side", "node")
    pair = ["start", "end"]
    for _ in range(deepest):
        sizes = frontier.groupBy(*pair).agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
        chosen = sizes.filter("a > 0 AND b > 0").select(*pair, F.when(F.col("a") <= F.col("b"), "a").otherwise("b").alias("side"))  # a side that is at its end has no path
        marked = written(frontier.join(chosen.withColumnRenamed("side", "turn"), pair).withColumn("grows", F.col("side") == F.col("turn")).drop("turn"))
        grown = marked.filter("grows")
        if grown.isEmpty():
            break
        steps = grown.join(adjacency.of(grown), "node").select(*pair, "side", "path", F.explode("near").alias("node"))
        longer = F.when(F.col("side") == "a", F.concat("path", F.array("node"))).otherwise(F.concat(F.array("node"), "path"))
        new = written(steps.join(seen, [*pair, "side", "node"], "left_anti").select(*pair, "side", "node", longer.alias("path")).groupBy(*pair, "side", "node").agg(F.min("path").alias("path")))
        rest = marked.filter("NOT grows").select(*pair, "side", "node", "path")
        other = rest.select(*pair, "node", F.col("path").alias("other"))
        joined = F.when(F.col("side") == "a", F.concat("path", F.slice("other", F.lit(2), F.size("other")))).otherwise(F.concat("other", F.slice("path", F.lit(2), F.size("path"))))
        met = written(new.join(other, [*pair, "node"]).groupBy(*pair).agg(F.min(joined).alias("path")))
        found = found.unionByName(met)
        frontier = written(new.unionByName(rest).join(met, pair, "left_anti"))
        seen = seen.unionByName(new.select(*pair, "side", "node"))
    return found.select("start", "end", F.size("path").alias("nodes"), "path")
