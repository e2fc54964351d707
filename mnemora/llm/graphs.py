"""Connected components of a link table, by contraction: every node hooks to its smallest neighbour, trees are flattened,
and the links between the trees are the next round's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise


def _flattened(up: DataFrame) -> DataFrame:
    """`node`, `up` and `links` with `up` the top of each node's tree; each step halves the depth."""
    while True:
        moved = up.filter("node != up")
        below = moved.groupBy("up").agg(F.count("*").alias("w"))
        tops = materialise(moved.select(F.col("node").alias("up"), F.col("up").alias("top")).join(below, "up"))
        if tops.isEmpty():
            return up
        up = materialise(join_hot(up, tops, "up", "w").select("node", F.coalesce("top", "up").alias("up"), "links"))


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node of `links` (long columns `a` and `b`).

    A round leaves at most half of the nodes that have links, and a tree of depth d is flat after log2 d steps, so
    long chains take few rounds. A node of very many links is combined map-side, and what it becomes is taken to its
    links as they lie. Every step is written to the shared folder. Self-links keep their node; links may repeat; an
    empty table gives an empty table.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while True:
        up = _flattened(materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"), F.count("*").alias("links"))))
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            met = up.select(F.col("node").alias("root"), F.col("up").alias("top")).join(labels.groupBy("root").agg(F.count("*").alias("w")), "root")
            labels = materialise(join_hot(labels, materialise(met), "root", "w").select("node", F.coalesce("top", "root").alias("root")))
        for end in ("a", "b"):
            tops = up.select(F.col("node").alias(end), F.col("up").alias("top"), "links")
            edges = join_hot(edges, tops, end, "links").withColumn(end, F.col("top")).drop("top")
        edges = materialise(edges.filter("a != b").distinct())
        if edges.isEmpty():
            return labels
