"""The knowledge graph: entities, relationships and mentions as DataFrames.

Walks go hop by hop: the frontier joins the edge list, what was visited drops out by an anti-join, and lineage is
cut through the folder that the session's nodes share; only a bounded number of hops is ever made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import canonical as canonical_json
from ..shared import written as cut

MOST_HOPS, DEEPEST = 3, 6


def resolve(entities: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Entities with the canonical name, most mentioned first; only if there are none, those whose name holds it."""
    low = name.strip().lower()
    tiers = entities.withColumn("tier", F.when(F.col("canonical_name") == low, 0).when(F.col("name").ilike(f"%{name}%"), 1)).filter("tier IS NOT NULL")
    best = tiers.agg(F.min("tier").alias("best"))
    return tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).orderBy(F.desc_nulls_first("mention_count"), "id").limit(limit).select("id", "entity_type", "name", "mention_count")


def neighbours(entities: DataFrame, relationships: DataFrame, entity: int) -> DataFrame:
    """Outgoing and incoming relations of one entity."""
    names = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    out = relationships.filter(F.col("from_entity") == entity).select(F.lit("out").alias("direction"), "relation_type", "confidence", F.col("to_entity").alias("other"))
    into = relationships.filter(F.col("to_entity") == entity).select(F.lit("in").alias("direction"), "relation_type", "confidence", F.col("from_entity").alias("other"))
    return out.unionByName(into).join(names, "other").orderBy(F.desc_nulls_first("confidence"), "other", "direction")


def undirected(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b")).unionByName(relationships.select(F.col("to_entity").alias("a"), F.col("from_entity").alias("b"))).distinct()


def distances(relationships: DataFrame, start: int, deepest: int = DEEPEST) -> DataFrame:
    """Nodes within `deepest` undirected steps of `start`, with their distance."""
    edges = cut(undirected(relationships))  # read once a hop, made once
    frontier = seen = relationships.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    for depth in range(1, deepest + 1):
        step = edges.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path(relationships: DataFrame, start: int, end: int, deepest: int = DEEPEST) -> DataFrame:
    """A shortest undirected path as an array of nodes; of several the smallest. Empty if there is none."""
    edges = cut(undirected(relationships))
    frontier = relationships.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = frontier.select("node")
    for _ in range(deepest + 1):
        found = frontier.filter(F.col("node") == end)
        if not found.isEmpty():
            return found.select(F.size("path").alias("nodes"), "path")
        step = edges.join(frontier, edges.a == frontier.node).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(frontier.select("node"))
    return frontier.limit(0).select(F.size("path").alias("nodes"), "path")


def recall(relationships: DataFrame, start: int, hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """Edges by which each hop reaches nodes that were not visited before; several edges to one node all count."""
    edges = relationships.filter(F.col("relation_type").isin(types)) if types else relationships
    edges = edges.select("from_entity", "to_entity", "relation_type")
    edges = cut(edges)
    ends = F.explode(F.array(F.struct(F.col("from_entity").alias("near"), F.col("to_entity").alias("far")), F.struct(F.col("to_entity").alias("near"), F.col("from_entity").alias("far"))))
    both = edges.select("*", ends.alias("end")).select("from_entity", "to_entity", "relation_type", "end.near", "end.far")
    frontier = visited = relationships.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"))
    out = []
    for hop in range(1, max(1, min(MOST_HOPS, hops)) + 1):
        step = cut(both.join(frontier.select(F.col("node").alias("near")), "near", "left_semi").join(visited.select(F.col("node").alias("far")), "far", "left_anti"))
        out.append(step.select(F.lit(hop).alias("hop"), "from_entity", "to_entity", "relation_type"))
        frontier = step.select(F.col("far").alias("node")).distinct()
        visited = visited.unionByName(frontier)
    return functools.reduce(DataFrame.unionByName, out)


def seed_of(entities: DataFrame, name: str, project: str | None = None) -> DataFrame:
    """The entity that a name stands for: of those it resolves to one of the project if there is one, else the first."""
    found = resolve(entities, name).join(entities.select("id", "project_name"), "id")
    own = [F.desc_nulls_last(F.col("project_name") == project)] if project else []
    return found.orderBy(*own, F.desc_nulls_first("mention_count"), "id").limit(1)


def recalled(entities: DataFrame, relationships: DataFrame, start: int, hops: int = 1, types: list[str] | None = None) -> DataFrame:
    """The edges of `recall` with the entity that each reaches, its direction and confidence."""
    steps = recall(relationships, start, hops, types)
    depth = steps.select(F.col("from_entity").alias("id"), "hop").unionByName(steps.select(F.col("to_entity").alias("id"), "hop")).groupBy("id").agg(F.min("hop").alias("first")).withColumn("first", F.when(F.col("id") == start, 0).otherwise(F.col("first")))
    # an edge of a hop reaches the end that no earlier hop has
    ends = steps.join(depth.withColumnsRenamed({"id": "to_entity", "first": "to_first"}), "to_entity").withColumn("out", F.col("to_first") == F.col("hop"))
    ends = ends.select("hop", "from_entity", "to_entity", "relation_type", F.when(F.col("out"), F.col("to_entity")).otherwise(F.col("from_entity")).alias("id"), F.when(F.col("out"), "outgoing").otherwise("incoming").alias("direction"))
    sure = relationships.groupBy("from_entity", "to_entity", "relation_type").agg(F.max("confidence").alias("confidence"))
    named = entities.select("id", "name", "entity_type", "project_name", "mention_count")
    return ends.distinct().join(sure, ["from_entity", "to_entity", "relation_type"]).join(named, "id").select("hop", "direction", "relation_type", "confidence", "id", "name", "entity_type", "project_name", "mention_count")


def latest_mentions(mentions: DataFrame, entity: int, limit: int = 20) -> DataFrame:
    return mentions.filter(F.col("entity_id") == entity).orderBy(F.desc_nulls_first("created_at"), F.desc("id")).limit(limit).select("source_type", "source_id", "context_snippet", "created_at")


def degrees(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relations of each entity; a relation of an entity to itself counts once."""
    ends = relationships.select(F.explode(F.array_distinct(F.array("from_entity", "to_entity"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return entities.join(ends, "id").select("id", "name", "mention_count", "degree")


def contradictions(relationships: DataFrame) -> DataFrame:
    """Pairs of entities with relations of more than one type."""
    return relationships.groupBy("from_entity", "to_entity").agg(F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("types"), F.countDistinct("relation_type").alias("n_types")).filter("n_types > 1")


def attribute_conflicts(relationships: DataFrame) -> DataFrame:
    """Relations of one kind between the same two entities whose attributes (a JSON text) differ, however deep."""
    rows = relationships.withColumn("plain", canonical_json("attributes")).filter("plain != '{}'")
    return rows.groupBy("from_entity", "to_entity", "relation_type").agg(F.countDistinct("plain").alias("n")).filter("n > 1")


def attribute_keys(entities: DataFrame, limit: int = 20) -> DataFrame:
    """Keys of the entities' attributes (a JSON text), those of the most mentioned first, and the rows of each entity before its keys are laid out."""
    rows = entities.withColumn("entries", F.count("*").over(Window.partitionBy("id")))
    return rows.select("id", "mention_count", "entries", F.explode(F.json_object_keys("attributes")).alias("key")).orderBy(F.desc_nulls_first("mention_count"), "id", "key").limit(limit)


def merged_attributes(old: str | Column, new: str | Column) -> Column:
    """Attributes of two maps, the new ones winning."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e["key"])), F.map_entries(new)))


def timeline(entities: DataFrame, relationships: DataFrame, mentions: DataFrame, conversations: DataFrame, entity: int) -> DataFrame:
    """What happened with an entity, oldest first: its mentions with their conversations, and its relations."""
    talk = conversations.select(F.col("id").alias("source_id"), F.col("project_name").alias("detail")).withColumn("source_type", F.lit("conversation"))
    told = mentions.filter(F.col("entity_id") == entity).join(talk, ["source_type", "source_id"], "left").select(F.lit("mention").alias("kind"), "created_at", "detail")
    names = entities.select("id", "name")
    ends = relationships.filter((F.col("from_entity") == entity) | (F.col("to_entity") == entity)).join(names.withColumnsRenamed({"id": "from_entity", "name": "from_name"}), "from_entity").join(names.withColumnsRenamed({"id": "to_entity", "name": "to_name"}), "to_entity")
    return told.unionByName(ends.select(F.lit("relation").alias("kind"), "created_at", F.concat_ws(" ", "from_name", "relation_type", "to_name").alias("detail")))


def subgraph(entities: DataFrame, relationships: DataFrame, words: list[str], least: int = 0, types: list[str] | None = None, cap: int = 200) -> DataFrame:
    """Edges among the entities whose name holds one of the words and their neighbours; the cap on nodes is the feature."""
    hit = functools.reduce(lambda a, b: a | b, (F.col("name").ilike(f"%{w}%") for w in dict.fromkeys(words)))
    seeds = entities.filter(hit).select("id")
    edges = undirected(relationships)
    near = edges.join(seeds.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    nodes = entities.join(seeds.unionByName(near).distinct(), "id", "left_semi").filter(F.col("mention_count") >= least)
    if types:
        nodes = nodes.filter(F.col("entity_type").isin(types))
    nodes = nodes.orderBy(F.desc_nulls_last("mention_count"), "id").limit(cap).select("id")
    return relationships.join(nodes.withColumnRenamed("id", "from_entity"), "from_entity", "left_semi").join(nodes.withColumnRenamed("id", "to_entity"), "to_entity", "left_semi").select("from_entity", "to_entity", "relation_type")


def best_match(entities: DataFrame, project: str) -> DataFrame:
    """One entity of each canonical name: of the project if there is one, else the most mentioned."""
    w = Window.partitionBy("canonical_name").orderBy(F.desc_nulls_last(F.col("project_name") == project), F.desc_nulls_first("mention_count"), "id")
    return entities.withColumn("k", F.row_number().over(w)).filter("k = 1").select("canonical_name", "id", "mention_count")


def upsert_entities(existing: DataFrame, found: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Entities after a batch of findings: same type, name and project add up; without a project a finding is new.

    Both have entity_type, canonical_name, project_name, mention_count, confidence; keys of findings may repeat. Where
    both also have `attributes` (a map) and findings a `place` in their order, later ones win over earlier ones; where
    existing entities have `last_seen`, those found again were seen `as_of`.
    """
    key = ["entity_type", "canonical_name", "project_name"]
    merges, dates = "attributes" in existing.columns, "last_seen" in existing.columns
    more = [F.sum("mention_count").alias("more"), F.max("confidence").alias("sure")]
    if merges:
        scoped = found.filter("project_name IS NOT NULL")
        # one value a key and attribute, before the maps of an entity are put together
        latest = scoped.select(*key, "place", F.explode("attributes")).groupBy(*key, "key").agg(F.max_by("value", "place").alias("value"))
        maps = latest.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("new"))
        sums = scoped.groupBy(*key).agg(*more).join(maps, key, "left")
    else:
        sums = found.filter("project_name IS NOT NULL").groupBy(*key).agg(*more)
    nothing = F.create_map().cast("map<string,string>")
    extra, alone = [], []
    if merges:
        extra.append(merged_attributes(F.coalesce("attributes", nothing), F.coalesce("new", nothing)).alias("attributes"))
        alone.append(F.coalesce("attributes", nothing).alias("attributes"))
    if dates:
        extra.append(F.when(F.col("more").isNotNull(), as_of).otherwise(F.col("last_seen")).alias("last_seen"))
        alone.append(as_of.alias("last_seen"))
    merged = existing.join(sums, key, "full").select(*key, (F.coalesce("mention_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("mention_count"), F.greatest("confidence", "sure").alias("confidence"), *extra)
    return merged.unionByName(found.filter("project_name IS NULL").select(*key, "mention_count", "confidence", *alone))


def mentions_of(found: DataFrame, entities: DataFrame, as_of: Column) -> DataFrame:
    """Mentions to append, one a finding and never merged: `found` has the entity's key, source and context."""
    key = ["entity_type", "canonical_name", "project_name"]
    ids = entities.select(F.col("id").alias("entity_id"), *(F.col(c).alias(f"own_{c}") for c in key))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key))
    return found.join(ids, same).select("entity_id", "source_type", "source_id", F.substring("context_snippet", 1, 500).alias("context_snippet"), as_of.alias("created_at"))


def detail(entities: DataFrame, relationships: DataFrame, mentions: DataFrame, conversations: DataFrame, entity: int) -> DataFrame:
    """All that is shown of an entity: relations out and in, mentions with their conversations, newest first."""
    sides = neighbours(entities, relationships, entity).select("direction", F.col("relation_type").alias("what"), F.col("other").alias("id"), F.col("other_name").alias("title"))
    talk = conversations.select(F.col("id").alias("source_id"), "summary").withColumn("source_type", F.lit("conversation"))
    told = mentions.filter(F.col("entity_id") == entity).join(talk, ["source_type", "source_id"], "left").orderBy(F.desc_nulls_first("created_at"), "id")
    return sides.unionByName(told.select(F.lit("mention").alias("direction"), F.col("source_type").alias("what"), "id", F.col("summary").alias("title")))


def new_relationships(existing: DataFrame, found: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Relations to append: known types, no self-loops, once per pair, type and source."""
    key = ["from_entity", "to_entity", "relation_type", "source_type", "source_id"]
    return found.filter((F.col("from_entity") != F.col("to_entity")) & F.col("relation_type").isin(*types)).dropDuplicates(key).join(existing.select(key), key, "left_anti")
