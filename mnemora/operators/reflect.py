"""Reflection: candidates come from Spark joins, verdicts from a pluggable judge, state changes go back as joins.

The number of verdicts is bounded by a parameter, as each costs a call to a model: the cap on pairs is the feature.
Only those judged candidates, never a table, are decided on the driver, where the order of decisions matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import time_bound
from ..schemas import active

MOST_PAIRS, LEAST_CONFIDENCE = 80, 0.6
LEAST_CLUSTER, MOST_IN_CLUSTER, LEAST_SUMMARY = 3, 8, 40
CONTRADICTABLE = ("decision", "pattern", "preference")
Judge = Callable[[Row], dict]


def candidate_pairs(chunks: DataFrame, most: int = MOST_PAIRS, categories: Iterable[str] | None = None) -> DataFrame:
    """Pairs of active chunks of one category and project, in order of group and id."""
    rows = chunks.filter(active())
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    rows = rows.select("id", "category", F.coalesce("project_name", F.lit("")).alias("project"))
    # the first pairs of a group are of its first rows; the rank limit is applied before the shuffle too
    order = Window.partitionBy("category", "project").orderBy("id")
    rows = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most + 1).drop("k")
    a, b = rows.withColumnRenamed("id", "id_a"), rows.withColumnRenamed("id", "id_b")
    return a.join(b, ["category", "project"]).filter("id_a < id_b").orderBy("category", "project", "id_a", "id_b").limit(most).select("id_a", "id_b", "category")


def with_texts(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    columns = ["id", "content", "tags", "confidence", "created_at"]
    a = chunks.select(*(F.col(c).alias(f"{c}_a") for c in columns))
    b = chunks.select(*(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(a, "id_a").join(b, "id_b")


@dataclass
class Changes:
    """What a pass decided: new states, new chunks, audit lines."""

    status: dict[int, tuple[str, int | None]] = field(default_factory=dict)
    merged: list[dict] = field(default_factory=list)
    expires: dict[int, str] = field(default_factory=dict)
    audit: list[tuple[str, list[int], str, str, float]] = field(default_factory=list)

    def apply(self, chunks: DataFrame) -> DataFrame:
        """The chunks with the new states."""
        if not self.status:
            return chunks
        rows = [(i, s, by) for i, (s, by) in self.status.items()]
        new = chunks.sparkSession.createDataFrame(rows, "id long, new_status string, new_by long")
        return chunks.join(F.broadcast(new), "id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("superseded_by", F.coalesce("new_by", "superseded_by")).drop("new_status", "new_by")


def dedup(pairs: DataFrame, judge: Judge, first_id: int) -> Changes:
    """Sure duplicates merge into a new chunk; a chunk that was merged takes no further part."""
    out, used = Changes(), set()
    for p in pairs.orderBy("category", "id_a", "id_b").collect():  # at most MOST_PAIRS rows
        if p.id_a in used or p.id_b in used:
            continue
        v = judge(p)
        if not v.get("duplicate") or v.get("confidence", 0) < LEAST_CONFIDENCE:
            continue
        used |= {p.id_a, p.id_b}
        new = first_id + len(out.merged)
        longer = p.content_a if len(p.content_a) >= len(p.content_b) else p.content_b
        out.merged.append({"id": new, "content": v.get("content") or longer, "category": p.category, "tags": sorted({*p.tags_a, *p.tags_b}), "confidence": max(p.confidence_a, p.confidence_b), "merged_from": [p.id_a, p.id_b]})
        out.status |= {i: ("merged", new) for i in (p.id_a, p.id_b)}
        out.audit.append(("dedup", [p.id_a, p.id_b], "merged", v.get("reasoning", ""), v["confidence"]))
    return out


def contradict(pairs: DataFrame, judge: Judge) -> Changes:
    """Of two that contradict, the newer stands: the one the judge names, else the later, of equals the first."""
    out = Changes()
    for p in pairs.orderBy("category", "id_a", "id_b").collect():  # at most MOST_PAIRS rows
        v = judge(p)
        if not v.get("contradicts") or v.get("confidence", 0) < LEAST_CONFIDENCE:
            continue
        newer = v.get("newer_id") if v.get("newer_id") in (p.id_a, p.id_b) else (p.id_b if p.created_at_b > p.created_at_a else p.id_a)
        older = p.id_b if newer == p.id_a else p.id_a
        if older not in out.status:
            out.status[older] = ("superseded", newer)
        out.audit.append(("contradiction", [older, newer], "superseded", v.get("reasoning", ""), v["confidence"]))
    return out


def stale_candidates(chunks: DataFrame) -> DataFrame:
    """Active chunks that name a date or a time word."""
    return chunks.filter(active() & time_bound("content"))


def expire(candidates: DataFrame, judge: Judge, today: str, most: int = 50) -> Changes:
    """Chunks that the judge finds stale get an expiry date; past ones become stale."""
    out = Changes()
    for c in candidates.orderBy("id").limit(most).collect():
        v = judge(c)
        if not v.get("stale") or v.get("confidence", 0) < LEAST_CONFIDENCE:
            continue
        if date := v.get("expires_at"):
            out.expires[c.id] = date
            if date <= today:
                out.status[c.id] = ("stale", None)
        out.audit.append(("stale_detection", [c.id], "expired", v.get("reasoning", ""), v["confidence"]))
    return out


def tag_clusters(chunks: DataFrame, least: int = LEAST_CLUSTER) -> DataFrame:
    """Chunks that share category, project and a tag in any case: size, and the first ids."""
    rows = chunks.filter(active()).select("id", "category", F.coalesce("project_name", F.lit("")).alias("project"), F.explode("tags").alias("tag"))
    rows = rows.select("id", "category", "project", F.lower("tag").alias("tag")).distinct()
    return rows.groupBy("category", "project", "tag").agg(F.count("*").alias("size")).filter(F.col("size") >= least)


def clustered_ids(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of clusters, one row each."""
    rows = chunks.filter(active()).select("id", "category", F.coalesce("project_name", F.lit("")).alias("project"), F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag")).distinct()
    return rows.join(clusters, ["category", "project", "tag"])


def consolidate(chunks: DataFrame, judge: Judge, first_id: int, most: int = 20) -> Changes:
    """Largest clusters first, each chunk in one cluster at most: a summary joins them, the originals stay."""
    out, used = Changes(), set()
    clusters = tag_clusters(chunks).orderBy(F.desc("size"), "category", "project", "tag").limit(most)
    members: dict[tuple, list[int]] = {}
    wide = clustered_ids(chunks, clusters).groupBy("category", "project", "tag", "size").agg(F.slice(F.array_sort(F.collect_set("id")), 1, MOST_IN_CLUSTER * most).alias("ids"))
    for c in wide.orderBy(F.desc("size"), "category", "project", "tag").collect():  # at most `most` rows
        members[c.category, c.project, c.tag] = c.ids
    for (category, project, tag), ids in members.items():
        fresh = [i for i in ids if i not in used][:MOST_IN_CLUSTER]
        if len(fresh) < LEAST_CLUSTER:
            continue
        v = judge(Row(category=category, project=project, tag=tag, ids=fresh))
        if len((v.get("content") or "").strip()) < LEAST_SUMMARY:
            continue
        used |= set(fresh)
        out.merged.append({"id": first_id + len(out.merged), "content": v["content"], "category": category, "tags": sorted({tag, *v.get("tags", [])}), "confidence": 0.9, "merged_from": fresh})
        out.audit.append(("consolidation", fresh, "consolidated", v.get("reasoning", ""), 0.9))
    return out
