"""The tools of the memory as methods over a store: search, recall, write, supersede, forget, audit."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import changes, graph, mutations, retrieval
from .operators.embedding import Embedder
from .plans import reports
from .schemas import CATEGORIES
from .shared import written
from .sources.store import Store

MOST_LISTED = 200


class MemoryStore:
    """Reads and changes of the memory; `as_of` is the present of every call."""

    def __init__(self, store: Store, embedder: Embedder | None = None, project: str | None = None, strict: bool = False):
        self.store, self.embedder, self.project, self.strict = store, embedder, project, strict

    def scope(self, project: str | None) -> str | None:
        """None asks for the default project, the empty name for all, which a strict store refuses."""
        if project is None:
            return self.project
        if project == "" and self.strict:
            raise ValueError("a project must be named")
        return project or None

    def search(self, text: str, scope: str | None = None, project: str | None = None, limit: int = 10, as_of: Column | None = None) -> DataFrame:
        """The sources closest to a text; a scope filters after the limit. With `as_of` access to their chunks is tracked."""
        if not self.embedder:
            raise ValueError("no embedder is set")
        tables = (self.store.read(t) for t in ("embeddings", "memory_chunks", "messages", "conversations"))
        found = retrieval.nearest(*tables, self.embedder([text])[0], max(1, min(MOST_LISTED, limit)), scope, self.scope(project))
        if as_of is None:
            return found
        found = written(found)
        self._tracked(found.filter("source_type = 'memory_chunk'").select(F.col("source_id").alias("id")), as_of)
        return found

    def find(self, term: str, limit: int = 20, as_of: Column | None = None) -> DataFrame:
        """Chunks that hold a term; with `as_of` their access is tracked: as many rows are appended as were found."""
        return self._tracked(reports.search_chunks(self.store.read("memory_chunks"), term, limit), as_of)

    def _tracked(self, hits: DataFrame, as_of: Column | None) -> DataFrame:
        if as_of is None:
            return hits
        hits = written(hits)
        self.store.commit(appended={"chunk_events": self._events(hits, changes.SEEN, as_of)})
        return hits

    def _events(self, ids: DataFrame, kind: str, as_of: Column, **values) -> DataFrame:
        return changes.events(ids, kind, as_of, uuid.uuid4().hex, **values)

    def preload(self, project: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
        """The chunks and contacts that a session starts with; an audit row says which they were."""
        chunks = self.store.read("memory_chunks")
        chosen, people = written(reports.context_preload(chunks, project)), written(reports.preload_contacts(chunks, project))
        new = self.store.next_id("memory_reflections")
        audit = reports.preload_audit(chosen, people, project, as_of).withColumn("id", F.lit(new))
        self.store.commit(appended={"memory_reflections": audit}, last_ids={"memory_reflections": new})
        return chosen, people

    def recall_entity(self, name: str, hops: int = 2, types: list[str] | None = None) -> DataFrame:
        seed = graph.resolve(self.store.read("entities"), name, 1).first()
        if not seed:
            raise LookupError(name)
        return graph.recall(self.store.read("relationships"), seed.id, hops, types)

    def recall(self, name: str, hops: int = 1, project: str | None = None, types: list[str] | None = None) -> tuple[Row | None, DataFrame | None, DataFrame | None]:
        """The entity of a name, preferably of the project, what lies within some hops of it, and its latest mentions; nothing if there is none."""
        entities = self.store.read("entities")
        seed = graph.seed_of(entities, name, self.scope(project)).first()
        if seed is None:
            return None, None, None
        return seed, graph.recalled(entities, self.store.read("relationships"), seed.id, hops, types), graph.latest_mentions(self.store.read("entity_mentions"), seed.id)

    def preload_summary(self) -> Row | None:
        """What the latest session started with."""
        return reports.preload_summary(self.store.read("memory_reflections")).first()

    def write(self, content: str, category: str, as_of: Column, project: str | None = None, confidence: float = 0.8, tags: Sequence[str] = ()) -> int:
        """Append a chunk; returns its id."""
        if category not in CATEGORIES:
            raise ValueError(f"unknown category {category!r}")
        if not content.strip():
            raise ValueError("empty content")
        new = self.store.next_id("memory_chunks")
        row = self.store.spark.createDataFrame([(new, "manual", content, category, list(tags), min(1.0, max(0.0, confidence)), self.scope(project), "active", 0)], "id long, source_type string, content string, category string, tags array<string>, confidence double, project_name string, status string, access_count int")
        base = self.store.spark.createDataFrame([], self.store.read("memory_chunks").schema)
        self.store.commit(appended={"memory_chunks": base.unionByName(mutations.validated(row).withColumn("created_at", as_of), allowMissingColumns=True)}, last_ids={"memory_chunks": new})
        return new

    def supersede(self, old: int, new: int, reason: str, as_of: Column) -> bool:
        """Mark a chunk as superseded; false if it is not there, the audit line is written in either case."""
        there = not self.store.read("memory_chunks").filter(F.col("id") == old).isEmpty()
        audit, last = self._audit("manual_supersede", "superseded" if there else "not_found", reason, [old, new], as_of)
        log = {"chunk_events": self._events(changes.of_ids(self.store.spark, [old]), changes.SUPERSEDED, as_of, superseded_by=new)} if there else {}
        self.store.commit(appended={"memory_reflections": audit, **log}, last_ids=last)
        return there

    def edit(self, chunk: int, as_of: Column, **values) -> bool:
        """Set columns of a chunk; false if it is not there."""
        if values.get("category") is not None and values["category"] not in CATEGORIES:
            raise ValueError(f"unknown category {values['category']!r}")
        if self.store.read("memory_chunks").filter(F.col("id") == chunk).isEmpty():
            return False
        own = {c: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v) for c, v in values.items()}
        self.store.commit(appended={"chunk_events": self._events(changes.of_ids(self.store.spark, [chunk]), changes.EDITED, as_of, **own)})
        return True

    def forget(self, ids: Sequence[int], reason: str, as_of: Column) -> int:
        """Delete chunks with their vectors and the references to them, in one commit; returns how many there were."""
        n = self.store.read("memory_chunks").filter(F.col("id").isin(*ids)).count()
        audit, last = self._audit("forget", "deleted", reason, ids, as_of)
        self.store.commit(appended={"memory_reflections": audit, "chunk_events": self._events(changes.of_ids(self.store.spark, ids), changes.FORGOTTEN, as_of)}, last_ids=last)
        return n

    def forget_entity(self, entity: int, reason: str, as_of: Column) -> None:
        names = ("entities", "relationships", "entity_mentions")
        left = mutations.forget_entity(*(self.store.read(t) for t in names), entity)
        audit, last = self._audit("forget_entity", "deleted", reason, [entity], as_of)
        self.store.commit(replaced=dict(zip(names, left)), appended={"memory_reflections": audit}, last_ids=last)

    def recent_reflections(self, kinds: Sequence[str] = (), limit: int = 20) -> DataFrame:
        rows = self.store.read("memory_reflections")
        return reports.reflection_log(rows.filter(F.col("reflection_type").isin(*kinds)) if kinds else rows, max(1, min(MOST_LISTED, limit)))

    def projects(self) -> DataFrame:
        return reports.distinct_values(self.store.read("memory_chunks"), "project_name")

    def _audit(self, kind: str, action: str, reason: str, ids: Sequence[int], as_of: Column) -> tuple[DataFrame, dict[str, int]]:
        """An audit row, and the id that it takes."""
        new = self.store.next_id("memory_reflections")
        one = self.store.spark.createDataFrame([(new, reason, list(ids))], "id long, reason string, ids array<long>")
        rows = mutations.log_reflection(kind, action, F.col("reason"), F.col("ids"), F.lit(1.0), as_of, one)
        return one.select("id").crossJoin(rows), {"memory_reflections": new}  # one row each


def console(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Read-only SQL over the named tables."""
    words = statement.split(None, 1)
    plain = words[1] if words and words[0].lower() == "explain" and len(words) > 1 else statement
    if not plain.lstrip(" (\t\n").lower().startswith(("select", "with")):
        raise ValueError("only SELECT, WITH and EXPLAIN are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        spark.sql(f"SELECT * FROM (\n{plain}\n) LIMIT 0")  # what changes tables cannot stand in a subquery
    except ParseException as e:
        raise ValueError("only SELECT, WITH and EXPLAIN are allowed") from e
    return spark.sql(statement)
