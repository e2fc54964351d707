"""Changes of memory chunks as a log: small appended events, folded into the table when it is read.

An event says that a chunk was seen, superseded, forgotten or edited. Tracking a search so appends as many rows as it
returned, and superseding or forgetting appends one a chunk, however large the table is; `folded` makes the state of the
table from the last full copy and the events, and `Store.fold` writes it as the next full copy.

The order of the events of a chunk is by `at`, then `place`, then `event`, which is a name of its own for each event; an
event that occurs twice, as after a repeated write, counts once. A forgotten chunk stays forgotten: later events of its id
change nothing. Of several supersedings and edits of one field the last holds; a later one without a value (null) keeps
what was there. Seen counts are summed, and the latest time of these is the last access. References of other chunks to a forgotten
one become null while their status stays, and its vectors go. Events of unknown ids change nothing. Null times sort first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of events.
SEEN, SUPERSEDED, FORGOTTEN, EDITED = "seen", "superseded", "forgotten", "edited"
#: Columns of a chunk that an edit may set.
EDITABLE = {"content": "string", "category": "string", "tags": "array<string>", "confidence": "decimal(3,2)", "project_name": "string", "status": "string", "expires_at": "timestamp"}


def events(ids: DataFrame, kind: str, at: Column, name: str, superseded_by: int | None = None, **values: Column) -> DataFrame:
    """One event a row of `ids` (`id`, each once); `name` names the change, so that writing it twice changes nothing."""
    if unknown := set(values) - set(EDITABLE):
        raise ValueError(f"no such columns to edit: {sorted(unknown)}")
    own = F.concat(F.lit(f"{name}:"), F.col("id").cast("string"))
    fields = [values.get(c, F.lit(None)).cast(t).alias(c) for c, t in EDITABLE.items()]
    return ids.select("id").distinct().select(own.alias("event"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), at.cast("timestamp").alias("at"), F.lit(0).alias("place"), F.lit(superseded_by).cast("long").alias("superseded_by"), *fields)


def of_ids(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


def by_chunk(log: DataFrame) -> DataFrame:
    """One row a chunk: how often and when it was seen, the last values that were set, and whether it was forgotten.

    All in one aggregation with partial sums, so a chunk that is seen very often is one row a task before the shuffle.
    """
    once = log.dropDuplicates(["event"])
    order = lambda c: F.when(c, F.struct(F.col("at").isNotNull().alias("known"), "at", "place", "event"))
    last = lambda value, c: F.max_by(value, order(c & F.col(value).isNotNull()))
    kind = F.col("kind")
    sets = [last(c, kind == EDITED).alias(f"new_{c}") for c in EDITABLE if c != "status"]
    status = F.when(kind == SUPERSEDED, F.lit(SUPERSEDED)).when(kind == EDITED, F.col("status"))
    once = once.withColumn("state", status)
    return once.groupBy("id").agg(
        F.count_if(kind == SEEN).alias("seen"), F.max(F.when(kind == SEEN, F.col("at"))).alias("seen_at"), F.coalesce(F.bool_or(kind == FORGOTTEN), F.lit(False)).alias("gone"),
        F.max_by("state", order(F.col("state").isNotNull())).alias("new_status"), last("superseded_by", kind == SUPERSEDED).alias("new_superseded_by"), F.max(F.when(kind == SUPERSEDED, F.col("at"))).alias("new_superseded_at"), *sets,
    )


def folded(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """The chunks as the events leave them, with the columns of `chunks`."""
    changed = by_chunk(log)
    changed = changed.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in changed.columns if c != "id"))
    rows = chunks.join(changed, F.col("id") == F.col("_id"), "left").filter(~F.coalesce("_gone", F.lit(False)))
    new = {"access_count": F.col("access_count") + F.coalesce("_seen", F.lit(0)), "last_accessed": F.coalesce("_seen_at", "last_accessed"), "superseded_by": F.coalesce("_new_superseded_by", "superseded_by"), "superseded_at": F.coalesce("_new_superseded_at", "superseded_at") if "superseded_at" in chunks.columns else None}
    new |= {c: F.coalesce(f"_new_{c}", c) for c in EDITABLE if c in chunks.columns}
    rows = rows.withColumns({c: e.cast(chunks.schema[c].dataType) for c, e in new.items() if c in chunks.columns})
    forgotten = log.filter(F.col("kind") == FORGOTTEN).select(F.col("id").alias("_dead")).distinct()
    # a reference is looked up only where there is one
    without = rows.filter("superseded_by IS NULL").select(*chunks.columns)
    with_ = rows.filter("superseded_by IS NOT NULL").join(forgotten, F.col("superseded_by") == F.col("_dead"), "left")
    return without.unionByName(with_.withColumn("superseded_by", F.when(F.col("_dead").isNull(), F.col("superseded_by"))).select(*chunks.columns))


def folded_vectors(embeddings: DataFrame, log: DataFrame) -> DataFrame:
    """The vectors without those of forgotten chunks."""
    gone = log.filter(F.col("kind") == FORGOTTEN).select(F.col("id").alias("_dead")).distinct()
    return embeddings.join(gone, (F.col("source_type") == "memory_chunk") & (F.col("source_id") == F.col("_dead")), "left_anti")
