"""Session files as a stream: new files are parsed in micro-batches and committed once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import not_yet
from ..sources.sessions import parse_sessions
from ..sources.store import Store
from ..shared import written

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, glob: str = "*.jsonl", per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)


def commit_batch(store: Store, as_of: Column, append_new: bool = False) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: files whose path and hash are logged are left out, so a batch may run twice.

    A changed file of a known session adds nothing, as the first version wins, unless `append_new` is set: then
    messages with new uuids are added. Of several files of one session in a batch that with the smallest path is the
    first version. A uuid that repeats in a session counts once, by its first line.
    """

    def run(batch: DataFrame, _: int) -> None:
        now = store.tables("ingestion_log", "conversations", "messages")
        logged = now["ingestion_log"].select(F.col("file_path").alias("path"), "file_hash")
        files = not_yet(batch.withColumn("file_hash", F.sha2("content", 256)), logged, ["path", "file_hash"])
        if files.isEmpty():
            return
        conversations, messages = parse_sessions(files.select("path", "content"), as_of)
        conversations = written(conversations)
        known = now["conversations"]
        first = conversations.groupBy("session_id").agg(F.min(F.struct("path", "file_hash")).alias("first"))
        fresh = not_yet(conversations.join(first, "session_id").filter(F.struct("path", "file_hash") == F.col("first")), known, ["session_id"])
        fresh = fresh.dropDuplicates(["session_id"]).withColumn("id", F.xxhash64("session_id").bitwiseAND(F.lit(2**62 - 1)))  # a batch that runs twice gives the same ids
        ids = fresh.select("session_id", F.col("id").alias("conversation_id"), F.col("path").alias("first_path"))
        if append_new:
            ids = ids.unionByName(known.select("session_id", F.col("id").alias("conversation_id"), F.lit("").alias("first_path")))
        lines = messages.join(ids, "session_id")
        if append_new:
            lines = not_yet(lines.filter("uuid IS NOT NULL OR path = first_path"), now["messages"].filter("uuid IS NOT NULL"), ["uuid"])
        else:
            lines = lines.filter("path = first_path")
        # one row a uuid; lines without one are all kept
        own = F.coalesce("uuid", F.concat_ws(" ", "path", F.col("line_no").cast("string")))
        order = Window.partitionBy("session_id", "own").orderBy(F.col("path") != F.col("first_path"), "path", "line_no")
        lines = lines.withColumn("own", own).withColumn("k", F.row_number().over(order)).filter("k = 1")
        log = conversations.select(F.xxhash64("path", "file_hash").alias("id"), F.col("path").alias("file_path"), "file_hash", as_of.alias("ingested_at"), F.col("message_count").alias("record_count"))
        store.commit(
            appended={
                "conversations": fresh.select("id", "session_id", "project_path", "project_name", "model", "entrypoint", "git_branch", "started_at", "ended_at", "message_count"),
                "messages": lines.select(F.xxhash64("session_id", "own", "file_hash").alias("id"), "conversation_id", "uuid", "parent_uuid", "role", "content", "tool_name", "is_sidechain", "model", "created_at"),
                "ingestion_log": log,
            }
        )

    return run


def ingest_stream(spark: SparkSession, root: str, store: Store, checkpoint: str, as_of: Column, **options) -> StreamingQuery:
    """Start a query that takes all files that are there, then ends; the scheduler starts it again."""
    return stream_files(spark, root).writeStream.foreachBatch(commit_batch(store, as_of, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_messages(messages: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Messages by window and role, for streams with a watermark on their time."""
    return messages.withWatermark("created_at", late).groupBy(F.window("created_at", width), "role").agg(F.count("*").alias("n"))
