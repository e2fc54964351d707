"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query is run once to warm up on the smallest tables, then once, timed, with its whole result written to a
sink that keeps nothing. Rates that the baseline states by the second are added beside the times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "coverage_by_project", "conversation_stats", "monthly_activity", "tool_usage_by_day", "session_roles", "search_chunks", "global_search", "context_preload",
    "transcript_build", "preview_build", "redact_text", "knn_search", "knn_project_scoped", "similar_to_source", "trigram_topk",
    "graph_neighbors", "graph_distances", "graph_khop", "graph_degree", "graph_timeline", "entity_upsert_merge", "dedup_pairs", "tag_clusters",
    "forget_cascade", "upsert_latest_wins", "new_files", "exact_dup_hash", "calendar_union", "search_memory", "entity_upsert_attributes",
    "knn_join", "changes_folded", "graph_paths",
]
SMALL = "/root/testdata/sf0.001"


def timed(spark: SparkSession, fn, folder: str) -> float:
    began = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def ingest_rate(spark: SparkSession, sessions: int = 100, messages: int = 30) -> dict[str, float]:
    """Sessions and messages a second from JSON-lines files through the stream to the commit of the tables.

    A second run over the same files, all of which the log knows, is timed too.
    """
    from mnemora.sources.store import Store
    from mnemora.streaming.ingest import ingest_stream

    root = tempfile.mkdtemp(prefix="bench-")
    folder = os.path.join(root, "projects", "-home-user-project")
    os.makedirs(folder)
    for s in range(sessions):
        with open(os.path.join(folder, f"s{s}.jsonl"), "w") as f:
            for m in range(messages):
                role = "user" if m % 2 == 0 else "assistant"
                content = f"message {m} of session {s}, some words of text" if m % 3 else [{"type": "text", "text": f"block {m}"}, {"type": "tool_use", "name": "Read", "input": {"path": f"/x/{m}"}}]
                f.write(json.dumps({"type": role, "uuid": f"{s}-{m}", "sessionId": f"s{s}", "timestamp": f"2024-01-01T10:{m % 60:02d}:00Z", "message": {"role": role, "content": content}}) + "\n")
    store = Store(spark, os.path.join(root, "store"))
    as_of = F.lit("2024-02-15 00:00:00").cast("timestamp")
    took = []
    for k in range(2):
        began = time.perf_counter()
        ingest_stream(spark, os.path.join(root, "projects"), store, os.path.join(root, f"checkpoint{k}"), as_of).awaitTermination()
        took.append(time.perf_counter() - began)
    there = [store.read(t).count() for t in ("conversations", "messages")]
    assert there == [sessions, sessions * messages], there
    return {"ingest_sessions_per_sec": round(sessions / took[0], 1), "ingest_messages_per_sec": round(sessions * messages / took[0], 1), "ingest_sec": round(took[0], 2), "ingest_again_sec": round(took[1], 2)}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from mnemora import queries_views  # noqa: F401
    from mnemora.queries import QUERIES

    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    times = {}
    for n in names:
        timed(spark, QUERIES[n], SMALL)
        times[n] = timed(spark, QUERIES[n], folder)
    ingest_rate(spark, 10)
    rates = ingest_rate(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
