"""Command line over a store: python -m mnemora.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import MemoryStore, console
from .plans import reports
from .schemas import CATEGORIES, TABLES, active
from .sources import sinks
from .sources.store import Store
from .streaming.ingest import ingest_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemora")
    p.add_argument("--root", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "ingest": ["folder"], "search": ["term"], "add": ["category", "content"], "forget": ["ids"], "stats": [], "coverage": [],
        "recall": ["entity"], "preload": ["project"], "sql": ["statement"], "export": ["table", "path"], "reflections": [], "decisions": ["project"], "project": ["project"], "contact": ["name"], "fold": [], "backup": ["folder"], "edit": ["id", "content"],
    }.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a, choices=CATEGORIES if a == "category" else None)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("mnemora").getOrCreate()
    store = Store(spark, a.root)
    memory, now = MemoryStore(store), F.current_timestamp()
    chunks = store.read("memory_chunks")
    if a.command == "ingest":
        ingest_stream(spark, a.folder, store, f"{a.root}/checkpoint", now).awaitTermination()
    elif a.command == "search":
        memory.find(a.term).show(truncate=80)
    elif a.command == "add":
        print(memory.write(a.content, a.category, now))
    elif a.command == "forget":
        from .operators.mutations import parse_ids

        print(memory.forget(parse_ids(a.ids), "command line", now))
    elif a.command == "stats":
        reports.counts(**{t: store.read(t) for t in TABLES if t != "applied_migrations"}).show()
    elif a.command == "coverage":
        reports.coverage_by_project(chunks).show(100)
    elif a.command == "recall":
        seed, near, mentions = memory.recall(a.entity, 2)
        if seed:
            near.show(100)
            mentions.show(20, truncate=80)
    elif a.command == "preload":
        chosen = reports.context_preload(chunks, a.project).select("id")
        print(sinks.context_markdown(chunks.join(chosen, "id"), a.project))
    elif a.command == "sql":
        console(spark, a.statement, {t: store.read(t) for t in TABLES if t != "applied_migrations"}).show(100)
    elif a.command == "export":
        sinks.write_csv(store.read(a.table), a.path)
    elif a.command == "reflections":
        memory.recent_reflections().show(truncate=80)
    elif a.command == "project":
        reports.by_project(chunks.filter(active()), a.project).join(chunks.select("id", "content"), "id").show(100, truncate=80)
    elif a.command == "contact":
        reports.contact_notes(chunks, a.name).show(100, truncate=80)
    elif a.command == "fold":
        print(store.fold())
    elif a.command == "backup":
        print(store.backup(a.folder, datetime.now()))
    elif a.command == "edit":
        print(memory.edit(int(a.id), now, content=a.content))
    elif a.command == "decisions":
        reports.decisions_for_project(chunks, store.read("conversations"), a.project).show(100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
