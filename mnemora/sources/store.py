"""Versioned Parquet tables: each commit writes new folders and then one manifest, which readers go by.

The manifest is written last and under a new number, so a failed commit leaves no trace in reads. A commit that only
appends goes onto the newest manifest, also where another writer has committed meanwhile; one that replaces tables or
gives ids is refused then. Files are written by Spark; the manifest is one small row of JSON, itself a Spark text file,
so that any file system of the cluster will do.

Chunks and vectors are read as their changes (`operators.changes`) leave them; `fold` writes them out so.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..schemas import TABLES

#: Names of backups, which sort by time.
STAMP = "%Y%m%d-%H%M%S"


class Store:
    """The tables of the memory model below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> tuple[int, int]:
        """The largest number of a complete manifest, 0 before the first commit, and of any, complete or torn."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()] if fs.exists(path) else []
        complete = [n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/{n}/_SUCCESS"))]
        return max(complete, default=0), max(found, default=0)

    def _manifest(self) -> dict:
        """The newest complete manifest; an empty one before the first commit."""
        n, _ = self._manifests()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{n}").first()[0]) if n else {"tables": {}, "migrations": []}

    def _raw(self, names, now: dict) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(*(f"{self.root}/{f}" for f in now[n])) if now.get(n) else self.spark.createDataFrame([], TABLES[n]) for n in names}

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """Tables as of the last commit; empty ones with their schema before their first."""
        now = self._manifest()["tables"]
        out = self._raw(names, now)
        if now.get("chunk_events"):
            log = self._raw(["chunk_events"], now)["chunk_events"]
            out |= {n: fold(out[n], log) for n, fold in (("memory_chunks", changes.folded), ("embeddings", changes.folded_vectors)) if n in out}
        return out

    def read(self, name: str) -> DataFrame:
        return self.tables(name)[name]

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, migrations: list[str] | None = None, last_ids: dict[str, int] | None = None) -> int:
        """Write all tables, then the manifest that names them: all or nothing. Returns its number.

        `last_ids` are the largest ids that were given (`next_id`). Where chunks are replaced, their changes are in them.
        """
        base, now, replaced = self._manifests()[0], self._manifest(), dict(replaced or {})
        folds = "memory_chunks" in replaced and bool(now["tables"].get("chunk_events"))
        if folds and "embeddings" not in replaced:
            replaced["embeddings"] = self.read("embeddings")
        work = [*((name, df, True) for name, df in replaced.items()), *((name, df, False) for name, df in (appended or {}).items())]
        with ThreadPoolExecutor(max(1, len(work))) as pool:  # the jobs of several tables run side by side
            folders = list(pool.map(lambda w: self._write(*w[:2]), work))
        if self._manifests()[0] != base:
            if replaced or migrations or last_ids:
                raise RuntimeError("another writer has committed since this commit began")
            now = self._manifest()
        tables = dict(now["tables"]) | ({"chunk_events": []} if folds else {})
        for (name, _, whole), folder in zip(work, folders):
            tables[name] = [*([] if whole else tables.get(name, [])), folder]
        new = json.dumps({"tables": tables, "migrations": [*now["migrations"], *(migrations or [])], "last_ids": now.get("last_ids", {}) | (last_ids or {})})
        n = self._manifests()[1] + 1  # the folder of a commit that failed half-way is never written again
        self.spark.createDataFrame([(new,)], "value string").coalesce(1).write.text(f"{self.root}/manifests/{n}")
        return n

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def next_id(self, name: str) -> int:
        """The id after the last that the manifest says was given; where it says nothing, after the largest of the table."""
        now = self._manifest()
        last = now.get("last_ids", {}).get(name)
        return (last if last is not None else self._raw([name], now["tables"])[name].agg(F.max("id")).first()[0] or 0) + 1

    def fold(self) -> int:
        """Write chunks and vectors as their changes leave them; the log of changes begins anew."""
        tables = self.tables("memory_chunks", "embeddings")
        return self.commit(replaced=tables)

    def backup(self, target: str, at: datetime, keep_days: int = 30) -> str:
        """Copy all tables to a folder named by the time, then delete backups there that are older; returns the folder."""
        folder = f"{target.rstrip('/')}/{at:{STAMP}}"
        for name in self._manifest()["tables"]:
            self.read(name).write.parquet(f"{folder}/{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        oldest = f"{at - timedelta(days=keep_days):{STAMP}}"
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if re.fullmatch(r"\d{8}-\d{6}", name) and name < oldest:
                fs.delete(s.getPath(), True)
        return folder

    def migrate(self, steps: dict[str, dict[str, DataFrame]]) -> list[str]:
        """Apply the named steps that were not applied yet, in the order of their names."""
        done = set(self._manifest()["migrations"])
        new = [s for s in sorted(steps) if s not in done]
        for s in new:
            self.commit(replaced=steps[s], migrations=[s])
        return new
