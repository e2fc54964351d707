"""A pruned walk of a folder tree through Hadoop's file system, level by level: what is pruned is never listed.

The folders of a level are listed side by side, as Spark's own file index does it; only names come to the driver, and the
files that are found are read by Spark. Works on any file system that the session knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Folders that the prompt scan does not enter, and how deep it looks (a file in the root is at depth 1).
PRUNED = frozenset(("node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", ".next", ".cache", "CloudStorage"))
DEEPEST = 5
Entry = tuple[str, str, bool]
FILES = "path string, modificationTime timestamp, length long, content binary"


def folder_entries(spark: SparkSession, folder: str) -> list[Entry]:
    """Name, path and whether it is a folder, of all entries of a folder; none where it is not there or may not be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    except Py4JJavaError:
        return []
    return [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in found]


def files_named(spark: SparkSession, roots: Iterable[str], name: str, deepest: int = DEEPEST, pruned: frozenset[str] = PRUNED, entries: Callable[[SparkSession, str], list[Entry]] = folder_entries) -> list[str]:
    """Paths of the files of a name at most `deepest` levels below a root; a root's own name is not pruned. Sorted, each once."""
    level, found, seen = list(dict.fromkeys(roots)), set(), set()
    with ThreadPoolExecutor(16) as pool:
        for depth in range(1, deepest + 1):
            below = []
            for listed in pool.map(lambda f: entries(spark, f), level):
                found |= {path for n, path, folder in listed if not folder and n == name}
                below += [path for n, path, folder in listed if folder and n not in pruned and depth < deepest]
            # roots may lie in each other: the nearer root lists a folder with more levels left, so it is kept
            level = [f for f in dict.fromkeys(below) if f not in seen]
            seen |= set(level)
    return sorted(found)


def read_named(spark: SparkSession, roots: Iterable[str], name: str, deepest: int = DEEPEST, pruned: frozenset[str] = PRUNED) -> DataFrame:
    """The files that `files_named` finds, with their bytes; no rows if there are none."""
    paths = files_named(spark, roots, name, deepest, pruned)
    return spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], FILES)
