"""Postings of trigrams: substring and similarity searches read the postings of a few rare trigrams and the rows they name.

Two sets of trigrams are kept of each text: all windows of three characters in lower case, for ILIKE '%term%', and those
of its padded words, for trigram similarity. A task gathers the keys of each trigram of some texts in a list, so that lists
are dealt, not single postings. They lie in Parquet partitions by a checksum of the trigram, sorted by
it, so a search reads the row groups of its trigrams. Common trigrams are dealt over several tasks and files by a salt
that follows from their count.

A term's rows hold all its windows, so the postings of the `RAREST` of these bound them. A row that is more similar than
`least` shares more than that part of the term's trigrams, so it is among the postings of the rarest of them, all but
those that it may lack. Candidates are then verified on the rows themselves: the rows are the truth, and postings of rows
that are gone or have changed since name candidates that fail. New and changed rows are added as another batch.

Defined cases: a null text has no trigrams and no hit; a term without three characters in a row between its wildcards
(`%` and `_` keep their meaning) is searched by a scan; a term without words is similar to nothing; repeated rows and keys
are each found; an empty table makes an index that finds nothing.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity, trigrams
from ..plans.reports import active, all_of, like
from ..shared import written

#: Partitions of the postings; postings of one file of a common trigram; windows of a term whose postings are read.
BUCKETS, FILE_ROWS, RAREST = 128, 1_000_000, 4
#: Candidates whose keys are named in the scan of the rows; more are joined.
NAMED = 1_000
#: Characters of the texts whose postings a task gathers at once.
CHARS = 2_000_000
WINDOW, WORD = "window", "word"


def padded(text: Column) -> Column:
    """A text whose windows are the trigrams of its words, but for those with a space in the second and third place."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))


def _lists(texts: list[str], words: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct windows of three characters of some texts, where the list of each begins and ends, and the lists: places of the texts."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    good = at[:-2] == at[2:]
    if words:
        good &= (c[1:-1] != 32) | (c[2:] != 32)
    c, at = c.astype(np.int64), at[:-2][good]
    grams, number = np.unique((c[:-2] | c[1:-1] << 21 | c[2:] << 42)[good], return_inverse=True)
    pairs = np.unique(number * len(texts) + at)
    number, at = pairs // max(1, len(texts)), pairs % max(1, len(texts))
    said = np.stack([grams >> k & 0x1FFFFF for k in (0, 21, 42)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [said[k : k + 3] for k in range(0, len(said), 3)], np.searchsorted(number, np.arange(len(grams) + 1)), at


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `CHARS` characters together, or one text, and at most `most` texts."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and (total + n > CHARS or k - start >= most):
            yield start, k
            start, total = k, 0
        total += n
    if lengths:
        yield start, len(lengths)


def posting_lists(rows: DataFrame, most: int) -> DataFrame:
    """`set`, `gram` and `keys` of rows with `key`, `low` and `padded`: a list for each slice of the rows, not a row for each posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.add(*(pc.fill_null(pc.utf8_length(batch.column(k)), 0) for k in (1, 2))).to_pylist()
            for start, end in _slices(lengths, most):
                part = batch.slice(start, end - start)
                for kind, k in ((WINDOW, 1), (WORD, 2)):
                    grams, ends, at = _lists(pc.fill_null(part.column(k), "").to_pylist(), kind == WORD)
                    keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part.column(0).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(grams), pa.string()), pa.array(grams, pa.string()), keys], names=["set", "gram", "keys"])

    return rows.select("key", "low", "padded").mapInArrow(run, f"set string, gram string, keys array<{rows.schema['key'].dataType.simpleString()}>")


def term_windows(term: str) -> list[str]:
    """The windows that every text with a term holds; wildcards part it."""
    pieces = re.split(r"(?:\\.|[%_])+", term.lower(), flags=re.S)
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


class TrigramIndex:
    """The postings of one text column below a folder that all nodes share. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, column: str, key: str = "id", kind: str = "long"):
        self.spark, self.root, self.column, self.key, self.kind = spark, root.rstrip("/"), column, key, kind

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/postings")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/postings/{n}/_SUCCESS")))

    def add(self, rows: DataFrame) -> TrigramIndex:
        """Postings of more rows, as a batch of their own."""
        n = max([0, *self._batches()]) + 1
        text = F.col(f"`{self.column}`").cast("string")
        own = rows.select(F.col(f"`{self.key}`").cast(self.kind).alias("key"), F.lower(text).alias("low"), padded(text).alias("padded"))
        found = posting_lists(own, FILE_ROWS).withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)).cast("int"))
        found = written(found)  # the texts are gone through once
        counts = written(found.groupBy("bucket", "set", "gram").agg(F.sum(F.size("keys").cast("long")).alias("n")))
        counts.sort("bucket", "set", "gram").write.partitionBy("bucket").parquet(f"{self.root}/counts/{n}")
        common = counts.filter(F.col("n") > FILE_ROWS).select("set", "gram", F.ceil(F.col("n") / FILE_ROWS).alias("files"))  # at most one for FILE_ROWS postings
        salted = found.join(F.broadcast(common), ["set", "gram"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("keys"), F.col("files")), F.lit(0)))
        dealt = salted.repartition("bucket", F.when(F.col("files").isNotNull(), F.struct("set", "gram", "salt")))
        dealt.sortWithinPartitions("bucket", "set", "gram").select("bucket", "set", "gram", "keys").write.partitionBy("bucket").parquet(f"{self.root}/postings/{n}")
        return self

    build = add

    def _read(self, what: str, kind: str, grams: list[str], columns: str) -> DataFrame:
        """Rows of the given trigrams: only their partitions, and in these the row groups that may hold them."""
        stored = f"keys array<{self.kind}>" if what == "postings" else columns
        parts = [self.spark.read.schema(f"set string, gram string, {stored}, bucket int").parquet(f"{self.root}/{what}/{n}") for n in self._batches()]
        every = functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"set string, gram string, {stored}, bucket int")
        mine = every.filter(F.col("bucket").isin(sorted({_bucket(g) for g in grams})) & (F.col("set") == kind) & F.col("gram").isin(grams))
        return mine.select("set", "gram", F.explode("keys").alias("key"), "bucket") if what == "postings" else mine

    def _rarest(self, kind: str, grams: list[str], most: int) -> list[str] | None:
        """The `most` rarest trigrams of a term, rarest first; None if one of all occurs nowhere."""
        n = {r.gram: r.n for r in self._read("counts", kind, grams, "n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if kind == WINDOW and len(n) < len(grams):
            return None
        return sorted(grams, key=lambda g: (n.get(g, 0), g))[:most]

    def holding(self, term: str) -> DataFrame | None:
        """Keys of the rows that may hold a term; None where a scan must tell."""
        grams = term_windows(term)
        if not grams:
            return None
        rare = self._rarest(WINDOW, grams, RAREST)
        if rare is None:
            return self._read("postings", WINDOW, grams[:1], f"key {self.kind}").limit(0).select("key")
        keys = self._read("postings", WINDOW, rare, f"key {self.kind}").groupBy("key").agg(F.count_distinct("gram").alias("n"))
        return keys.filter(F.col("n") == len(rare)).select("key")

    def similar(self, term: str, least: float) -> DataFrame:
        """Keys of the rows whose trigram similarity with a term may be over `least`."""
        grams = self.spark.range(1).select(trigrams(F.lit(term)).alias("g")).first().g
        need = int(least * len(grams)) + 1  # trigrams that such a row shares at least
        rare = self._rarest(WORD, list(grams), max(0, len(grams) - need + 1))
        return self._read("postings", WORD, rare, f"key {self.kind}").select("key").distinct()

    def of(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows with these keys; few keys are named in the scan, so that row groups without them are not read."""
        keys = written(keys.distinct())
        few = [r.key for r in keys.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return rows.filter(F.col(f"`{self.key}`").isin(few))
        return rows.join(keys.withColumnRenamed("key", "_key"), rows[self.key] == F.col("_key"), "left_semi")


def rows_like(rows: DataFrame, index: TrigramIndex, term: str) -> DataFrame:
    """The rows whose indexed column holds a term in any case, as by a scan."""
    keys = index.holding(term)
    return (rows if keys is None else index.of(rows, keys)).filter(like(index.column, term))


def search_chunks(chunks: DataFrame, index: TrigramIndex, term: str, limit: int = 20, only_active: bool = True) -> DataFrame:
    """As `reports.search_chunks`: texts by the index, tags and projects by a scan of these columns alone."""
    narrow = [c for c in chunks.columns if c != index.column]
    shown = chunks.select(*narrow)
    by_text = rows_like(chunks, index, term).select(F.col(index.key).alias("hit"))
    by_name = shown.filter(F.array_contains("tags", term) | like("project_name", term)).select(F.col(index.key).alias("hit"))
    hits = by_text.unionByName(by_name)
    found = shown.join(hits, F.col(index.key) == F.col("hit"), "left_semi").filter(all_of(active() if only_active else None))
    return found.orderBy(F.desc_nulls_first("confidence"), F.desc_nulls_first("created_at"), "id").limit(limit).select("id", "category", "confidence", "created_at")


def trigram_search(rows: DataFrame, index: TrigramIndex, term: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    """As `retrieval.trigram_search`, over the candidates alone."""
    found = index.of(rows, index.similar(term, least)).withColumn("similarity", trigram_similarity(F.col(index.column), F.lit(term))).filter(F.col("similarity") > least)
    return found.orderBy(F.desc("similarity"), index.key).limit(limit).select(index.key, index.column, F.round("similarity", 6).alias("similarity"))
