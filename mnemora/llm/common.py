"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir
from ..shared import written as materialise

__all__ = ["WHITE", "free_name", "give_back", "join_hot", "map_batches", "map_text", "materialise", "shared_dir", "text_of"]

#: The white space of the text contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one stage leaves unused counts in the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, done: Callable[[], None] | None = None) -> DataFrame:
    """`fn` over the Arrow batches of `df`, partition by partition; `done` drops what a partition has remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows and (out := fn(batch)) is not None:
                    yield out
                    del out
        finally:
            if done:
                done()
            give_back()

    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, text: str, keep: Sequence[str], fn: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, str]], done: Callable[[], None] | None = None) -> DataFrame:
    """The columns `keep`, then those that `fn` makes of a batch of texts (null as empty): `fields` are their names and types.

    Results get underscores before their names until these are free; the kept columns may have any names.
    """
    own = [f"c{i}" for i in range(len(keep))]
    made = [f"r{i}" for i in range(len(fields))]
    rows = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)), text_of(f"`{text}`").alias("said"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *fn(batch.column(len(own)))], names=[*own, *made])

    kept = [f"{o} {rows.schema[o].dataType.simpleString()}" for o in own]
    out = map_batches(rows, run, ", ".join([*kept, *(f"{m} {t}" for m, (_, t) in zip(made, fields))]), done)
    named = df.select(*(F.col(f"`{c}`") for c in keep))
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, keep)), *(F.col(m).alias(free_name(named, n)) for m, (n, _) in zip(made, fields)))


def join_hot(df: DataFrame, side: DataFrame, key: str, rows: str, hot: int = 10_000, most: int = 100_000) -> DataFrame:
    """Left join of `df` with `side`, which has one row a key and the number `rows` of rows that it meets in `df`.

    A side of at most `most` keys is taken to the rows whole. Of a larger one this holds for the keys that meet more
    than `hot` rows, as one key may meet a third of all, and if these are more than `most`, for those of most rows; all
    other rows are dealt by key. `side` is read several times; its columns must not be columns of `df`.
    """
    names = [c for c in side.columns if c not in (key, rows)]

    def bound():
        over = F.when(F.col(rows) > hot, F.col(rows))
        return side.agg(F.count("*").alias("keys"), F.count(over).alias("n"), F.approx_percentile(over, F.lit(0.5)).alias("middle")).first()

    found = bound()
    if found.keys <= most:
        return df.join(F.broadcast(side.drop(rows)), key, "left")
    while found.n > most:
        hot = int(found.middle)
        found = bound()
    if not found.n:
        return df.join(side.drop(rows), key, "left")
    few = side.filter(F.col(rows) > hot).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    rest = side.filter(F.col(rows) <= hot).select(F.col(key).alias("_rest_key"), F.struct(*names).alias("_rest"))
    met = df.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left")
    cold = met.filter("_hot IS NULL").join(rest, F.col(key) == F.col("_rest_key"), "left").select(*df.columns, *(F.col(f"_rest.{c}").alias(c) for c in names))
    return met.filter("_hot IS NOT NULL").select(*df.columns, *(F.col(f"_hot.{c}").alias(c) for c in names)).unionByName(cold)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
