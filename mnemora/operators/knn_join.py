"""The nearest stored vectors of many queries at once: blocks of queries times blocks of stored vectors.

A task scores each Arrow batch of stored vectors against all queries of a block by a matrix product and keeps, for each
query, the nearest rows so far; what the partitions keep, at most `limit` rows a query each, is merged by query. Queries
of a checked size go to the tasks as one broadcast block, and the stored vectors stay where they lie. More queries are
dealt into blocks and the stored rows into parts, and each pair of a block and a part is one task's tile.

Distances are rounded to twelve places and ties go by the `order` columns, so both ways give the same rows. A vector that
is null, zero, of another length or with a null inside has no distance and is no neighbour; a query without a usable
vector has none. A query's `project`, where it has one, is compared before the limit, with `project_name` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors of one block of queries, of one part of the stored vectors, and cells of one matrix product.
QUERY_BYTES, STORED_BYTES, CELLS = 32_000_000, 64_000_000, 2_000_000


def _unit(vectors: pa.Array, places: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length the rows of the usable vectors, and these vectors at length one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    out = []
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        m = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        m = m if places is None else np.round(m, places)
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        good = (norms > 0) & np.isfinite(norms)
        out.append((rows[good], m[good] / norms[good, None]))
    return out


class Queries:
    """One block of queries: their ids, projects, and unit vectors by length."""

    def __init__(self, table: pa.Table):
        self.ids, self.projects = table.column("q").combine_chunks(), np.array(table.column("project").to_pylist(), object)
        self.vectors = {m.shape[1]: (rows, m) for rows, m in _unit(table.column("embedding"), 7)}  # like their stored form


def _nearest_rows(distances: np.ndarray, limit: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the `limit` smallest of each column, ties by row; infinite ones are left out, and those beyond
    what is `known` to bound a column. Third, the bounds that follow for other rows."""
    k = min(limit, len(distances))
    bound = np.minimum(np.partition(distances, k - 1, axis=0)[k - 1] if k == limit else np.inf, known)
    near = (distances <= bound) & np.isfinite(distances)
    for c in np.flatnonzero(near.sum(axis=0) > k):  # ties at the bound
        first = np.flatnonzero(near[:, c])
        first = first[np.argsort(distances[first, c], kind="stable")[:k]]
        near[:, c] = False
        near[first, c] = True
    return *np.nonzero(near), bound


def _shortened(table: pa.Table, limit: int, order: Sequence[str]) -> pa.Table:
    """The first `limit` rows of each query by distance and the order columns."""
    table = table.sort_by([("at", "ascending"), ("distance", "ascending"), *((o, "ascending") for o in order)])
    at = table.column("at").to_numpy()
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
    return table.filter(pa.array(place < limit))


def _scored(queries: Queries, stored: pa.Table, limit: int, order: Sequence[str], known: np.ndarray | None = None, only: np.ndarray | None = None) -> pa.Table:
    """The nearest rows of `stored` for each query: its columns but the vector, `at` (the query's place), `distance`.

    `known` has by query a distance that `limit` rows are within; it is kept up to date, and rows beyond it are left out.
    `only` tells by query whether it asks at all.
    """
    stored = stored.sort_by([(o, "ascending") for o in order])
    carried = stored.drop_columns(["embedding"])
    known = np.full(len(queries.ids), np.inf) if known is None else known
    if "project_name" in carried.column_names:
        own, wanted, asks = np.array(carried.column("project_name").to_pylist(), object), queries.projects, np.not_equal(queries.projects, None).astype(bool)
        number = {p: k for k, p in enumerate({*wanted[asks]})}
        own, wanted = (np.array([number.get(p, -1) for p in x], np.int64) for x in (own, wanted))
    else:
        own = None
    parts = []
    for rows, m in _unit(stored.column("embedding")):
        if m.shape[1] not in queries.vectors or not len(rows):
            continue
        places, q = queries.vectors[m.shape[1]]
        if only is not None:
            places, q = places[only[places]], q[only[places]]
        step = max(1, CELLS // len(rows))
        for k in range(0, len(places), step):
            at = places[k : k + step]
            far = np.round(1 - m @ q[k : k + step].T, 12)
            if own is not None and asks[at].any():
                some = np.flatnonzero(asks[at])
                far[:, some] = np.where(own[rows][:, None] == wanted[at[some]], far[:, some], np.inf)
            r, c, known[at] = _nearest_rows(far, limit, known[at])
            parts.append(carried.take(pa.array(rows[r])).append_column("at", pa.array(at[c], pa.int64())).append_column("distance", pa.array(far[r, c], pa.float64())))
    if not parts:
        return carried.slice(0, 0).append_column("at", pa.array([], pa.int64())).append_column("distance", pa.array([], pa.float64()))
    return pa.concat_tables(parts)


class Nearest:
    """What one task has found of a block of queries: at most a few times `limit` rows a query."""

    def __init__(self, queries: Queries, limit: int, order: Sequence[str]):
        self.queries, self.limit, self.order = queries, limit, order
        self.known, self.kept, self.held = np.full(len(queries.ids), np.inf), None, 0

    def add(self, stored: pa.Table, only: np.ndarray | None = None) -> None:
        found = _scored(self.queries, stored, self.limit, self.order, self.known, only)
        self.kept = found if self.kept is None else pa.concat_tables([self.kept, found])
        if len(self.kept) > 4 * self.held + 100_000:
            self.kept = _shortened(self.kept, self.limit, self.order).combine_chunks()
            self.held = len(self.kept)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.kept is not None and len(self.kept):
            yield from _with_ids(_shortened(self.kept, self.limit, self.order), self.queries).to_batches(max_chunksize=10_000)


def _with_ids(table: pa.Table, queries: Queries) -> pa.Table:
    return table.append_column("q", queries.ids.take(table.column("at").combine_chunks())).drop_columns(["at"])


def knn_join(queries: DataFrame, stored: DataFrame, limit: int = 10, order: Sequence[str] = ("id",), query_bytes: int = QUERY_BYTES, stored_bytes: int = STORED_BYTES) -> DataFrame:
    """For each row of `queries` (`q`, `embedding`, perhaps `project`) its nearest rows of `stored`.

    Returns the columns of `stored` but `embedding`, and `q`, `distance` and `place` (from 1). Columns of `stored` named
    like these, or `at`, are not allowed. Repeated queries get the same rows each under one `q`, once.
    """
    if "project" not in queries.columns:
        queries = queries.withColumn("project", F.lit(None).cast("string"))
    queries = queries.select("q", "project", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["q"])
    carried = [c for c in stored.columns if c != "embedding"]
    stored = stored.select(*carried, F.col("embedding").cast("array<float>").alias("embedding"))
    kinds = ", ".join([*(f"{c} {stored.schema[c].dataType.simpleString()}" for c in carried), "distance double", f"q {queries.schema['q'].dataType.simpleString()}"])
    size = queries.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0))).first()[0]
    if size <= query_bytes:
        block = queries.sparkSession.sparkContext.broadcast(queries.toArrow())  # its size has just been checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(Queries(block.value), limit, order)
            for batch in batches:
                near.add(pa.Table.from_batches([batch]))
            yield from near.batches()

        near = stored.mapInArrow(run, kinds)
    else:
        blocks = -(-size // query_bytes)
        parts = max(1, -(-(stored.agg(F.coalesce(F.sum(F.size("embedding") * 4 + 64), F.lit(0))).first()[0]) // stored_bytes))
        tile = lambda block, part: (block * parts + part).alias("tile")
        left = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select("q", "project", "embedding", tile(F.pmod(F.xxhash64("q"), F.lit(blocks)), F.col("part")))
        right = stored.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(*carried, "embedding", tile(F.col("block"), F.pmod(F.xxhash64(*carried), F.lit(parts))))

        def tiles(some: pa.Table, rows: pa.Table) -> pa.Table:
            mine = Queries(some)
            found = _shortened(_scored(mine, rows.drop_columns(["tile"]), limit, order), limit, order)
            return _with_ids(found, mine).select([*carried, "distance", "q"])

        near = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(tiles, kinds)
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", *order))
    return near.withColumn("place", place).filter(F.col("place") <= limit)


def nearest_many(questions: DataFrame, sources: DataFrame, limit: int = 10, **sizes: int) -> DataFrame:
    """The closest sources of each question (`q`, `embedding`, perhaps `scope` and `project`).

    `sources` are vectors with the project and category of what they belong to (`retrieval.sources_of`). As for a single
    question a project filters before the limit, a scope after it.
    """
    found = knn_join(questions, sources, limit, ("source_type", "source_id"), **sizes)
    if "scope" not in questions.columns:
        return found
    scopes = questions.select("q", "scope").filter("scope IS NOT NULL").dropDuplicates(["q"])
    return found.join(scopes, "q", "left").filter("scope IS NULL OR scope = source_type").drop("scope")


def search_memory_many(questions: DataFrame, embeddings: DataFrame, chunks: DataFrame, least: float = 0.70, limit: int = 10, source_type: str | None = None, **sizes: int) -> DataFrame:
    """`retrieval.search_memory` for many questions (`q`, `embedding`, perhaps `project`): its columns, and `q` and `place`."""
    vectors = embeddings.filter(F.col("source_type") == source_type) if source_type else embeddings
    own = chunks.select(F.col("id").alias("source_id"), "project_name", "category").withColumn("source_type", F.lit("memory_chunk"))
    stored = vectors.select("id", "source_type", "source_id", "embedding").join(own, ["source_type", "source_id"], "left")
    found = knn_join(questions, stored, limit, **sizes).withColumn("similarity", 1 - F.col("distance"))
    return found.filter(F.col("similarity") > least).select("q", "place", "id", "source_type", "source_id", "project_name", "category", "similarity")
