"""A nearest-neighbour index over tables: coarse cells by k-means, residual codes, probing, exact scores of the candidates.

For each model and length of vectors, unit vectors fall into cells. The centres are fitted on a bounded sample by rounds
of a distributed k-means; every row is then placed in the cell of the centre that is nearest to it, with its residual as
one byte a dimension. The cells are Parquet partitions, so a search reads the codes of the few cells whose centres are
nearest to the query, and then the vectors of the best candidates by these codes. Scores are exact; only which rows are
looked at depends on the number of cells read. Building finds out how many are needed: for some sampled vectors, where
among the cells by nearness those of their true neighbours in the sample lie; as many are read as hold the share `TARGET`
of these, unless a search names its own `probes`. A search that finds too few doubles its probes until all cells are read, so a filter never
loses rows that are there.

Added rows go to the same cells in a new batch; deleted ones leave a mark with the number of the batch that deletes them,
which counts for older batches only. `compact` folds both. Batches are numbered folders, and one that has no `_SUCCESS`
is not read.

Defined cases: vectors that are null, empty, zero, or hold a null or a number that is not finite are not neighbours and
get no place; vectors of one table may have several models and lengths; ties go by the key columns; repeated rows are
rows of their own; many equal vectors share a cell, whose files are split; an empty table makes an index without cells,
which finds nothing until it is built again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .knn_join import QUERY_BYTES, Nearest, Queries, _scored, _shortened, _unit, _with_ids, knn_join
from .retrieval import distances

#: What stands for a null model.
NO_MODEL = "none"
#: Rows of the sample for each model and length, rounds of k-means, and the most cells.
SAMPLE, ROUNDS, MOST_CELLS = 50_000, 8, 4096
#: Sampled queries that find out how many cells to read, their neighbours, and the share of these that must be read.
TRIED, NEIGHBOURS, TARGET = 100, 10, 0.95
#: Candidates by the codes whose vectors are read, for each wanted row.
WIDER = 8
#: Pairs of a query and a cell that a task holds at once.
PAIRS = 50_000


def _placed(df: DataFrame, centres: dict[tuple[str, int], np.ndarray], keys: Sequence[str]) -> DataFrame:
    """`keys`, `model`, `embedding`, and of usable vectors `size`, `cell`, and the residual from its centre as `code` times `scale`."""
    held = df.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS centres a model and length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(len(keys)).to_pylist(), object)
            for rows, m in _unit(batch.column(len(keys) + 1)):
                for model in set(models[rows]):
                    own = np.flatnonzero(models[rows] == model)
                    if (found := held.value.get((model, m.shape[1]))) is None:
                        continue
                    cell = _nearest(m[own], found)
                    rest = m[own] - found[cell]
                    scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
                    code = np.rint(rest / scale[:, None]).astype(np.int8)
                    taken = batch.take(pa.array(rows[own]))
                    width = m.shape[1]
                    codes = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(code.tobytes())])
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(own), width, np.int32)), pa.array(cell.astype(np.int32)), codes, pa.array(scale)], names=[*keys, "model", "embedding", "size", "cell", "code", "scale"])

    ddl = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "model string, embedding array<float>, size int, cell int, code binary, scale double"])
    return df.select(*keys, F.coalesce("model", F.lit(NO_MODEL)).alias("model"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, ddl)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centre of each vector, in slices of a bounded size."""
    half, step = (centres * centres).sum(axis=1) / 2, max(1, 4_000_000 // len(centres))
    return np.concatenate([(vectors[k : k + step] @ centres.T - half).argmax(axis=1) for k in range(0, len(vectors), step)])


def _order(centres: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """By query (a unit vector) the cells from the nearest to the farthest."""
    return np.argsort((centres * centres).sum(axis=1) / 2 - queries @ centres.T, axis=-1, kind="stable")


def needed_probes(chosen: DataFrame, centres: np.ndarray) -> int:
    """Cells to read so that the share `TARGET` of the true neighbours of `TRIED` sampled vectors lies in them."""
    tried = chosen.orderBy(F.xxhash64("hash", F.lit(1))).limit(TRIED).select(F.col("hash").alias("q"), "embedding")
    near = knn_join(tried, chosen.withColumn("vector", F.col("embedding")).withColumnRenamed("hash", "id"), NEIGHBOURS + 1).filter("id != q")
    pairs = near.join(tried, "q").select(F.col("embedding").cast("array<float>"), F.col("vector").cast("array<float>")).toArrow()  # TRIED * NEIGHBOURS rows
    if not len(pairs):
        return len(centres)
    (_, q), (_, v) = _unit(pairs.column(0))[0], _unit(pairs.column(1))[0]
    place = np.argsort(_order(centres, q), axis=1)[np.arange(len(q)), _nearest(v, centres)]
    return int(np.quantile(place, TARGET, method="higher")) + 1


def fit_centres(vectors: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, cells: int | None = None) -> tuple[dict[tuple[str, int], np.ndarray], dict[tuple[str, int], int]]:
    """By model and length the centres and the probes that are needed, of a sample by hash of about `sample` rows each at
    most. Sums of a round are added map-side."""
    rows = vectors.select(F.coalesce("model", F.lit(NO_MODEL)).alias("model"), F.size("embedding").alias("size"), "embedding").filter("size > 0")
    out: dict[tuple[str, int], np.ndarray] = {}
    probes: dict[tuple[str, int], int] = {}
    for r in rows.groupBy("model", "size").count().orderBy("model", "size").collect():
        own = rows.filter((F.col("model") == r["model"]) & (F.col("size") == r["size"])).select(F.col("embedding").cast("array<float>").alias("embedding"), F.xxhash64("embedding").alias("hash"))
        share = min(1.0, sample / r["count"])
        chosen = written(own.filter(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["hash"]).select("hash", "embedding"))
        wanted = cells or max(1, min(MOST_CELLS, round(2 * r["count"] ** 0.5), chosen.count() // 4))
        first = [m for _, m in _unit(chosen.orderBy(F.xxhash64("hash")).limit(wanted).select("embedding").toArrow().column(0))]
        if not first:
            continue
        centres = first[0]
        for _ in range(rounds):
            held = rows.sparkSession.sparkContext.broadcast(centres)

            def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                total, n = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
                for batch in batches:
                    for _, m in _unit(batch.column(0)):
                        cell = _nearest(m, held.value)
                        np.add.at(total, cell, m)
                        n += np.bincount(cell, minlength=len(n))
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

            parts = chosen.select("embedding").mapInArrow(sums, "cell int, n long, total array<double>")
            flat = parts.select("cell", "n", F.posexplode("total").alias("k", "x")).groupBy("cell", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
            new = centres.copy()
            for c in flat.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("x"), F.max("n").alias("n")).collect():  # at most MOST_CELLS
                new[c["cell"]] = np.array(c["x"]) / c["n"]
            if np.allclose(new, centres, atol=1e-6):
                break
            centres = new
        key = r["model"], r["size"]
        out[key], probes[key] = centres, needed_probes(chosen, centres)
    return out, probes


#: Columns that name a row, and their types.
KEYS = {"source_type": "string", "source_id": "long"}
CENTRES = "model string, size int, cell int, centre array<double>, probes int"


class VectorIndex:
    """The index below one folder that all nodes share. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, kinds: Mapping[str, str] = KEYS):
        self.spark, self.root, self.keys, self.probes = spark, root.rstrip("/"), tuple(kinds), {}
        self.kinds = ", ".join(f"{k} {t}" for k, t in kinds.items())

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete batches of a kind."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{n}/_SUCCESS")))

    def _number(self) -> int:
        return max([0, *self._folders("cells"), *self._folders("deleted"), *self._folders("centres")]) + 1

    @functools.cached_property
    def centres(self) -> dict[tuple[str, int], np.ndarray]:
        if not (built := self._folders("centres")):
            raise LookupError(f"no index at {self.root}")
        rows = self.spark.read.schema(CENTRES).parquet(f"{self.root}/centres/{built[-1]}").orderBy("model", "size", "cell").collect()
        out: dict[tuple[str, int], list] = {}
        for r in rows:
            out.setdefault((r.model, r["size"]), []).append(r.centre)
            self.probes[r.model, r["size"]] = r.probes
        return {k: np.array(v) for k, v in out.items()}

    def _keep_centres(self, fitted: dict, probes: dict, n: int) -> None:
        rows = [(model, size, k, c.tolist(), probes[model, size]) for (model, size), m in fitted.items() for k, c in enumerate(m)]
        self.spark.createDataFrame(rows, CENTRES).coalesce(1).write.parquet(f"{self.root}/centres/{n}")

    def build(self, vectors: DataFrame, sample: int = SAMPLE, cells: int | None = None) -> VectorIndex:
        """Fit the centres and place every row (`keys`, `model`, `embedding`); what was there before is no longer read."""
        fitted, probes = fit_centres(vectors, sample, cells=cells)
        n = self._number()
        self._write(vectors, fitted, n)
        self._keep_centres(fitted, probes, n)
        self.__dict__.pop("centres", None)
        return self

    def add(self, vectors: DataFrame) -> None:
        """Place more rows; those of a model or length that the index has no centres for raise, as they could not be found."""
        known = [F.struct(F.lit(m), F.lit(s)) for m, s in self.centres]
        fits = F.struct(F.coalesce("model", F.lit(NO_MODEL)), F.size("embedding")).isin(*known) if known else F.lit(False)
        if not vectors.filter("size(embedding) > 0").filter(~fits).isEmpty():
            raise ValueError("vectors of a model or length that is not in the index: build it again")
        self._write(vectors, self.centres, self._number())

    def delete(self, keys: DataFrame) -> None:
        """Take the rows with these keys out."""
        keys.select(*self.keys).distinct().write.parquet(f"{self.root}/deleted/{self._number()}")

    def compact(self) -> None:
        """Write the living rows as one batch; the centres stay."""
        n, fitted = self._number(), self.centres
        live = self._live(self._rows()).select(*self.keys, "model", "embedding")
        self._write(live, fitted, n)
        self._keep_centres(fitted, self.probes, n)

    def _write(self, vectors: DataFrame, fitted: dict, n: int) -> None:
        # a cell's rows meet in a few tasks, also where one vector is most of the table, and lie by key
        placed = _placed(vectors, fitted, self.keys).hint("rebalance", "model", "size", "cell")
        placed.sortWithinPartitions("model", "size", "cell", *self.keys).write.partitionBy("model", "size", "cell").parquet(f"{self.root}/cells/{n}")

    def _rows(self) -> DataFrame:
        first = (self._folders("centres") or [0])[-1]
        batches = [n for n in self._folders("cells") if n >= first]
        schema = f"{self.kinds}, embedding array<float>, code binary, scale double, model string, size int, cell int"
        return functools.reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.root}/cells/{n}").withColumn("batch", F.lit(n)) for n in batches))

    def _live(self, rows: DataFrame) -> DataFrame:
        first = (self._folders("centres") or [0])[-1]
        gone = [n for n in self._folders("deleted") if n > first]
        if not gone:
            return rows
        marks = functools.reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/deleted/{n}").withColumn("until", F.lit(n)) for n in gone))
        marks = marks.groupBy(*self.keys).agg(F.max("until").alias("until"))
        same = functools.reduce(lambda a, b: a & b, (rows[k].eqNullSafe(marks[k]) for k in self.keys))
        return rows.join(marks, same & (rows["batch"] < marks["until"]), "left_anti")

    def search(self, query: Sequence[float], limit: int = 10, model: str = NO_MODEL, probes: int | None = None, where=None) -> DataFrame:
        """The nearest rows: `keys` and `distance`, exact. `where` takes the candidates' keys as a table and leaves some, as a filter before the limit."""
        q = np.round(np.asarray(query, np.float64), 7)
        nothing = self.spark.createDataFrame([], f"{self.kinds}, distance double")
        centres = self.centres.get((model, len(q)))
        if centres is None or not np.isfinite(q).all() or not q.any():
            return nothing
        q = q / np.sqrt(q @ q)
        near, probes = _order(centres, q), probes or self.probes[model, len(q)]
        rows = self._rows().filter((F.col("model") == model) & (F.col("size") == len(q)))
        while True:
            cells = near[:probes]
            at = dict(zip(cells.tolist(), (centres[cells] @ q).tolist()))
            mine = self._live(rows.filter(F.col("cell").isin([int(c) for c in cells])))
            mine = where(mine) if where else mine
            rough = written(_rough(mine, q, at, self.keys).orderBy("rough", *self.keys).limit(WIDER * limit))
            if rough.count() >= limit or len(cells) == len(near):
                break
            probes *= 2
        exact = mine.join(F.broadcast(rough.drop("rough")), [*self.keys, "batch", "cell"], "left_semi").select(*self.keys, "embedding")
        return distances(exact, query).orderBy("distance", *self.keys).limit(limit)


def _rough(rows: DataFrame, q: np.ndarray, at: dict[int, float], keys: Sequence[str]) -> DataFrame:
    """`keys`, `batch`, `cell`, and the distance by the code alone: the vectors are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column(len(keys) + 2).to_pylist()), np.int8).reshape(batch.num_rows, len(q))
                centre = np.array([at[c] for c in batch.column(len(keys) + 1).to_pylist()])
                far = 1 - centre - (code @ q) * batch.column(len(keys) + 3).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 2], pa.array(far)], names=[*keys, "batch", "cell", "rough"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "batch", "cell", "code", "scale").mapInArrow(run, f"{kinds}, batch int, cell int, rough double")


def recall(index: VectorIndex, queries: DataFrame, exact: DataFrame, limit: int = 10, model: str = NO_MODEL, probes: int | None = None) -> float:
    """Share of the exact neighbours (`q`, `keys`) of a stated query set (`q`, `embedding`) that the index finds.

    The queries are read in one job: each reads its nearest cells, and only rows there are scored.
    """
    found = search_many(index, queries, limit, model, probes).select("q", *index.keys)
    wanted = written(exact.select("q", *index.keys).distinct())
    return wanted.join(found.distinct(), ["q", *index.keys]).count() / max(1, wanted.count())


def search_many(index: VectorIndex, queries: DataFrame, limit: int = 10, model: str = NO_MODEL, probes: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The nearest rows of many queries (`q`, `embedding`): `keys`, `q`, `distance`, `place`.

    Each query knows how far its last cell is. Queries of a checked size go to the rows, which stay where they lie, as one
    broadcast block; a task scores its rows of a cell against the queries that reach it. More queries meet the rows by
    cell, in blocks of queries and pieces of a bounded number of rows, so a hot cell is many tasks.
    """
    keys, centres = index.keys, {s: c for (m, s), c in index.centres.items() if m == model}
    held, read = index.spark.sparkContext.broadcast(centres), {s: probes or index.probes[model, s] for s in centres}

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in _unit(batch.column(1), 7):
                if (c := held.value.get(m.shape[1])) is not None and len(rows):
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(_reach(c, m, read[m.shape[1]]))], names=["q", "embedding", "reach"])

    kind = queries.schema["q"].dataType.simpleString()
    asked = written(queries.select("q", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["q"]).mapInArrow(reaching, f"q {kind}, embedding array<double>, reach double"))
    live = index._live(index._rows()).filter(F.col("model") == model).select(*keys, "embedding", "size", "cell")
    kinds = ", ".join([*(f"{k} {live.schema[k].dataType.simpleString()}" for k in keys), "distance double", f"q {kind}"])
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0))).first()[0]
    if size <= query_bytes:
        block = index.spark.sparkContext.broadcast(asked.toArrow())  # its size has just been checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, reach = _block(block.value)
            near = Nearest(mine, limit, keys)
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                length, cell = (whole.column(c).to_numpy() for c in ("size", "cell"))
                rows = whole.select([*keys, "embedding"])
                for d in np.unique(length):
                    if d in mine.vectors and read[d] >= len(held.value[d]):
                        near.add(rows.filter(pa.array(length == d)))
                        continue
                    for c in np.unique(cell[length == d]) if d in mine.vectors else ():
                        near.add(rows.filter(pa.array((length == d) & (cell == c))), _reached(mine, reach, held.value[d][c]))
            yield from near.batches()

        near = live.mapInArrow(run, kinds)
    else:
        blocks = -(-size // query_bytes)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine, reach = _block(pa.Table.from_batches([batch]))
                for d, (places, m) in mine.vectors.items():
                    c = held.value[d]
                    step = max(1, PAIRS // len(c))
                    for k in range(0, len(places), step):
                        at, cell = np.nonzero(_far(c, m[k : k + step]) <= reach[places[k : k + step], None])
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places[k + at])).columns[:2], pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32))], names=["q", "embedding", "size", "cell"])

        of = F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        counts = live.groupBy("size", "cell").agg(F.count("*").alias("n"))
        pieces = written(counts.withColumn("pieces", F.ceil(F.col("n") / 50_000)))
        left = asked.mapInArrow(probed, f"q {kind}, embedding array<double>, size int, cell int").join(F.broadcast(pieces), ["size", "cell"]).select("q", "embedding", "size", "cell", of, spread(F.col("pieces")).alias("piece"))
        right = live.join(F.broadcast(pieces), ["size", "cell"]).select(*keys, "embedding", "size", "cell", F.pmod(F.xxhash64(*keys), F.col("pieces")).alias("piece"), spread(F.lit(blocks)).alias("block"))

        def scored(some: pa.Table, rows: pa.Table) -> pa.Table:
            mine = Queries(some.append_column("project", pa.nulls(len(some), pa.string())))
            found = _scored(mine, rows.select([*keys, "embedding"]), limit, keys)
            return _with_ids(_shortened(found, limit, keys), mine).select([*keys, "distance", "q"])

        group = ("size", "cell", "piece", "block")
        near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(scored, kinds)
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", *keys))
    return near.withColumn("place", place).filter(F.col("place") <= limit)


def _far(centres: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """By query (a unit vector) and cell what grows with the distance from the cell's centre."""
    return (centres * centres).sum(axis=1) / 2 - queries @ centres.T


def _reach(centres: np.ndarray, queries: np.ndarray, probes: int) -> np.ndarray:
    """How far the last of the nearest `probes` cells of each query is, a little more for rounding; in slices of a bounded size."""
    if probes >= len(centres):
        return np.full(len(queries), np.inf)
    step = max(1, PAIRS // len(centres))
    return np.concatenate([np.partition(_far(centres, queries[k : k + step]), probes - 1, axis=1)[:, probes - 1].copy() for k in range(0, len(queries), step)]) + 1e-9


def _block(asked: pa.Table) -> tuple[Queries, np.ndarray]:
    return Queries(asked.append_column("project", pa.nulls(len(asked), pa.string()))), asked.column("reach").to_numpy()


def _reached(queries: Queries, reach: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Which queries of a block read a cell."""
    out = np.zeros(len(reach), bool)
    places, m = queries.vectors[len(centre)]
    out[places] = _far(centre[None, :], m)[:, 0] <= reach[places]
    return out
