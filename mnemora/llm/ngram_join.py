"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Texts are sets of hashed word n-grams. Documents with equal sets are one class from the start. Two bounds that
follow from set sizes discard classes and pairs before any product: a class with more n-grams of its own than
its size lets it miss has no partner, and partners share an n-gram among the rarest of each, its prefix. N-grams are
counted for the first bound by parts, the second part for what the first has left, and go to their bins in lists, see
`_dealt`; they are not written between. Classes that prefix n-grams connect make a group. A small group is one block, multiplied with itself. In a larger one the classes
with the same prefix n-gram and about the same size make blocks, bound in classes and in n-grams, the few that lack
the n-gram of most others make blocks together, and only blocks
that share a prefix n-gram and whose sizes allow a link meet: a long chain of groups costs in proportion to its
length. Each tile, a pair of blocks, accumulates overlap counts by matrix products, drops pairs outside the bounds
of their sizes, and returns counts of links and a spanning forest.

N-grams and sets are known by 64-bit hashes; two different sets of one corpus of d classes share one with a
chance of about d^2 / 2^65. Nothing is capped: a dense group of g near copies, whose links are g^2 / 2, costs as many
cells of products, spread over (g / BLOCK)^2 / 2 tiles.

Defined cases: a null or blank text has an empty set, which links with nothing; a text of fewer words than n is
one n-gram; rows that repeat a document link like any copies; rows without an id join components and take the
smallest id there, null if there is none; an empty table gives an empty table; columns but id and text are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_hot, map_batches, materialise, text_of
from .graphs import components

WORDS, PERCENT = 4, 85
#: Classes, and n-grams, of one block; a larger set is a block by itself. A tile holds two blocks.
BLOCK, BLOCK_GRAMS = 1024, 1_000_000
#: The first bound counts two parts of the n-gram hashes, each one in so many.
ONE_IN = 4
#: N-grams of a bin of the first bound, about; texts whose n-grams are dealt together.
BIN_GRAMS, DEAL_ROWS = 2_000_000, 16_384
#: Counts of one class in one bin that are summed together, about.
SHARE_ROWS = 500_000
#: N-grams of more members than this are multiplied as dense columns.
DENSE = 12
#: Ids that are broadcast at most (32 MB with the hashes of their texts); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Word hashes that a task remembers before it starts afresh.
MEMO = 400_000
#: Odd multipliers of the n-gram hash.
ODD = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= ODD[0]
    h ^= h >> np.uint64(29)
    h *= ODD[1]
    return h ^ (h >> np.uint64(32))


def gram_set(text: str, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of `text`, A-Z as a-z; words are parted by ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mixed(h * ODD[i % 5] + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _sets(df: DataFrame, n: int, fields: str, row) -> DataFrame:
    """mapInArrow over `id` and `text`: `row(id, text, set)` gives a tuple of columns or None."""
    hashes: WordHashes = WordHashes()
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[f.split()[1]]) for f in fields.split(", ")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (x := row(i, s := t.as_py(), gram_set(s, hashes, n))) is not None]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema) if found else None

    return map_batches(df, run, fields, hashes.clear)


def _class(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def text_key(text: str) -> int:
    """What xxhash64 in Spark gives for a text."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42))))


def _signed(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.int64)


def _dealt(df: DataFrame, n: int, part: int, bins: int) -> DataFrame:
    """The n-grams of one part as lists, a row for each bin and some thousands of texts.

    `cls` has the classes that a list knows and `held` how many n-grams each shares with another one there; `low`
    and `high` are 48 bits of each other n-gram and `at` the place of its class. An n-gram that several classes share
    is in the list once, at -1, however many they are.
    """
    hashes: WordHashes = WordHashes()
    fields = {"bin": pa.int64(), "cls": pa.list_(pa.int64()), "held": pa.list_(pa.int32()), "low": pa.list_(pa.int32()), "high": pa.list_(pa.int16()), "at": pa.list_(pa.int16())}

    def lists(texts: pa.Array, out: dict[str, list]) -> None:
        own = {_class(s): s[s % np.uint64(ONE_IN) == part] for t in texts if len(s := gram_set(t.as_py(), hashes, n))}
        cls = np.array(list(own), np.int64)
        gram = np.concatenate([*own.values(), np.empty(0, np.uint64)])
        at = np.repeat(np.arange(len(own)), [len(s) for s in own.values()])
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        bin_ = (gram >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # in the order of the n-grams
        first = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
        alone = first & np.r_[first[1:], True][: len(gram)]
        for rows in np.split(np.arange(len(gram)), np.flatnonzero(np.diff(bin_)) + 1) if len(gram) else ():
            known, place = np.unique(at[rows], return_inverse=True)
            sent = first[rows]
            bits = gram[rows][sent] >> np.uint64(2)
            out["bin"].append(int(bin_[rows[0]]))
            out["cls"].append(cls[known])
            out["held"].append(np.bincount(place[~alone[rows]], minlength=len(known)).astype(np.int32))
            out["low"].append(bits.astype(np.uint32).view(np.int32))
            out["high"].append((bits >> np.uint64(32)).astype(np.uint16).view(np.int16))
            out["at"].append(np.where(alone[rows], place, -1)[sent].astype(np.int16))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[str, list] = {k: [] for k in fields}
        for k in range(0, batch.num_rows, DEAL_ROWS):
            lists(batch.column(0).slice(k, DEAL_ROWS), out)
        return pa.RecordBatch.from_arrays([pa.array(v, fields[k]) for k, v in out.items()], names=list(fields)) if out["bin"] else None

    return map_batches(df.select("text"), run, "bin long, cls array<long>, held array<int>, low array<int>, high array<smallint>, at array<smallint>", hashes.clear)


def _held(table: pa.Table) -> pa.Table:
    """Of the lists of a bin: per class, how many of its n-grams there another class has; n-grams that only look alike, and rows of a class in several lists, make it more."""
    values = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks])
    sizes = lambda c: np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in table.column(c).chunks])
    cls, held, at = values("cls"), values("held").astype(np.int64), values("at").astype(np.int64)
    key = values("high").view(np.uint16).astype(np.uint64) << np.uint64(32) | values("low").view(np.uint32)
    lengths = sizes("cls")
    several = at < 0
    at += np.repeat(np.cumsum(lengths) - lengths, sizes("at"))
    at[several] = -1
    order = np.argsort(key)
    key, at, several = key[order], at[order], several[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    who = cls[at]
    shared = np.logical_or.reduceat(several, starts) | (np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts))
    hit = at[np.repeat(shared, np.diff(np.r_[starts, len(key)])) & ~several]
    held += np.bincount(hit, minlength=len(cls))
    names, place = np.unique(cls[held > 0], return_inverse=True)
    return pa.table({"cls": pa.array(names, pa.int64()), "held": pa.array(np.bincount(place, held[held > 0], len(names)).astype(np.int64))})


def _held_lists(table: pa.Table, shares: int) -> pa.Table:
    """What `_held` finds in a bin as lists, a row for each share of the classes: a class meets as many bins as it has n-grams."""
    found = _held(table)
    cls, held = (found.column(c).to_numpy() for c in ("cls", "held"))
    share = cls % shares
    order = np.argsort(share, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else []
    lists = lambda v, t: pa.array([v[p] for p in parts], pa.list_(t))
    return pa.table({"share": pa.array([int(share[p[0]]) for p in parts], pa.int64()), "cls": lists(cls, pa.int64()), "held": lists(held.astype(np.int32), pa.int32())})


def _summed(table: pa.Table) -> pa.Table:
    """A row for each class of a share, the sum of its lists."""
    cls, held = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks]) for c in ("cls", "held"))
    names, place = np.unique(cls, return_inverse=True)
    return pa.table({"cls": pa.array(names, pa.int64()), "held": pa.array(np.bincount(place, held, len(names)).astype(np.int64))})


def _held_by_class(base: DataFrame, n: int, part: int, bins: int, shares: int) -> DataFrame:
    """`cls` and `held`, a row for each class of `base` that has n-grams of this part in common with others."""
    lists = _dealt(base, n, part, bins).groupBy("bin").applyInArrow(lambda t: _held_lists(t, shares), "share long, cls array<long>, held array<int>")
    return lists.groupBy("share").applyInArrow(_summed, "cls long, held long")


def _may_link(base: DataFrame, classes: DataFrame, n: int, percent: int, part: int) -> DataFrame:
    """The rows of `classes` (`cls`, `n`, `own`, the sizes `p0`, `p1` of their parts) that may have a partner, `own` with the n-grams of this part that no other class of `base` has."""
    size = classes.agg(F.sum(f"p{part}").alias("grams"), F.count("*").alias("rows")).first()
    bins = max(1, -(-(size.grams or 0) // BIN_GRAMS))
    shares = max(1, -(-min(size.rows * bins, size.grams or 0) // SHARE_ROWS))
    own = F.col("own") + F.greatest(F.col(f"p{part}") - F.coalesce("held", F.lit(0)), F.lit(0))
    near = classes.join(_held_by_class(base, n, part, bins, shares), "cls", "left").withColumn("own", own)
    return materialise(near.filter(F.col("own") <= _slack(percent)).drop("held"))


def _slack(percent: int):
    """N-grams that a set of n may lack in a partner."""
    return F.expr(f"n - ((n * {percent} + 99) div 100)")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of two lists of sets, or of one list with itself, as the product of their incidence matrices.

    N-grams of few members add to the cells of their pairs one by one; the others are multiplied as dense columns.
    """
    sets = left if right is None else left + right
    g, at = len(sets), len(left)
    doc = np.repeat(np.arange(g), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    sizes = np.diff(np.r_[starts, len(flat)])
    rows, cols = (g, g) if right is None else (at, g - at)
    out = np.zeros((rows, cols), np.int32)
    few = np.repeat((sizes > 1) & (sizes <= DENSE), sizes)
    d, f = doc[few], flat[few]
    for step in range(1, DENSE):
        same = np.flatnonzero(f[step:] == f[:-step]) if len(f) > step else np.empty(0, np.int64)
        if not len(same):
            break
        a, b = d[same], d[same + step]  # a < b, as the sort is stable
        if right is None:
            cell = a * cols + b
        else:
            cross = (a < at) & (b >= at)
            cell = a[cross] * cols + (b[cross] - at)
        out += np.bincount(cell, minlength=rows * cols).reshape(rows, cols).astype(np.int32)
    many = np.flatnonzero(sizes > DENSE)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        where = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[part], sizes[part])])
        column = np.repeat(np.arange(len(part)), sizes[part])
        m = np.zeros((g, len(part)), np.float32)
        m[doc[where], column] = 1
        out += (m @ m.T if right is None else m[:at] @ m[at:].T).astype(np.int32)
    if right is None:
        out = np.triu(out, 1)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> np.ndarray:
    """Which cells are links: pairs within the bounds of their sizes whose overlap reaches the similarity."""
    na = np.array([len(s) for s in left])
    nb = na if right is None else np.array([len(s) for s in right])
    both = overlaps(left, right)
    near = 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
    return near & (both > 0) & (100 * both >= percent * (na[:, None] + nb - both))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(table: pa.Table, percent: int) -> pa.Table:
    """One task's tiles: per class its links' copies and a root among the classes seen."""
    cls, tile, side, copies = (table.column(c).to_numpy() for c in ("cls", "tile", "side", "copies"))
    grams = [x.values.to_numpy() for x in table.column("grams")]
    kept: dict[str, list] = {"a": [], "b": [], "links": []}
    order = np.lexsort((cls, side, tile))
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        first = rows[np.r_[True, cls[rows][1:] != cls[rows][:-1]]]  # rows of repeated documents
        left, right = first[side[first] == 0], first[side[first] == 1]
        link = linked([grams[i] for i in left], [grams[i] for i in right] if len(right) else None, percent) if len(left) else np.zeros((0, 0), bool)
        a, b = np.nonzero(link)
        members = np.r_[left, right] if len(right) else left
        if len(right):
            b = b + len(left)
        if not len(a):
            continue
        weight = np.bincount(a, copies[members][b], len(members)) + np.bincount(b, copies[members][a], len(members))
        found = cls[members][_forest(a, b, len(members))]
        some = np.flatnonzero(weight)
        kept["a"].append(cls[members][some])
        kept["b"].append(found[some])
        kept["links"].append(weight[some].astype(np.int64))
    return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for k, v in kept.items()})


def _homes(held: DataFrame, block: int) -> DataFrame:
    """`held` (`cls`, `common`, `grams` and more) with `home`, the n-gram that the class goes by, and `joined`, whether that is another's.

    A class of a cell of under half a block goes to the cell of most classes that has one of its prefix n-grams, so that
    the few that lack the n-gram of a large group make blocks together, instead of one for each n-gram that they have.
    """
    cells = materialise(held.groupBy("common").agg(F.count("*").alias("c")).withColumn("rows", F.col("c")))
    held = materialise(join_hot(held, cells, "common", "rows"))
    rows = held.withColumn("gram", F.explode("grams")).drop("grams")
    largest = materialise(rows.groupBy("gram").agg(F.max(F.struct("c", "common")).alias("largest"), F.count("*").alias("rows")))
    kept = [c for c in held.columns if c not in ("cls", "grams")]
    found = join_hot(rows, largest, "gram", "rows").groupBy("cls").agg(*(F.first(c).alias(c) for c in kept), F.max("largest").alias("largest"), F.collect_list("gram").alias("grams"))
    joined = (2 * F.col("c") < block) & (F.col("largest.common") != F.col("common"))
    return found.withColumn("joined", joined).withColumn("home", F.when(F.col("joined"), F.col("largest.common")).otherwise(F.col("common"))).drop("c", "common", "largest")


def placements(groups: DataFrame, chosen: DataFrame, prefix: DataFrame, percent: int, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """`cls`, `tile`, `side`, `n` and `copies` of each class in each tile it takes part in; a side of 1 is the second of two blocks.

    `groups` has `node` and `root`, `chosen` has `cls`, `n` and `copies`, `prefix` has `cls`, `gram` and the number `m` of
    classes that have it in their prefix. A class goes by the prefix n-gram that most others have too, so that near
    copies, which have most of their prefixes in common, fill a few whole blocks; those that lack it, see `_homes`.
    """
    members = materialise(groups.select(F.col("node").alias("cls"), "root").join(chosen.select("cls", "n", "copies"), "cls"))
    sizes = materialise(members.groupBy("root").agg(F.count("*").alias("g"), F.sum("n").alias("grams")).withColumn("large", (F.col("g") > block) | (F.col("grams") > block_grams)))
    small = join_hot(members, sizes.select("root", "g", "large"), "root", "g").filter("NOT large").select("cls", F.col("root").alias("tile"), F.lit(0).alias("side"), "n", "copies")
    if sizes.filter("large").isEmpty():
        return materialise(small)
    large = materialise(join_hot(members, sizes.select("root", "g", "large"), "root", "g").filter("large").select("cls", "n", "copies"))
    # one row a class, with its prefix as an array, so that the joins below go by class and not by class and n-gram
    held = prefix.join(large.select("cls"), "cls", "left_semi").groupBy("cls")
    held = large.join(held.agg(F.max(F.struct("m", "gram")).getField("gram").alias("common"), F.collect_list("gram").alias("grams")), "cls")
    # sizes of partners are at most one band apart
    width = float(np.log(100 / percent)) * (1 + 1e-6)
    celled = materialise(_homes(held, block).withColumn("band", F.floor(F.log("n") / width)).withColumn("cell", F.xxhash64("home", "joined", "band")).drop("home", "joined"))
    cells = materialise(celled.groupBy("cell").agg(F.count("*").alias("c"), F.sum("n").alias("s")))
    parts = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("s") / block_grams))
    blocks = join_hot(celled, cells.select("cell", "c", parts.alias("parts"), (F.col("c") == 1).alias("alone")), "cell", "c")
    blocks = materialise(blocks.select("cls", "n", "copies", "grams", "band", "alone", F.xxhash64("cell", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("block")))
    # blocks that share a prefix n-gram, of the same band or the next
    shared = materialise(blocks.select(F.explode("grams").alias("gram"), "band", "block", "alone").distinct())
    other = shared.select("gram", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("block").alias("other"), F.col("band").alias("other_band"))
    meet = shared.join(other, ["gram", "band"]).filter("band != other_band OR block < other OR (block = other AND NOT alone)")
    pairs = materialise(meet.select("block", "other").distinct())
    tile = F.xxhash64("block", "other", F.lit("tile"))
    sides = pairs.select(F.col("block").alias("mine"), tile.alias("tile"), F.lit(0).alias("side")).unionByName(pairs.filter("block != other").select(F.col("other").alias("mine"), tile.alias("tile"), F.lit(1).alias("side")))
    return materialise(small.unionByName(blocks.join(sides, F.col("block") == F.col("mine")).select("cls", "tile", "side", "n", "copies")))


def _components(df: DataFrame, doc: str, text: str, n: int, percent: int, block: int, block_grams: int) -> tuple[DataFrame, DataFrame]:
    """Documents (`id`, `text_key`, `cls`, `n`) and, of the classes with a link, `cls`, `root`, `component_id` and `links`."""
    base = df.select(F.col(f"`{doc}`").cast("long").alias("id"), text_of(f"`{text}`").alias("text"))

    def summary(i, text, grams):
        parts = np.bincount((grams % np.uint64(ONE_IN)).astype(np.int64), minlength=2)
        return i, text_key(text), _class(grams), len(grams), int(parts[0]), int(parts[1])

    docs = materialise(_sets(base, n, "id long, text_key long, cls long, n long, p0 long, p1 long", summary))
    classes = materialise(docs.filter("n > 0").groupBy("cls").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), *(F.max(c).alias(c) for c in ("n", "p0", "p1"))))

    def of(some: DataFrame) -> DataFrame:
        """A document of each of these classes."""
        ids = some.select(F.col("first_id").alias("want"))
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return base.join(ids, F.col("id").eqNullSafe(F.col("want")), "left_semi")

    # first bound: n-grams that no other class has
    near = _may_link(base, classes.withColumn("own", F.lit(0).cast("long")), n, percent, 0)
    chosen = _may_link(of(near), near, n, percent, 1)

    # the sets of the classes that are left, from one document each
    sets = _sets(of(chosen), n, "cls long, grams array<long>", lambda i, text, grams: (_class(grams), _signed(grams)) if len(grams) else None)
    # where no id repeats there is one row a class; else rows are told apart by a shuffle of all sets
    single = docs.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()
    sets = materialise(sets if single else sets.dropDuplicates(["cls"]))

    # second bound: partners share one of the rarest n-grams of each
    rows = sets.join(chosen.select("cls"), "cls", "left_semi") if not single else sets
    rows = rows.select("cls", F.explode("grams").alias("gram"))
    shared = materialise(rows.groupBy("gram").agg(F.count("*").cast("int").alias("df")).filter("df > 1"))
    by_class = join_hot(rows, shared.withColumn("rows", F.col("df")), "gram", "rows").filter("df IS NOT NULL").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held")).join(chosen.select("cls", "n"), "cls")
    room = _slack(percent) + 1 - (F.col("n") - F.size("held"))
    prefix = materialise(by_class.filter(room > 0).select("cls", F.explode(F.slice("held", F.lit(1), F.least(room, F.size("held").cast("long")).cast("int"))).alias("g")).select("cls", "g.gram"))
    stars = prefix.groupBy("gram").agg(F.min("cls").alias("hub"), F.count("*").alias("m")).filter("m > 1").withColumn("rows", F.col("m"))
    starred = materialise(join_hot(prefix, materialise(stars), "gram", "rows").filter("m IS NOT NULL").select("cls", "gram", "hub", "m"))
    groups = components(starred.select(F.col("cls").alias("a"), F.col("hub").alias("b")).filter("a != b").distinct())

    # the products
    placed = placements(groups, chosen, starred, percent, block, block_grams)
    size = placed.agg(F.sum("n").alias("grams"), F.count("*").alias("rows")).first()
    bins = max(1, -(-(size.grams or 0) * 2 // block_grams))
    # placements go to the sets, which are dealt once, by bin
    placed = placed.drop("n")
    tiles = sets.join(F.broadcast(placed) if size.rows <= BROADCAST_IDS // 2 else placed, "cls").withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(bins)))
    done = materialise(tiles.groupBy("bin").applyInArrow(lambda t: _tiles(t, percent), "a long, b long, links long"))
    linked_to = done.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(done.filter("a != b").select("a", "b")).withColumnRenamed("node", "cls")

    grouped = classes.join(roots, "cls", "left").join(linked_to, "cls", "left").filter("copies > 1 OR root IS NOT NULL")
    grouped = materialise(grouped.select("cls", F.coalesce("root", "cls").alias("root"), "first_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    firsts = materialise(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("g")))
    found = join_hot(grouped, firsts, "root", "g").select("cls", "root", "component_id", "copies", "links")
    return docs.drop("p0", "p1"), materialise(found)


def _rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the columns of their class in `found`; those without words have no class and meet nothing."""
    own = F.coalesce("id", F.monotonically_increasing_id())
    rows = docs.withColumn("cls", F.when(F.col("n") > 0, F.col("cls")).otherwise(own))
    return join_hot(rows, found.withColumn("grouped", F.lit(True)), "cls", "copies").withColumn("grouped", F.col("grouped").isNotNull() & (F.col("n") > 0))


def jaccard_components(df: DataFrame, doc: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per row of `df`: the id, `n_shingles`, `component_id` and `n_links`, the number of rows that link with it."""
    rows = _rows(*_components(df, doc, text, n, percent, block, block_grams))
    return rows.select(
        F.col("id").alias(doc),
        F.col("n").alias("n_shingles"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("grouped"), F.col("links")).otherwise(0).alias("n_links"),
    )


def one_of_each(df: DataFrame, doc: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `df` with the smallest id of their component, of equal ids the text with the smallest hash.

    Rows without an id, or without words, stay. Of rows that repeat both id and text one stays; rows that share an id
    but not a text are judged each for itself.
    """
    rows = materialise(_rows(*_components(df, doc, text, n, percent, BLOCK, BLOCK_GRAMS)).filter("grouped AND id IS NOT NULL").select("id", "text_key", "root"))
    keepers = materialise(rows.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("kept"), F.count("*").alias("g")))
    judged = materialise(join_hot(rows, keepers, "root", "g").groupBy("id", "text_key").agg(F.count("*").alias("rows"), F.first(F.struct("id", "text_key") == F.col("kept")).alias("stays")))
    key, kept_text = free_name(df, "key"), free_name(df, "kept_text")
    same = lambda: (F.col(f"`{doc}`").cast("long") == F.col(key)) & (F.xxhash64(text_of(f"`{text}`")) == F.col(kept_text))
    named = judged.select(F.col("id").alias(key), F.col("text_key").alias(kept_text), "rows", "stays")
    gone, again = (named.filter(c).select(key, kept_text) for c in ("NOT stays", "stays AND rows > 1"))
    few = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    rest = df.join(few(gone), same(), "left_anti")
    if again.isEmpty():
        return rest
    again = few(again)
    return rest.join(again, same(), "left_anti").unionByName(rest.join(again, same(), "left_semi").dropDuplicates([doc, text]))
