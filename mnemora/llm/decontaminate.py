"""Benchmark decontamination: word pairs shared with test items are seeds, local alignment scores the copies.

An item of n words that scores S in a text shares at least (2 S - n - 3) / 3 of its word pairs with it, on diagonals
(place in the text less place in the item) that lie close together, whatever words stand between. Where so many seeds
of an item meet, Smith-Waterman alignment over words scores the stretch around them, so the items found are those that
alignment with the whole text would find, edited and paraphrased copies too. How common a seed is only decides which
ones the search begins with; no text counts for another. Words are compared lower-cased and without marks.

The corpus is read once, however large the benchmark. One of up to `TASK_WORDS` words goes to the tasks whole, as
seeds in sorted arrays. The seeds of a larger one are a table: the word pairs of the texts join it by hash, are
counted by text and item, and only where enough of an item's seeds are in a text does the alignment see both.

Defined cases: null or blank texts match nothing; items without words match nothing; an item of one word is one
seed; repeated items and rows are each reported; ids may be of any type; empty tables give an empty result; columns
but id and text are carried by `without_contaminated` and not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_batches, materialise, text_of

#: Words of a benchmark that goes to the tasks whole, some tens of MB.
TASK_WORDS = 500_000
#: Places of the items that have a seed before it is common; a search may begin without common seeds, see `Items`.
COMMON = 64
MATCH, MISMATCH, GAP = 2, -1, -2
#: Score of a copy, as a share of the score of an exact copy; short items need more.
MIN_SCORE, SHORT_WORDS, SHORT_SCORE = 0.5, 8, 0.9
#: Words that a task remembers before it starts afresh.
MEMO = 200_000
MARKS = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return MARKS.sub("", word.lower())


def words_of(text: str) -> list[str]:
    return [p for w in text.split() if (p := plain(w))]


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and where in `stretch` it begins and ends."""
    m = len(stretch)
    steps = np.arange(m + 1)
    before, start = np.zeros(m + 1, np.int64), steps.copy()
    best, at = 0, (0, 0)
    for w in item:
        diagonal = before[:-1] + np.where((stretch == w) & (w > 0), MATCH, MISMATCH)
        down = before[1:] + GAP
        value = np.r_[0, np.maximum(np.maximum(diagonal, down), 0)]
        origin = np.r_[0, np.where(value[1:] == 0, steps[1:], np.where(diagonal >= down, start[:-1], start[1:]))]
        # gaps along the row: the running maximum of value minus the cost of reaching it
        shifted = value - GAP * steps
        peak = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == peak, steps, 0))
        row = peak + GAP * steps
        start = np.where(row > value, origin[source], origin)
        before = np.maximum(row, value)
        k = int(before.argmax())
        if before[k] > best:
            best, at = int(before[k]), (int(start[k]), k)
    return best, *at


def bounds(n: int) -> tuple[int, int]:
    """Word pairs of an item of `n` words that every copy shares, and how far the diagonals of one copy lie apart.

    M matched words in R runs share B = M - R pairs; the R - 1 breaks cost a mismatch each while the item has words
    for them, and a gap beyond, so the score is at most (n + 3 B + 3) / 2. Gaps cost 2 each of at most 2 n.
    """
    score = -int(-(MATCH * n * (MIN_SCORE if n >= SHORT_WORDS else SHORT_SCORE) - 1e-9) // 1)
    return max(1, -(-(2 * score - n - 3) // 3)), (MATCH * n - score) // -GAP


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each `lo` up to its `hi`, one range after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Numbers(dict):
    """Numbers of raw words, found out once each: 0 if no item has the word, -1 for bare marks."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        p = plain(word)
        self[word] = n = self.known.get(p, 0) if p else -1
        return n


class Items:
    """The seeds of a benchmark.

    A copy shares `need` seeds of its item at least, so up to `need - 1` common ones are left out of the search, and
    `need` is less by their number: what the others must reach whether or not the copy has those.
    """

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.known = [], {}
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            if words := words_of(text or ""):
                self.ids.append(item_id)
                self.words.append(np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64))
        codes = [self.codes(w) for w in self.words]
        limits = [bounds(len(w)) for w in self.words]
        self.need, self.band = (np.array(x, np.int64) for x in zip(*limits)) if limits else (np.empty(0, np.int64),) * 2
        every = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        self.place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else every
        _, number, count = np.unique(every, return_inverse=True, return_counts=True)
        often, used, begin = count[number], np.ones(len(every), bool), 0
        for k, c in enumerate(codes):
            mine = begin + np.argsort(-often[begin : begin + len(c)], kind="stable")[: self.need[k] - 1]
            mine = mine[often[mine] > COMMON]
            used[mine] = False
            self.need[k] -= len(mine)
            begin += len(c)
        every, self.item, self.place = every[used], self.item[used], self.place[used]
        order = np.argsort(every, kind="stable")
        self.item, self.place = self.item[order], self.place[order]
        self.seeds, first, self.seed = np.unique(every[order], return_index=True, return_inverse=True)
        self.first = np.r_[first, len(every)]
        self.has_short = bool((self.seeds & ((1 << 31) - 1) == 0).any())  # items of one word
        self.memo = Numbers(self.known)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ = state
        self.memo = Numbers(self.known)

    @staticmethod
    def codes(w: np.ndarray) -> np.ndarray:
        """Codes of the word pairs; an item of one word has one code, of it and zero."""
        return (w[:-1] << 31) + w[1:] if len(w) > 1 else w << 31

    def read(self, text: str) -> np.ndarray:
        """A text as word numbers: 0 for words that no item has; bare marks are left out."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        words = text.split()
        out = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return out[out >= 0]

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text and numbers of the seeds that begin there."""
        if not len(self.seeds):
            return (np.empty(0, np.int64),) * 2
        places = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
        codes = (w[places] << 31) + w[places + 1]
        if self.has_short:
            single = np.flatnonzero(w > 0)
            places, codes = np.r_[places, single], np.r_[codes, w[single] << 31]
        at = np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)
        good = self.seeds[at] == codes
        return places[good], at[good]

    def stretches(self, k: int, places: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int]]:
        """Where in the text a copy of item `k` may lie, from the item's seeds there, sorted by diagonal."""
        n, need, band = len(self.words[k]), int(self.need[k]), int(self.band[k])
        out: list[tuple[int, int]] = []
        within: dict[int, int] = {}
        left, place, diagonal = 0, places.tolist(), diagonals.tolist()
        for p, d in zip(place, diagonal):
            within[p] = within.get(p, 0) + 1
            while d - diagonal[left] > band:
                old = place[left]
                left += 1
                within[old] -= 1
                if not within[old]:
                    del within[old]
            if len(within) >= need:
                a, b = d - band, d + band + n
                if out and a <= out[-1][1]:
                    a = out.pop()[0]
                out.append((a, b))
        return out

    def copies(self, text: str) -> list[tuple[object, float, int, int]]:
        """Items that `text` copies: id, score, and the word span of the copy in the text."""
        w = self.read(text)
        places, seeds = self.hits(w)
        there = np.unique(seeds)
        found = ranges(self.first[there], self.first[there + 1])  # places of the items whose seed is in the text
        enough = np.bincount(self.item[found], minlength=len(self.ids)) >= self.need
        found = found[enough[self.item[found]]]
        if not len(found):
            return []
        order = np.argsort(seeds, kind="stable")
        places, seeds = places[order], seeds[order]
        found = found[np.argsort(self.item[found], kind="stable")]
        out = []
        for own in np.split(found, np.flatnonzero(np.diff(self.item[found])) + 1):
            k = int(self.item[own[0]])
            n = len(self.words[k])
            lo, hi = np.searchsorted(seeds, self.seed[own]), np.searchsorted(seeds, self.seed[own], "right")
            at = np.repeat(self.place[own], hi - lo)
            diagonals = places[ranges(lo, hi)] - at
            order = np.argsort(diagonals, kind="stable")
            best = (0.0, 0, 0)
            for a, b in self.stretches(k, at[order], diagonals[order]):
                a, b = max(0, a), min(len(w), b)
                score, s, e = align(self.words[k], w[a:b])
                if score / (MATCH * n) > best[0]:
                    best = score / (MATCH * n), a + s, a + e
            if best[0] >= (MIN_SCORE if n >= SHORT_WORDS else SHORT_SCORE):
                out.append((self.ids[k], *best))
        return out


# --- benchmarks that go to the tasks whole -----------------------------------------------------------------------


def words_in(bench: DataFrame) -> int:
    """A bound of the benchmark's words by its bytes, as any word but the last is followed by a byte at least."""
    return bench.agg(F.coalesce(F.sum(F.ceil((F.octet_length("text") + 1) / 2)), F.lit(0))).first()[0]


def _held(bench: DataFrame) -> tuple[Items, pa.Array]:
    """The seeds of a small benchmark, by place, and the items' ids at these places."""
    table = bench.orderBy("item").toArrow()  # at most TASK_WORDS words
    return Items(list(enumerate(table.column("text").to_pylist()))), table.column("item").combine_chunks()


def _small(rows: DataFrame, bench: DataFrame, schema: str) -> DataFrame:
    items, ids = _held(bench)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(k, *c) for k, t in enumerate(batch.column(1)) for c in items.copies(t.as_py())]
        if not found:
            return None
        row, item, score, first, end = zip(*found)
        made = [batch.column(0).take(pa.array(row)), ids.take(pa.array(item)), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return map_batches(rows, run, schema, lambda: items.memo.clear())


# --- benchmarks whose seeds are a table --------------------------------------------------------------------------


def pair_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the word pairs; of a single word, that of the word alone."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 1 else words
    return np.fromiter((xxhash.xxh3_64_intdigest(p) for p in pairs), np.uint64, len(pairs)).view(np.int64)


def seed_table(bench: DataFrame) -> DataFrame:
    """`number` of an item, `place`, `seed`, and `need`: of these seeds every copy of the item has so many at least.

    An item's `need` falls by each of its common seeds, of which at most `need` - 1 are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        number, place, seed, need = [], [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            if words:
                h = pair_hashes(words)
                number += [k] * len(h)
                place += range(len(h))
                seed += h.tolist()
                need += [bounds(len(words))[0]] * len(h)
        return pa.RecordBatch.from_pydict({"number": pa.array(number, pa.int64()), "place": pa.array(place, pa.int64()), "seed": pa.array(seed, pa.int64()), "need": pa.array(need, pa.int64())})

    rows = map_batches(bench.select("number", "text"), run, "number long, place long, seed long, need long")
    often = rows.groupBy("seed").agg(F.count("*").alias("often"))
    # the common seeds of an item, those of most places first, are left out; an item's seeds lie in one array
    by_item = rows.join(often, "seed").groupBy("number", "need").agg(F.sort_array(F.collect_list(F.struct("often", "seed", "place")), asc=False).alias("seeds"))
    out = F.least(F.size(F.filter("seeds", lambda s: s["often"] > COMMON)).cast("long"), F.col("need") - 1)
    kept = by_item.select("number", (F.col("need") - out).alias("need"), F.explode(F.slice("seeds", (out + 1).cast("int"), F.size("seeds"))).alias("s"))
    return kept.select("number", "need", "s.place", "s.seed")


def _large(rows: DataFrame, bench: DataFrame, schema: str) -> DataFrame:
    bench = materialise(bench.withColumn("number", F.monotonically_increasing_id()))
    seeds = materialise(seed_table(bench))
    single = not seeds.filter("need = 1").limit(1).isEmpty()  # a copy of a short item may share one seed, or be one word

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(1):
            words = words_of(text.as_py())
            h = pair_hashes(words) if len(words) > 1 else np.empty(0, np.int64)
            if single and words:
                h = np.r_[h, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in set(words)), np.uint64).view(np.int64)]
            found.append(np.unique(h))
        lengths = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.RecordBatch.from_pydict({"text_key": batch.column(0), "seeds": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))})

    # equal texts are searched once, known by their digest
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("text_key"), "text")
    texts = map_batches(keyed.select("text_key", "text"), hashes, "text_key string, seeds array<long>").dropDuplicates(["text_key"])
    met = texts.select("text_key", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("text_key", "number", "need").agg(F.count("*").alias("n")).filter("n >= need")
    pairs = keyed.join(met.select("text_key", "number"), "text_key").join(bench.select("number", "item", F.col("text").alias("item_text")), "number")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(k, *c[1:]) for k, (t, i) in enumerate(zip(batch.column(1), batch.column(3))) for c in Items([(0, i.as_py())]).copies(t.as_py())]
        if not found:
            return None
        row, score, first, end = zip(*found)
        made = [batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return map_batches(pairs.select("doc_id", "text", "item", "item_text"), run, schema)


def _inputs(df: DataFrame, bench: DataFrame, doc: str, text: str, item: str) -> tuple[DataFrame, DataFrame, str]:
    rows = df.select(F.col(f"`{doc}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    items = bench.select(F.col(f"`{item}`").alias("item"), text_of().alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    return rows, items, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word long, end_word long"


def contaminated(df: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", task_words: int = TASK_WORDS) -> DataFrame:
    """One row per text and item that it copies: the ids, `score` (1 for an exact copy) and the copy's word span."""
    rows, items, schema = _inputs(df, bench, doc, text, item)
    return (_small if words_in(items) <= task_words else _large)(rows, items, schema)


def without_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", task_words: int = TASK_WORDS) -> DataFrame:
    """The rows of `df` whose text copies no item."""
    at = df.columns.index(text)
    rows, items, schema = _inputs(df, bench, text, text, item)
    if words_in(items) > task_words:
        key = free_name(df, "text_key")
        gone = _large(rows, items, schema).select(F.sha2("doc_id", 256).alias(key)).distinct()  # here the text stands for the id
        return df.join(gone, F.sha2(text_of(f"`{text}`"), 256) == F.col(key), "left_anti")
    held, _ = _held(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not held.copies(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

    own = [f"c{i}" for i in range(len(df.columns))]  # any names will do
    rest = map_batches(df.toDF(*own), run, df.toDF(*own).schema, lambda: held.memo.clear())
    return rest.select(*(F.col(o).alias(c) for o, c in zip(own, df.columns)))
