"""Language identification by cross-parsing: a text is cut greedily into longest phrases that a language's sample holds.

A bounded sample of labelled text of each language becomes a suffix automaton over UTF-8 bytes, whose walks from the root
are exactly the substrings of the sample. A text is parsed by every automaton: a phrase goes on as long as the walk does,
the next begins with the byte that ended it, and a byte that the sample does not hold is a phrase of its own. A phrase
costs as many bits as the logarithm of the sample's length, so the language of fewest phrases, weighed by it and taken by
byte, wins. Many segments are walked in step, one table lookup a byte and language.

Learned from: windows of labelled rows that the caller marks as such, by the hash of id and text, at most
`SAMPLE_ROWS` windows of `SAMPLE_CHARS` characters for each of the `MOST_LANGUAGES` labels of most rows. Samples are only
of the model: whole texts are parsed, in segments of `SEGMENT` bytes, each of which begins a phrase.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text when nothing was learned;
characters that are no letters or marks count as one space; equal costs go to the label that sorts first; a null id is
hashed as an empty one; repeated rows are judged one by one; an empty table gives an empty table; columns with clashing
names are left alone, as results get underscores before their names until these are free.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_batches

SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGUAGES = 48, 1_000, 32
SEGMENT, LANES = 1_024, 8_192
UNKNOWN = "und"
RESULTS = ("lang_pred", "score")


class Languages(NamedTuple):
    """By language its name, the cost of a phrase in bits and the walk table; `codes`: the place of each byte in a table's rows.

    A table's entry at state * width + code is four times the next state * width, plus the phrases that end there.
    """

    names: list[str]
    bits: list[float]
    tables: list[np.ndarray]
    codes: np.ndarray


def normalised(text: Column) -> Column:
    """Lower case, whatever is no letter or mark as one space."""
    return F.btrim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}]+", " "))


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `data`, by state; the root is 0."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


def _table(following: list[dict[int, int]], codes: np.ndarray, width: int) -> np.ndarray:
    """The walk with restarts: where there is no way on, a phrase ends and the root's way is taken."""
    root = np.full(width, 1, np.int32)  # a byte that no phrase begins with is one itself
    for c, to in following[0].items():
        root[codes[c]] = 4 * to * width
    table = np.empty((len(following), width), np.int32)
    table[0] = root
    table[1:] = root + 1
    states = np.repeat(np.arange(len(following)), [len(f) for f in following])
    bytes_ = np.fromiter((c for f in following for c in f), np.int64, len(states))
    targets = np.fromiter((to for f in following for to in f.values()), np.int64, len(states))
    table[states, codes[bytes_]] = 4 * targets * width
    return table.ravel()


def fit(samples: dict[str, str]) -> Languages | None:
    """The automata of normalised sample texts by language; None without any."""
    data = {name: text.encode() for name, text in sorted(samples.items()) if text.strip()}
    if not data:
        return None
    held = sorted(set().union(*data.values()))
    codes = np.zeros(256, np.uint8)
    codes[held] = np.arange(1, len(held) + 1)
    return Languages(list(data), [float(np.log2(len(d) + 1)) for d in data.values()], [_table(automaton(d), codes, len(held) + 1) for d in data.values()], codes)


def samples_of(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """By label windows of its texts, of rows for which `learn` holds. Where a label has many rows only a share of them,
    by hash, is put in order; a label for which that share is too small has all its rows put in order."""
    base = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), learn.alias("learn"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("learn AND lang IS NOT NULL")
    counts = base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    share = {r["lang"]: min(1.0, 8 * rows / r["count"]) for r in counts}
    found: dict[str, list[str]] = {}
    while share:
        bounds = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
        some = base.select("lang", F.xxhash64("key", "text").alias("hash"), "text").filter(F.pmod("hash", F.lit(1 << 30)) < F.try_element_at(bounds, F.col("lang")) * (1 << 30)).filter("text IS NOT NULL")
        start = F.lit(1) + F.pmod(F.shiftright("hash", 30), F.greatest(F.length("text") - chars + 1, F.lit(1)))
        windows = some.select("lang", "hash", normalised(F.col("text").substr(start.cast("int"), F.lit(chars))).alias("window")).filter("window != ''")
        first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "window"))
        for r in windows.withColumn("k", first).filter(F.col("k") <= rows).orderBy("lang", "k").collect():
            found.setdefault(r["lang"], []).append(r["window"])
        short = {name for name, s in share.items() if s < 1 and len(found.get(name, ())) < rows}
        for name in short:
            found.pop(name, None)
        share = dict.fromkeys(short, 1.0)
    return {name: " ".join(windows) for name, windows in found.items()}


def phrases(model: Languages, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases by language and segment of the bytes `data`; segments that are walked in step are of falling length."""
    out = np.zeros((len(model.names), len(starts)), np.int64)
    coded = model.codes[data]
    order = np.argsort(-lengths, kind="stable")
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        at, length = starts[lanes], lengths[lanes]
        states = np.zeros((len(model.names), len(lanes)), np.int32)
        counts = np.zeros((len(model.names), len(lanes)), np.int32)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for p, k in enumerate(active):
            c = coded.take(at[:k] + p)
            for table, s, n in zip(model.tables, states, counts):
                v = table.take(s[:k] + c)
                n[:k] += v & 3
                np.right_shift(v, 2, out=s[:k])
        out[:, lanes] = counts + (states != 0)
    return out


def judged(model: Languages, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language of each text that is not null or empty, and the share of its code length among all."""
    plain = texts.cast(pa.large_binary())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] else np.zeros(0, np.uint8)
    size = np.where(np.asarray(plain.is_valid()), np.diff(offsets), 0)
    segments = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), segments)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
    bits = np.zeros((len(model.names), len(size)))
    if len(doc):
        found = phrases(model, data, offsets[doc] + nth * SEGMENT, np.minimum(size[doc] - nth * SEGMENT, SEGMENT))
        for row, n, cost in zip(bits, found, model.bits):
            row += np.bincount(doc, n, len(size)) * cost
    best = bits.argmin(axis=0)
    score = 1 / np.exp2(np.maximum(bits[best, np.arange(len(size))] - bits, -1000)).sum(axis=0)
    names = [model.names[b] if n else UNKNOWN for b, n in zip(best, size)]
    return names, np.where(size > 0, score, 0.0).tolist()


def identify(df: DataFrame, model: Languages | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with `lang_pred` and `score` under free names; one pass, no shuffle."""
    keep = df.columns if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]
    said = F.col(f"`{text}`").cast("string")
    rows = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)), F.when(F.rlike(said, F.lit(r"\p{L}")), normalised(said)).alias("said"))
    if model is None:
        out = rows.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)  # by the bounds of the sample at most 32 tables of some MB

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = judged(shared.value, batch.column(len(own)))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*own, *RESULTS])

        kinds = [f"{o} {rows.schema[o].dataType.simpleString()}" for o in own]
        out = map_batches(rows, run, ", ".join([*kinds, "lang_pred string", "score double"]))
    named = df.select(*(F.col(f"`{c}`") for c in keep))
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, keep)), *(F.col(r).alias(free_name(named, r)) for r in RESULTS))


def held_out(key: Column) -> Column:
    """A fifth of all rows, by the checksum of the id: nothing is learned from these."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_digest(df: DataFrame) -> DataFrame:
    """Per document whether it was held out, the language and the score."""
    model = fit(samples_of(df, ~held_out(F.col("doc_id"))))
    rows = df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model, keep=["doc_id", "held_out"])
