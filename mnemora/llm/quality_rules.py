"""Host-level quality rules, in DataFrame functions only.

Each document is held against text rules; failures are summed by host, the failure rate of each rule is
shrunk towards the corpus rate with an empirical beta prior, and the verdicts on hosts are joined back: a host on which
more documents fail a rule than are tolerated is refused on this rule, and all its documents that fail it go. On other
hosts a single failure is taken for an accident. Documents that fail nothing stay, whatever their host.

Defined cases: a null text is an empty text (it has no words and fails the base rule); a null host is a host
of its own; repeated rows are judged one by one and each counts for its host; an empty table gives an empty
table; columns with clashing names are left alone, as results get underscores before their names until these are free.
A host may hold a third of all rows: failures are summed before they are dealt by host, and the verdict on a host of
many rows is taken to them as they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, join_hot, materialise, text_of

#: Symbols that count as markup debris.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE_RULE = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
#: Rules beyond the base; each is a condition on the measures.
SOFT_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
}
#: Share of a host's documents that may fail a rule. A host is refused on the rule when its rate is above this by one
#: standard deviation of its posterior; then those of its documents go that fail the rule.
TOLERATED = 0.05
#: A document that fails so many rules goes whatever its host.
RULE_LIMIT = 2
#: Bounds of the prior's weight, in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 1000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _triples(words: Column) -> Column:
    """Word triples with their places."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    a, b, c = (F.slice(words, F.lit(k), n) for k in (1, 2, 3))
    return F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("p"))


def _windows(triples: Column) -> Column:
    """The triples sorted, so that equal ones are neighbours; null if all hashes differ, as then no triple repeats."""
    hashes = F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(triples), F.sort_array(triples))


def _repeat_starts(windows: Column) -> Column:
    """Places of the triples that occur more than once, ascending."""
    twins = F.zip_with(
        F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 1, F.lit(0))),
        F.slice(windows, F.lit(2), F.greatest(F.size(windows) - 1, F.lit(0))),
        lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["p"], y["p"])),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))


def _covered(starts: Column) -> Column:
    """Words inside the windows of three words that begin at `starts`."""
    k = F.greatest(F.size(starts) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(starts, F.lit(2), k), F.slice(starts, F.lit(1), k), lambda x, y: F.least(x - y, F.lit(3)))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text as one struct column `measures`."""
    t, w, z, s, r = (free_name(df, x) for x in ("t", "w", "z", "s", "r"))
    step = df.withColumn(t, text_of(text)).withColumn(w, _words(F.col(t))).withColumn(z, _triples(F.col(w)))
    step = step.withColumn(s, _windows(F.col(z))).withColumn(r, _repeat_starts(F.col(s)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.size(F.split(F.col(t), f"[{SYMBOLS}]", -1)) - 1,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(_covered(F.col(r)), F.lit(0)),
    }
    return step.withColumn("measures", F.struct(*(found[k].cast("long").alias(k) for k in MEASURES))).drop(t, w, z, s, r)


def _faults() -> Column:
    """Of the measures, bits: 1 for a document that goes on any host, then one for each soft rule that it fails."""
    failed = [f"int({rule})" for rule in SOFT_RULES.values()]
    goes = f"int({BASE_RULE} OR {' + '.join(failed)} >= {RULE_LIMIT})"
    return F.expr(" + ".join([goes, *(f"{2 << i} * {f}" for i, f in enumerate(failed))]))


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host its number of documents and the shrunken failure rate of each rule; `judged` has `host` and one flag column a rule.

    The prior of a rule is a beta distribution fitted by moments to the hosts' rates: its mean is the corpus
    rate, its weight follows from the variance between hosts, less what sampling adds to it. `low_` is the rate less
    one standard deviation of the posterior.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"f_{r}").cast("long")).alias(r) for r in SOFT_RULES))
    fits = []
    for r in SOFT_RULES:
        rate = F.sum(r) / F.sum("n")
        spread = F.sum(F.col(r) * F.col(r) / F.col("n")) / F.sum("n") - rate * rate
        sampling = (F.count("*") - 1) * rate * (1 - rate) / F.sum("n")
        fits += [rate.alias(f"m_{r}"), (spread - sampling).alias(f"v_{r}")]
    prior = hosts.agg(*fits)
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    rates = []
    for r in SOFT_RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX))).otherwise(PRIOR_MAX)
        rate = (F.col(r) + m * weight) / (F.col("n") + weight)
        rates.append((rate - F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))).alias(f"low_{r}"))
    return out.select("host", "n", *rates)


def _host_of(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00null"))


def quality_verdicts(df: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), then `measures`, `base_failed`, `failed_rules` and `kept`, under free names.

    The measures are written once to the shared folder, since they serve both the sums by host and the verdicts.
    """
    keep = df.columns if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]
    base = measure(df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)), F.col(f"`{text}`").alias("q_text"), _host_of(host).alias("host")), "q_text")
    base = materialise(base.select(*own, "host", "measures"))
    flat = base.select("*", *(F.col(f"measures.{k}").alias(k) for k in MEASURES))
    judged = flat.select(*own, "host", "measures", F.expr(BASE_RULE).alias("base_failed"), *(F.expr(c).alias(f"f_{r}") for r, c in SOFT_RULES.items()))
    both = join_hot(judged, materialise(host_rates(judged)), "host", "n")
    failed = F.array_compact(F.array(*(F.when(F.col(f"f_{r}"), F.lit(r)) for r in SOFT_RULES)))
    refused = F.lit(False)
    for r in SOFT_RULES:
        refused = refused | (F.col(f"f_{r}") & (F.col(f"low_{r}") > TOLERATED))
    verdict = ~F.col("base_failed") & ~refused & (F.size(failed) < RULE_LIMIT)
    results = {"measures": F.col("measures"), "base_failed": F.col("base_failed"), "failed_rules": failed, "kept": verdict}
    named = base.select(*(F.col(o).alias(c) for o, c in zip(own, keep)))
    return both.select(*(F.col(o).alias(c) for o, c in zip(own, keep)), *(v.alias(free_name(named, k)) for k, v in results.items()))


def quality_filter(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `df` that the rules keep, with its columns.

    The texts are measured twice, for the sums by host and for the verdicts: to write measures beside whole rows would
    take a copy of the table. Of the hosts only those that are refused on a rule meet the rows.
    """
    own = [f"c{i}" for i in range(len(df.columns))]
    named = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(df.columns, own)), F.col(f"`{text}`").alias("q_text"), _host_of(host).alias("host"))
    flat = measure(named, "q_text").select(*own, "host", *(F.col(f"measures.{k}").alias(k) for k in MEASURES))
    faults = flat.select(*own, "host", _faults().alias("faults"))
    bit = {r: 2 << i for i, r in enumerate(SOFT_RULES)}
    rates = host_rates(faults.select("host", *((F.col("faults").bitwiseAND(b) != 0).alias(f"f_{r}") for r, b in bit.items())))
    refused = sum((F.when(F.col(f"low_{r}") > TOLERATED, b).otherwise(0) for r, b in bit.items()), F.lit(0))
    refused = materialise(rates.select("host", "n", refused.alias("refused")).filter("refused > 0"))
    # one condition on both sides of the join, so that it is not taken below it and measured for by itself
    both = join_hot(faults, refused, "host", "n").filter(F.col("faults").bitwiseAND(F.coalesce("refused", F.lit(0)).bitwiseOR(F.lit(1))) == 0)
    return both.select(*(F.col(o).alias(c) for o, c in zip(own, df.columns)))


def quality_digest(df: DataFrame) -> DataFrame:
    """One row per document: the measures of the base rules and the verdict."""
    out = quality_verdicts(df, keep=["doc_id"])
    return out.select("doc_id", *(F.col(f"measures.{k}") for k in MEASURES if k != "n_lines"), "base_failed", "kept")
