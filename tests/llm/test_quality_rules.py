"""Quality rules against a plain version, with the prior's moments, and edge cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mnemora.llm import quality_rules as q
from tests.test_queries import FOLDER


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if count[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def brute(rows):
    """Per doc_id: measures, base_failed, kept; rows are (doc_id, text, lang, source, ...)."""
    found = []
    for r in rows:
        n, chars, symbols, dup, rep, lines = m = measures(r[1])
        soft = {"symbols": 10 * symbols > n, "dup_lines": 10 * dup > 3 * lines, "repeats": 100 * rep > 20 * n, "word_length": chars > 15 * n or chars < 2 * n}
        found.append((r[0], r[3], m, n < 50 or 100 * rep > 50 * n, soft))
    hosts = Counter(h for _, h, *_ in found)
    total = len(found)
    refused = {}
    for rule in q.SOFT_RULES:
        bad = Counter(h for _, h, _, _, s in found if s[rule])
        mean = sum(bad.values()) / total
        var = sum(bad[h] ** 2 / n for h, n in hosts.items()) / total - mean * mean - (len(hosts) - 1) * mean * (1 - mean) / total
        weight = min(max(mean * (1 - mean) / var - 1, q.PRIOR_MIN), q.PRIOR_MAX) if var > 0 else q.PRIOR_MAX
        for h, n in hosts.items():
            rate = (bad[h] + mean * weight) / (n + weight)
            refused[h, rule] = rate - (rate * (1 - rate) / (n + weight + 1)) ** 0.5 > q.TOLERATED
    return {d: (*m[:5], base, not base and sum(s.values()) < q.RULE_LIMIT and not any(v and refused[h, r] for r, v in s.items())) for d, h, m, base, s in found}


def test_like_the_plain_version(spark):
    rnd = random.Random(4)
    words = ["a", "the", "of", "stone", "réel", "x#y", "|", "<b>", "long" * 5]
    rows = [(0, None, "en", "h0"), (1, "", "en", None), (2, " \t\n\x0b\x0c\r ", "en", "h1"), (3, "one", "en", "h1"), (4, "a b c a b c\x0ba b c", "en", "h1"), (5, "word " * 30_000, "en", "h2"), (6, "x" * 200_000, "en", "h2"), (7, "l\n" * 900, "en", "h2")]
    for i in range(8, 200):
        bad = i % 4 == 0
        pool = words if bad else [f"w{rnd.randrange(300)}" for _ in range(80)]
        rows.append((i, "".join(rnd.choice(pool) + rnd.choice((" ", " ", "  ", "\n", "\t")) for _ in range(rnd.randint(0, 160))), "en", "h_bad" if bad and i % 8 else f"h{i % 3}"))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in q.quality_digest(df).collect()}
    assert got == brute(rows) and len({v[-1] for v in got.values()}) == 2
    kept = q.quality_filter(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, v in got.items() if v[-1]}
    assert q.quality_digest(df.limit(0)).count() == 0
    clashing = q.quality_verdicts(df.withColumn("measures", F.lit(1)).withColumn("host", F.lit("x")).withColumn("Base_failed", F.lit(2)).withColumn("f_symbols", F.lit(3)))
    assert clashing.columns[-4:] == ["_measures", "_base_failed", "failed_rules", "_kept"]
    assert {r.doc_id: r._kept for r in clashing.select("doc_id", "_kept").collect()} == {d: v[-1] for d, v in got.items()}
    again = q.quality_digest(df.unionByName(df))
    assert again.count() == 2 * len(rows)


def test_hosts_decide(spark):
    """Hosts of the test tables are refused, and what goes by them is what was labelled bad; an accident on a clean host stays."""
    docs = spark.read.parquet(f"{FOLDER.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = q.quality_verdicts(docs).filter(f"NOT base_failed AND size(failed_rules) < {q.RULE_LIMIT}")
    gone, kept = found.filter("NOT kept"), found.filter("kept")
    assert gone.select("source").distinct().count() > 5
    labels = spark.read.parquet(f"{FOLDER.replace('sf0.001', 'sf0.01')}/labels.parquet")
    assert gone.join(labels, "doc_id").agg(F.avg("quality")).first()[0] < 0.1
    assert kept.join(labels, "doc_id").agg(F.avg("quality")).first()[0] > 0.95
    good = " ".join(f"w{k}" for k in range(60))
    bad = " ".join(f"#{k}" for k in range(20)) + " " + good
    rows = [(k, bad if k < 40 else good, "spam") for k in range(50)] + [(k, bad if k == 100 else good, "clean") for k in range(100, 400)]
    verdicts = {r.doc_id: r.kept for r in q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(verdicts[k] for k in range(40)) and all(verdicts[k] for k in range(40, 50)) and all(verdicts[k] for k in range(100, 400))


def test_the_filter_writes_no_copy_of_the_texts(spark, monkeypatch):
    from mnemora.llm import quality_rules

    seen = []
    whole = quality_rules.materialise
    monkeypatch.setattr(quality_rules, "materialise", lambda d: seen.append(whole(d)) or seen[-1])
    good = " ".join(f"word{k}" for k in range(80))
    texts = [good, good + " # # # # # # # # # #", good[:40], None, (good[:60] + "\n") * 3 + good, good + " a b c d" * 9, good + " #" * 30 + " a b c" * 12]
    rows = [(i, texts[(i * i + i // 11) % len(texts)] if i % 3 else good, [None, "h0", "h1", "h2"][i % 4] if i > 60 else "h3", i, "x") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, faults string").repartition(3)
    got = quality_rules.quality_filter(df)
    assert got.columns == df.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert not any("c1" in d.columns or "text" in d.columns for d in seen)  # columns of the table
    want = quality_rules.quality_verdicts(df)
    assert kept == sorted(map(tuple, want.filter("kept").select(df.columns).collect()), key=str) and 20 < len(kept) < 140
