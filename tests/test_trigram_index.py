"""Searches by postings of trigrams against the scans that they replace."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.adapters import Memory
from mnemora.operators import retrieval
from mnemora.operators import trigram_index as ti
from mnemora.plans import reports
from tests.test_queries import FOLDER


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["alpha", "beta", "Gamma ray", "ünïcode", "naïve café", "50%", "a_b", "x", "", "İstanbul", "漢字かな", "😀 smile", "tab\tline\nfeed", "zeta-eta"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(300)]
    rows += [(300 + i, "alpha beta alpha") for i in range(150)] + [(500, None), (501, ""), (502, "ab"), (7, "alpha seven again"), (503, "long " * 30_000 + "needle")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    return df, ti.TrigramIndex(spark, str(tmp_path_factory.mktemp("index")), "text").build(df)


def keys(df):
    return sorted(r.id for r in df.select("id").collect())


def test_terms_like_the_scan(built):
    df, index = built
    for term in ("GAMMA R", "ünï", "alpha%beta", "al_ha b", "50%", "ab", "", "漢字か", "😀 s", "İst", "line\nfe", "needle", "nowhere", "zeta-eta"):
        assert keys(ti.rows_like(df, index, term)) == keys(df.filter(reports.like("text", term))), term


def test_similarity_like_the_scan(built):
    df, index = built
    for term in ("gama ray", "naïve", "", "zeta eta beta"):
        for least in (0.0, 0.3, 0.95):
            assert ti.trigram_search(df, index, term, least, 400).collect() == retrieval.trigram_search(df, "text", term, "id", least, 400).collect(), (term, least)


def test_common_trigrams_in_several_files(spark, built, tmp_path, monkeypatch):
    df, _ = built
    monkeypatch.setattr(ti, "FILE_ROWS", 20)
    monkeypatch.setattr(ti, "NAMED", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these parts are tiny
    try:
        index = ti.TrigramIndex(spark, str(tmp_path / "index"), "text").build(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for term in ("alpha", "needle"):
        assert keys(ti.rows_like(df, index, term)) == keys(df.filter(reports.like("text", term)))
    assert index._read("postings", ti.WINDOW, ["alp"], "key long").select(F.input_file_name()).distinct().count() > 1


def test_rows_are_the_truth(spark, tmp_path):
    first = spark.createDataFrame([(1, "old words"), (2, "other words"), (3, "third")], "id long, text string")
    index = ti.TrigramIndex(spark, str(tmp_path / "index"), "text").build(first)
    now = spark.createDataFrame([(1, "new words"), (3, "third"), (4, "fourth words")], "id long, text string")
    index.add(now.filter("id IN (1, 4)"))
    for term in ("words", "old", "new words", "third", "fourth"):
        assert keys(ti.rows_like(now, index, term)) == keys(now.filter(reports.like("text", term)))
    empty = ti.TrigramIndex(spark, str(tmp_path / "empty"), "text").build(first.limit(0))
    assert ti.rows_like(first, empty, "words").count() == 0 and ti.trigram_search(first, empty, "words").count() == 0


def test_only_the_postings_of_the_term_are_read(built):
    _, index = built
    plan = index._read("postings", ti.WINDOW, ["alp", "lph"], "key long")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(gram" in plan.split("PushedFilters: [")[1] or "In(gram, [" in plan


def test_memory_search_like_the_report(spark, tmp_path):
    m = Memory(spark, FOLDER)
    index = ti.TrigramIndex(spark, str(tmp_path / "index"), "content").build(m.chunks)
    for term in ("src3", "tion the", "the", "zz"):
        assert ti.search_chunks(m.chunks, index, term).collect() == reports.search_chunks(m.chunks, term).collect(), term


def test_postings_are_dealt_as_lists(spark, built, tmp_path, monkeypatch):
    """A row holds the keys of a trigram in many texts, not one posting; slices of any size hold the same postings as the texts."""
    df, _ = built
    for chars in (ti.CHARS, 40):
        monkeypatch.setattr(ti, "CHARS", chars)
        own = df.coalesce(1).select(F.col("id").alias("key"), F.lower("text").alias("low"), ti.padded(F.col("text")).alias("padded"))
        lists = own.toArrow()
        rows = [(kind, g, lists["key"][start + k].as_py()) for start, end in ti._slices([len(t or "") for t in lists["low"].to_pylist()], 100) for kind, c in ((ti.WINDOW, "low"), (ti.WORD, "padded"))
                for grams, ends, at in [ti._lists([t or "" for t in lists[c].to_pylist()[start:end]], kind == ti.WORD)] for n, g in enumerate(grams) for k in at[ends[n] : ends[n + 1]]]
        want = [(ti.WINDOW, t[i : i + 3], k) for k, t in zip(lists["key"].to_pylist(), lists["low"].to_pylist()) if t for i in range(len(t) - 2)]
        said = df.select("id", F.explode(ti.trigrams(F.col("text"))).alias("g")).collect()
        assert set(rows) == {*want, *((ti.WORD, r.g, r.id) for r in said)}
    monkeypatch.undo()
    index = ti.TrigramIndex(spark, str(tmp_path / "lists"), "text").build(df)
    stored = spark.read.parquet(f"{index.root}/postings/1").filter("gram = 'alp' AND set = 'window'")
    assert stored.count() <= 4 < 100 < index._read("postings", ti.WINDOW, ["alp"], "key long").count()
