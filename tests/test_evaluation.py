"""Questions to report: retrieval, contexts, answers asked once each, grading, and the report's lines."""

import pytest

from mnemora.operators import evaluation as ev
from mnemora.operators.embedding import embed, hashing_embedder
from mnemora.sources import sinks


@pytest.fixture
def tables(spark):
    chunks = spark.createDataFrame([(1, "we use parquet\nfor tables", "decision", "p"), (2, "the cat sleeps " * 60, None, "q"), (3, None, "insight", None)], "id long, content string, category string, project_name string")
    messages = spark.createDataFrame([(7, 70, "parquet it is")], "id long, conversation_id long, content string")
    conversations = spark.createDataFrame([(70, "p")], "id long, project_name string")
    texts = [("memory_chunk", 1, "we use parquet for tables"), ("memory_chunk", 2, "the cat sleeps"), ("memory_chunk", 3, "nothing"), ("message", 7, "parquet it is")]
    return embed(spark.createDataFrame(texts, "source_type string, source_id long, content string"), hashing_embedder(32), "m", 32), chunks, messages, conversations


def test_questions_to_report(spark, tables, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def model(prompts, log=str(log)):
        import uuid

        for p in prompts:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
        return [p if "parquet" in p.split("Question:")[0] else "" for p in prompts]

    asked = [("q1", "storage", "use parquet", ["PARQUET", "orc"], None), ("q2", "pets", "cat sleeps", ["dog"], "q"), ("q3", "control", "", [], "nowhere"), ("q4", None, None, None, None), ("q1", "storage", "use parquet", ["PARQUET", "orc"], None)]
    questions = spark.createDataFrame(asked, "id string, category string, question string, expected_substrings array<string>, scope_project string")
    results = ev.evaluate(questions, ev.embed_questions(questions, hashing_embedder(32)), tables, model, limit=2)
    rows = {r.id: r for r in results.collect()}
    assert results.count() == 4 and sorted(rows) == ["q1", "q2", "q3", "q4"]
    assert len(list(log.iterdir())) == 8  # two calls a question, however often the result is read
    assert (rows["q1"].match, rows["q1"].cold_match) == ("PARQUET", None) and set(rows["q1"].retrieved) == {1, 7}
    assert "- [decision · p] we use parquet for tables" in rows["q1"].context and "- [? · p] parquet it is" in rows["q1"].context
    assert rows["q2"].retrieved == [2] and rows["q2"].match is None and len(rows["q2"].context) < 430 and rows["q2"].context.endswith("…")
    assert rows["q3"].retrieved == [] and rows["q3"].context == ev.NOTHING and rows["q4"].match is None
    total = ev.recall(results).first()
    assert (total.questions, total.hits_with, total.hits_cold, total.delta) == (4, 1, 0, 1)
    text = sinks.question_report(results)
    assert "| q1 | storage | ✓ PARQUET | ✗ |" in text and "### q2: cat sleeps" in text and "### q3" not in text and "- delta: **+1**" in text
    assert ev.recall(results.limit(0)).first().questions == 0
    with pytest.raises(ValueError):
        sinks.question_report(results, most=3)


def test_exports_lose_no_row(spark, tmp_path):
    df = spark.range(5)
    assert sinks.csv_text(df, most=5).decode("utf-8-sig").split() == ["id", "0", "1", "2", "3", "4"]
    with pytest.raises(ValueError):
        sinks.csv_text(df, most=4)
    with pytest.raises(ValueError):
        sinks.write_excel(df, str(tmp_path / "x.xlsx"), most=4)
