"""Exports. Tables go out by Spark's writers; rendered reports are small by their own limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CATEGORIES


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV parts with a header; arrays as lists parted by semicolons."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def _bounded(df: DataFrame, most: int):
    """All rows of a table of at most `most` rows; a larger one raises, so no row is lost without notice."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_csv, which writes tables of any size")
    return rows


def csv_text(df: DataFrame, most: int = 100_000) -> bytes:
    """A table of at most `most` rows as one CSV text with a byte order mark, for spreadsheets."""
    return _bounded(df, most).to_csv(index=False).encode("utf-8-sig")


def write_excel(df: DataFrame, path: str, sheet: str = "export", most: int = 100_000) -> bool:
    """A table of at most `most` rows as a spreadsheet, if a writer is installed."""
    rows = _bounded(df, most)
    try:
        rows.to_excel(path, sheet_name=sheet[:31], index=False)
    except ImportError:
        return False
    return True


def context_markdown(chosen: DataFrame, project: str) -> str:
    """The chosen memories by category as declared; `chosen` has at most some tens of rows."""
    rows = chosen.select("category", "content", "tags", F.col("confidence").cast("double").alias("confidence")).collect()
    out = [f"# Memory of {project}", ""]
    for category in CATEGORIES:
        own = [r for r in rows if r.category == category]
        if own:
            out += [f"## {category.replace('_', ' ').title()}", ""]
            out += [f"- {' '.join(r.content.split())}" + (f" ({', '.join(r.tags[:5])})" if r.tags else "") + f" [{r.confidence:.2f}]" for r in own]
            out.append("")
    return "\n".join(out)


def question_report(results: DataFrame, title: str = "Memory evaluation", most: int = 10_000) -> str:
    """Recall with and without memory, a line a question, and the misses, of the results of an evaluation."""
    rows = sorted(results.limit(most + 1).collect(), key=lambda r: str(r.id))
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} questions")
    n, hits, cold = len(rows), sum(r.match is not None for r in rows), sum(r.cold_match is not None for r in rows)
    mark = lambda m: "✗" if m is None else f"✓ {m}"
    cell = lambda x: " ".join(str(x).split()).replace("|", "\\|")
    out = [f"# {title}", "", f"- with memory: **{hits}/{n}**", f"- without: **{cold}/{n}**", f"- delta: **{hits - cold:+d}**", "", "## Questions", "", "| ID | Category | with memory | without | retrieved |", "|---|---|---|---|---|"]
    out += [f"| {cell(r.id)} | {cell(r.category or '?')} | {cell(mark(r.match))} | {cell(mark(r.cold_match))} | {','.join(map(str, r.retrieved[:5])) or '—'} |" for r in rows]
    missed = [r for r in rows if r.match is None and r.category != "control"]
    if missed:
        out += ["", "## Misses", ""]
    for r in missed:
        out += [f"### {cell(r.id)}: {cell(r.question)}", f"- expected one of: `{', '.join(r.expected_substrings or [])}`", f"- retrieved: `{r.retrieved}`", f"- answer: {cell(r.answer)}", ""]
    return "\n".join(out) + "\n"


def eval_report(recall: DataFrame, title: str = "Retrieval evaluation") -> str:
    r = recall.first()
    return f"# {title}\n\n| questions | hits | recall |\n|---|---|---|\n| {r.questions} | {r.hits} | {r.recall} |\n"
