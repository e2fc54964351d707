"""Session files (JSON lines) and Markdown files as tables, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import written

#: What is read of a line; block arrays stay text until it is known that they are arrays.
LINE = "type string, uuid string, parentUuid string, isSidechain boolean, timestamp string, sessionId string, cwd string, entrypoint string, gitBranch string, message string"
BLOCK = "type string, text string, name string, input string, content string"
MESSAGE = "role string, model string, content string"


def _content(kind: Column, blocks: Column, raw: Column) -> Column:
    """Text of a message: its string, or the texts and tool marks of its blocks, thoughts left out."""
    one = lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("[Tool: "), F.coalesce(b["name"], F.lit("?")), F.lit("]"))).when(b["type"] == "tool_result", F.substring(F.coalesce(b["content"], F.lit("")), 1, 500))
    return F.when(kind == "array", F.array_join(F.array_compact(F.transform(blocks, one)), "\n")).when(kind == "string", raw).otherwise(F.substring(F.coalesce(raw, F.lit("")), 1, 2000))


def session_lines(files: DataFrame) -> DataFrame:
    """Valid entries with a message of `files` (columns `path` and `content`, the bytes), in file order."""
    lines = files.select("path", F.sha2("content", 256).alias("file_hash"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_no", "line")).filter(tx.strip("line") != "")
    e = lines.filter(F.try_parse_json("line").isNotNull()).withColumn("e", F.from_json("line", LINE)).filter(F.substring(F.trim("e.message"), 1, 1) == "{")
    m = e.withColumn("m", F.from_json("e.message", MESSAGE)).withColumn("kind", F.when(F.get_json_object("e.message", "$.content[0]").isNotNull() | (F.substring(F.ltrim("m.content"), 1, 1) == "["), "array").when(F.col("m.content").isNotNull(), "string").otherwise("none"))
    m = m.withColumn("blocks", F.when(F.col("kind") == "array", F.coalesce(F.from_json("m.content", f"array<struct<{BLOCK.replace(' string', ':string')}>>"), F.array().cast(f"array<struct<{BLOCK.replace(' string', ':string')}>>"))))
    is_result = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    kind, role = F.col("e.type"), F.col("m.role")
    mapped = F.when((kind == "user") | (role == "user"), F.when(is_result, "tool_result").otherwise("user")).when((kind == "assistant") | (role == "assistant"), "assistant").when((kind == "system") | (role == "system"), "system").otherwise("user")
    calls = F.transform(F.filter(F.coalesce("blocks", F.array().cast(m.schema["blocks"].dataType)), lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.coalesce(b["name"], F.lit("")).alias("tool_name"), F.coalesce(b["input"], F.lit("{}")).alias("input")))
    return m.select(
        "path", "file_hash", "line_no", F.col("e.sessionId").alias("session_id"), F.col("e.uuid").alias("uuid"), F.col("e.parentUuid").alias("parent_uuid"), mapped.alias("role"),
        _content(F.col("kind"), F.col("blocks"), F.col("m.content")).alias("content"), calls.alias("tool_calls"), F.try_element_at(calls, F.lit(1))["tool_name"].alias("tool_name"),
        F.coalesce("e.isSidechain", F.lit(False)).alias("is_sidechain"), F.col("m.model").alias("model"), F.expr("try_cast(e.timestamp AS timestamp)").alias("created_at"), F.col("e.entrypoint").alias("entrypoint"), F.col("e.gitBranch").alias("git_branch"),
    )


def parse_sessions(files: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of session files; files without a session id drop out.

    Files are read and parsed once, into the shared folder; both tables are derived from there. The first and last entries in file order, not the earliest and latest, give a conversation its span; times
    that cannot be read become `as_of`.
    """
    lines = written(session_lines(files)).withColumn("created_at", F.coalesce("created_at", as_of))
    folder = F.element_at(F.split("path", "/"), -2)
    first = lambda c, when=None: F.min_by(F.col(c), F.when(when, F.col("line_no")) if when is not None else F.col("line_no"))
    conversations = lines.groupBy("path", "file_hash").agg(
        first("session_id", F.col("session_id").isNotNull()).alias("session_id"), first("created_at").alias("started_at"), F.max_by("created_at", "line_no").alias("ended_at"),
        first("model", (F.col("role") == "assistant") & F.col("model").isNotNull()).alias("model"), first("entrypoint", F.col("entrypoint").isNotNull()).alias("entrypoint"), first("git_branch", F.col("git_branch").isNotNull()).alias("git_branch"), F.count("*").cast("int").alias("message_count"),
    ).filter("session_id IS NOT NULL")
    decoded = F.when(folder == "-", F.lit(None)).otherwise(F.translate(folder, "-", "/"))
    conversations = conversations.withColumn("project_path", decoded).withColumn("project_name", F.coalesce(F.split_part("project_path", F.lit("/"), F.lit(-1)), F.lit("unknown")))
    messages = lines.drop("session_id").join(conversations.select("path", "session_id"), "path")
    return conversations, messages


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """`path`, `modificationTime` and `content` of the files below `root`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def ingest_sessions(spark: SparkSession, root: str, log: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and log rows of the files that the log does not have by path and hash."""
    files = read_files(spark, root, "*.jsonl").withColumn("file_hash", F.sha2("content", 256))
    new = files.join(log.select(F.col("file_path").alias("path"), "file_hash"), ["path", "file_hash"], "left_anti")
    conversations, messages = parse_sessions(new.select("path", "content"), as_of)
    rows = conversations.select(F.col("path").alias("file_path"), "file_hash", as_of.alias("ingested_at"), F.col("message_count").alias("record_count"))
    return conversations, messages, rows


def parse_plans(files: DataFrame, least: int = 50) -> DataFrame:
    """Plan files as one conversation with one message each: title, text, hash; short ones drop out."""
    text = F.decode("content", "UTF-8")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), text.alias("text"), F.col("modificationTime").alias("started_at")).filter(F.length(tx.strip("text")) >= least).withColumn("title", tx.title_of("text", name)).withColumn("session_id", tx.path_uuid("path"))


def parse_skills(files: DataFrame) -> DataFrame:
    """Skill files: name (of the folder if the text has none), description, version, triggers, body."""
    text = F.decode("content", "UTF-8")
    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.select("path", F.col("modificationTime").alias("file_modified"), text.alias("text"), folder.alias("folder"))
    rows = rows.select("path", "file_modified", F.coalesce(tx.front_matter("text", "name"), "folder").alias("name"), F.coalesce(tx.front_matter("text", "description"), F.lit("")).alias("description"), tx.front_matter("text", "version").alias("version"), tx.strip(F.regexp_replace("text", r"^---[\s\S]*?---", "")).alias("body"))
    return rows.withColumn("triggers", tx.triggers("description"))


def parse_prompts(files: DataFrame, least: int = 20, deepest: int | None = None, root: str = "") -> DataFrame:
    """Prompt files with their variables; `deepest` bounds the levels below `root` (a file in it is at level 1).

    `walk.read_named` reads files of a name without entering what is pruned or too deep.
    """
    rows = files.select("path", F.decode("content", "UTF-8").alias("content")).filter(F.length(tx.strip("content")) >= least)
    if deepest is not None:
        plain = lambda c: F.rtrim(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("/"))  # noqa: E731  without scheme and host
        rows = rows.filter(F.size(F.split(plain(F.col("path")), "/")) - F.size(F.split(plain(F.lit(root)), "/")) <= deepest)
    return rows.select("path", "content", tx.template_variables("content").alias("variables"), project_of("path").alias("project"))


def project_of(path: str) -> Column:
    """Project of a file: its settings folder, its repository, its shared drive, else its folder."""
    parts = F.split(path, "/")
    after = lambda name: F.try_element_at(parts, (F.array_position(parts, name) + 1).cast("int"))
    has = lambda name: F.array_contains(parts, name)
    return F.when(has(".claude"), "claude-config").when(has("GitHub"), after("GitHub")).when(has("Meine Ablage"), F.concat(F.lit("drive/"), after("Meine Ablage"))).otherwise(F.element_at(parts, -2))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON-lines file; blank lines and lines that begin with // or # are left out."""
    lines = spark.read.text(path).filter(~F.rlike(F.col("value"), F.lit(r"^\s*(//|#|$)")))
    return lines.select(F.from_json("value", "id string, category string, question string, expected_substrings array<string>, scope_project string, notes string").alias("q")).select("q.*").filter("id IS NOT NULL")
