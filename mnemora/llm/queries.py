"""The queries opN_<name> and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, decontaminate, html_extract, language_id, license_scan, ngram_join, pii, quality_rules, token_counts, turn_repair, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.chat_digest(table(spark, folder, "conversations"))


def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, folder, "pages"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.spans_digest(table(spark, folder, "documents"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_digest(table(spark, folder, "documents"))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair_digest(table(spark, folder, "conversations"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_html_extract": op2_html_extract,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_language_id": op11_language_id,
    "op12_turn_repair": op12_turn_repair,
    "op13_whitening": op13_whitening,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    """Measures, failures by host, the beta prior by moments, and the verdicts."""
    rules = quality_rules.SOFT_RULES
    prior = ", ".join(f"sum({r})::DOUBLE / sum(n) AS m_{r}, sum({r}::DOUBLE * {r} / n) / sum(n) - (sum({r})::DOUBLE / sum(n)) ** 2 - (count(*) - 1) * (sum({r})::DOUBLE / sum(n)) * (1 - sum({r})::DOUBLE / sum(n)) / sum(n) AS v_{r}" for r in rules)
    weight = lambda r: f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {quality_rules.PRIOR_MIN}), {quality_rules.PRIOR_MAX}) ELSE {quality_rules.PRIOR_MAX} END"
    rates = ", ".join(f"({r} + m_{r} * {weight(r)}) / (n + {weight(r)}) AS r_{r}" for r in rules)
    weights = ", ".join(f"n + {weight(r)} AS w_{r}" for r in rules)
    refused = " OR ".join(f"(f_{r} AND r_{r} - sqrt(r_{r} * (1 - r_{r}) / (w_{r} + 1)) > {quality_rules.TOLERATED})" for r in rules)
    failed = " + ".join(f"f_{r}::INT" for r in rules)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY 1),
        ls AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        m AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[{quality_rules.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d JOIN ls USING (doc_id) LEFT JOIN cov USING (doc_id)),
        j AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"({c}) AS f_{r}" for r, c in rules.items())} FROM m),
        h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE f_{r}) AS {r}" for r in rules)} FROM j GROUP BY 1),
        p AS (SELECT {prior} FROM h), rate AS (SELECT host, {rates}, {weights} FROM h, p)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({refused}) AND {failed} < {quality_rules.RULE_LIMIT} AS kept FROM j JOIN rate USING (host)"""


_JACCARD_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3)),
    n AS (SELECT d.doc_id, count(gram) AS n FROM d LEFT JOIN g USING (doc_id) GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {ngram_join.PERCENT} * (x.n + y.n - shared)),
    c(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id)
    SELECT doc_id, n AS n_shingles, (SELECT min(root) FROM c WHERE c.id = n.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links FROM n"""

SQL: dict[str, str] = {
    "op5_ngram_join": _JACCARD_SQL,
    "op6_quality_rules": _quality_sql(),
}
