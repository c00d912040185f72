"""The queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..frames import table
from . import conversations as p5
from . import mixing as p7
from . import packing as p6
from . import pairs as p4
from . import pii as p2
from . import quality as p8
from . import scans as p3
from . import splitting as p1


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1.found(table(spark, d, "blocks"), table(spark, d, "chunks"), table(spark, d, "structure_detections"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p1.all_pieces(table(spark, d, "blocks"), table(spark, d, "chunks"), table(spark, d, "structure_detections"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5.found(table(spark, d, "thread_messages"), table(spark, d, "message_reports"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return p5.turns(table(spark, d, "thread_messages"), table(spark, d, "message_reports"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2.found(*[table(spark, d, t) for t in ("thread_messages", "memories", "message_reports", "given_names")])


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return p2.redacted(p2.sources(*[table(spark, d, t) for t in ("thread_messages", "memories", "message_reports")]), table(spark, d, "given_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3.found(table(spark, d, "converted_blocks"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return p3.paragraphs(table(spark, d, "converted_blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.found(table(spark, d, "requesta_items"), table(spark, d, "locomo_questions"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return p6.containers(table(spark, d, "documents"))


def p6_fills(spark: SparkSession, d: str) -> DataFrame:
    return p6.fills(p6_containers(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return p7.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return p7.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8.found(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return p8.stats(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_turns": p5_turns,
    "p6_containers": p6_containers,
    "p6_fills": p6_fills,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}
_SPACE = r"\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_BLANK = rf"'^[{_SPACE}\x{{200b}}]*$'"
_TRIM = rf"'^[{_SPACE}]+|[{_SPACE}]+$'"
#: Whole conversations of (conv_id, position, role, content, blank): the same checks for threads and for stored lists.
_WHOLE = """w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY position) AS nr, lead(blank) OVER (PARTITION BY conv_id ORDER BY position) AS nb FROM m),
    g AS (SELECT conv_id FROM w GROUP BY 1 HAVING NOT bool_and(blank) AND count(position) = count(*) AND min(position) = 1 AND max(position) = count(*) AND count(DISTINCT position) = count(*) AND bool_and(role IN ('user', 'assistant')) AND arg_min(role, position) = 'user'
    AND NOT bool_or(role = 'assistant' AND coalesce(nr, '') = 'assistant') AND NOT bool_or(role = 'user' AND blank) AND NOT bool_or(role = 'user' AND NOT coalesce(nr = 'assistant' AND NOT nb, false)))
    SELECT src_table, conv_id, position - 1 AS turn, role, content FROM m SEMI JOIN g USING (conv_id)"""

#: The defect of each conversation by the same checks; an undefined one is whole.
_DEFECTS = """w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY position) AS nr, lead(blank) OVER (PARTITION BY conv_id ORDER BY position) AS nb FROM m),
    g AS (SELECT src_table, conv_id, CASE WHEN bool_and(blank) THEN 'empty' WHEN count(position) < count(*) OR min(position) <> 1 OR max(position) <> count(*) OR count(DISTINCT position) <> count(*) OR NOT bool_and(role IN ('user', 'assistant')) OR arg_min(role, position) <> 'user'
    OR bool_or(role = 'assistant' AND coalesce(nr, '') = 'assistant') OR bool_or(role = 'user' AND blank) THEN 'broken' WHEN bool_or(role = 'user' AND NOT coalesce(nr = 'assistant' AND NOT nb, false)) THEN 'missing_reply' END AS defect FROM w GROUP BY 1, 2) SELECT * FROM g WHERE defect IS NOT NULL"""
_THREADS = rf"m AS (SELECT DISTINCT 'thread_messages' AS src_table, thread_id AS conv_id, position::BIGINT AS position, coalesce(lower(regexp_replace(role, {_TRIM}, '', 'g')), '') AS role, content, content IS NULL OR regexp_matches(content, {_BLANK}) AS blank FROM thread_messages)"
_STORED = rf"""r AS (SELECT DISTINCT report_id, conversation FROM message_reports WHERE json_valid(conversation) AND json_type(conversation) = 'ARRAY'), x AS (SELECT report_id, unnest(json_extract(conversation, '$[*]')) AS x, generate_subscripts(json_extract(conversation, '$[*]'), 1)::BIGINT AS position FROM r),
    m AS (SELECT 'message_reports' AS src_table, report_id AS conv_id, position, coalesce(lower(regexp_replace(CASE WHEN json_type(x, '$.role') = 'VARCHAR' THEN json_extract_string(x, '$.role') END, {_TRIM}, '', 'g')), '') AS role, json_extract_string(x, '$.content') AS content, coalesce(regexp_matches(json_extract_string(x, '$.content'), {_BLANK}), true) AS blank FROM x)"""

SQL: dict[str, str] = {
    "p5_found": rf"""SELECT * FROM (WITH {_THREADS}, {_DEFECTS}) UNION ALL SELECT * FROM (WITH {_STORED}, {_DEFECTS})
    UNION ALL SELECT DISTINCT 'message_reports', report_id, CASE WHEN coalesce(regexp_matches(conversation, {_BLANK}), true) OR CASE WHEN json_valid(conversation) THEN json_type(conversation) = 'NULL' OR (json_type(conversation) = 'ARRAY' AND json_array_length(conversation) = 0) ELSE false END THEN 'empty' ELSE 'broken' END FROM message_reports
    WHERE NOT coalesce(CASE WHEN json_valid(conversation) THEN json_type(conversation) = 'ARRAY' AND json_array_length(conversation) > 0 END, false)""",
    "p5_turns": rf"""SELECT * FROM (WITH {_THREADS}, {_WHOLE}) UNION ALL SELECT * FROM (WITH {_STORED}, {_WHOLE})""",
    "p8_stats": p8_stats,
}
_SPACE = r"\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_BLANK = rf"'^[{_SPACE}\x{{200b}}]*$'"
_TRIM = rf"'^[{_SPACE}]+|[{_SPACE}]+$'"
#: Whole conversations of (conv_id, position, role, content, blank): the same checks for threads and for stored lists.
_WHOLE = """w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY position) AS nr, lead(blank) OVER (PARTITION BY conv_id ORDER BY position) AS nb FROM m),
    g AS (SELECT conv_id FROM w GROUP BY 1 HAVING NOT bool_and(blank) AND count(position) = count(*) AND min(position) = 1 AND max(position) = count(*) AND count(DISTINCT position) = count(*) AND bool_and(role IN ('user', 'assistant')) AND arg_min(role, position) = 'user'
    AND NOT bool_or(role = 'assistant' AND coalesce(nr, '') = 'assistant') AND NOT bool_or(role = 'user' AND blank) AND NOT bool_or(role = 'user' AND NOT coalesce(nr = 'assistant' AND NOT nb, false)))
    SELECT src_table, conv_id, position - 1 AS turn, role, content FROM m SEMI JOIN g USING (conv_id)"""

#: The defect of each conversation by the same checks; an undefined one is whole.
_DEFECTS = """w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY position) AS nr, lead(blank) OVER (PARTITION BY conv_id ORDER BY position) AS nb FROM m),
    g AS (SELECT src_table, conv_id, CASE WHEN bool_and(blank) THEN 'empty' WHEN count(position) < count(*) OR min(position) <> 1 OR max(position) <> count(*) OR count(DISTINCT position) <> count(*) OR NOT bool_and(role IN ('user', 'assistant')) OR arg_min(role, position) <> 'user'
    OR bool_or(role = 'assistant' AND coalesce(nr, '') = 'assistant') OR bool_or(role = 'user' AND blank) THEN 'broken' WHEN bool_or(role = 'user' AND NOT coalesce(nr = 'assistant' AND NOT nb, false)) THEN 'missing_reply' END AS defect FROM w GROUP BY 1, 2) SELECT * FROM g WHERE defect IS NOT NULL"""
_THREADS = rf"m AS (SELECT DISTINCT 'thread_messages' AS src_table, thread_id AS conv_id, position::BIGINT AS position, coalesce(lower(regexp_replace(role, {_TRIM}, '', 'g')), '') AS role, content, content IS NULL OR regexp_matches(content, {_BLANK}) AS blank FROM thread_messages)"
_STORED = rf"""r AS (SELECT DISTINCT report_id, conversation FROM message_reports WHERE json_valid(conversation) AND json_type(conversation) = 'ARRAY'), x AS (SELECT report_id, unnest(json_extract(conversation, '$[*]')) AS x, generate_subscripts(json_extract(conversation, '$[*]'), 1)::BIGINT AS position FROM r),
    m AS (SELECT 'message_reports' AS src_table, report_id AS conv_id, position, coalesce(lower(regexp_replace(CASE WHEN json_type(x, '$.role') = 'VARCHAR' THEN json_extract_string(x, '$.role') END, {_TRIM}, '', 'g')), '') AS role, json_extract_string(x, '$.content') AS content, coalesce(regexp_matches(json_extract_string(x, '$.content'), {_BLANK}), true) AS blank FROM x)"""

SQL: dict[str, str] = {
    "p5_found": rf"""SELECT * FROM (WITH {_THREADS}, {_DEFECTS}) UNION ALL SELECT * FROM (WITH {_STORED}, {_DEFECTS})
    UNION ALL SELECT DISTINCT 'message_reports', report_id, CASE WHEN coalesce(regexp_matches(conversation, {_BLANK}), true) OR CASE WHEN json_valid(conversation) THEN json_type(conversation) = 'NULL' OR (json_type(conversation) = 'ARRAY' AND json_array_length(conversation) = 0) ELSE false END THEN 'empty' ELSE 'broken' END FROM message_reports
    WHERE NOT coalesce(CASE WHEN json_valid(conversation) THEN json_type(conversation) = 'ARRAY' AND json_array_length(conversation) > 0 END, false)""",
    "p5_turns": rf"""SELECT * FROM (WITH m AS (SELECT DISTINCT 'thread_messages' AS src_table, thread_id AS conv_id, position::BIGINT AS position, coalesce(lower(regexp_replace(role, {_TRIM}, '', 'g')), '') AS role, content, content IS NULL OR regexp_matches(content, {_BLANK}) AS blank FROM thread_messages), {_WHOLE})
    UNION ALL SELECT * FROM (WITH r AS (SELECT DISTINCT report_id, conversation FROM message_reports WHERE json_valid(conversation) AND json_type(conversation) = 'ARRAY'), x AS (SELECT report_id, unnest(json_extract(conversation, '$[*]')) AS x, generate_subscripts(json_extract(conversation, '$[*]'), 1)::BIGINT AS position FROM r),
    m AS (SELECT 'message_reports' AS src_table, report_id AS conv_id, position, coalesce(lower(regexp_replace(CASE WHEN json_type(x, '$.role') = 'VARCHAR' THEN json_extract_string(x, '$.role') END, {_TRIM}, '', 'g')), '') AS role, json_extract_string(x, '$.content') AS content, coalesce(regexp_matches(json_extract_string(x, '$.content'), {_BLANK}), true) AS blank FROM x), {_WHOLE})""",
    "p8_stats": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM t)
    SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, ''))::DOUBLE / len(w), 6) ELSE 0.0::DOUBLE END AS mean_word_length,
    CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[\p{{L}}\p{{N}}{_SPACE}]', '', 'g'))::DOUBLE / length(text), 6) ELSE 0.0::DOUBLE END AS symbol_ratio,
    CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…]["''”’»)\]]*[{_SPACE}]*$')))::DOUBLE / len(l), 6) ELSE 0.0::DOUBLE END AS ended_lines,
    CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(cw, lower(regexp_replace(x, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')))))::DOUBLE / len(w), 6) ELSE 0.0::DOUBLE END AS common_share FROM w, (SELECT list(DISTINCT lower(word)) AS cw FROM common_words)""",
}
