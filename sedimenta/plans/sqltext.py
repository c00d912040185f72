"""SQL fragments that say in DuckDB what ``functions.text`` says in Spark."""

from __future__ import annotations

from ..functions import text as T


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def n_tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(T.NOT_SPACE + '+')}))"


def folded(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, {quoted(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def collapsed(c: str) -> str:
    return trimmed(f"regexp_replace({c}, {quoted(T.SPACE + '+')}, ' ', 'g')")


def normalized(c: str) -> str:
    return collapsed(folded(c))


def terms(c: str) -> str:
    grams = f"regexp_extract_all({folded(c)}, {quoted(T.GRAM)})"
    return f"list_concat(regexp_extract_all({folded(c)}, {quoted(T.TERM)}), {grams}, list_transform(range(1, len({grams})), lambda i: {grams}[i] || {grams}[i + 1]))"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {quoted(T.WORD)})"


def count(c: str, pattern: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, {quoted(pattern)}, '', 'g')))"


def language_label(c: str) -> str:
    low = folded(c)
    thai, hangul = count(low, r"[\x{e00}-\x{e7f}]"), count(low, r"[\x{ac00}-\x{d7a3}]")
    kana, ideograph = count(low, r"[\x{3040}-\x{30ff}]"), count(low, r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]")
    latin = count(low, "[a-z]")
    total = f"({thai} + {hangul} + {kana} + {ideograph} + {latin})"
    return (
        f"CASE WHEN {total} < 4 THEN NULL WHEN {thai} * 2 > {total} THEN 'th' WHEN {hangul} * 2 > {total} THEN 'ko' WHEN ({kana} + {ideograph}) * 2 > {total} THEN CASE WHEN {kana} > 0 THEN 'ja' ELSE 'zh' END "
        f"WHEN {latin} * 2 > {total} THEN CASE WHEN regexp_matches({low}, {quoted(T.VIETNAMESE)}) THEN 'vi' ELSE 'en' END END"
    )


def clause_label(c: str) -> str:
    return f"nullif(regexp_extract({c}, {quoted(T.CLAUSE)}, 1), '')"


def clean_answer(c: str) -> str:
    marks = quoted(r"\[cite:\d+\]")
    return trimmed(f"regexp_replace(regexp_replace({c}, {marks}, '', 'g'), {quoted(T.COMMENT)}, '', 'g')")


def normalize_answer(c: str) -> str:
    articles = quoted(r"\b(a|an|the|and)\b")
    return collapsed(f"regexp_replace(regexp_replace(lower({c}), {quoted(T.PUNCTUATION)}, '', 'g'), {articles}, ' ', 'g')")


def answer_words(c: str) -> str:
    return f"list_filter(string_split({normalize_answer(c)}, ' '), lambda x: x <> '')"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({b}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda y: y = w))))), 0)"


def memory_key(c: str) -> str:
    plain = f"replace(replace({folded(trimmed(c))}, ' ', '_'), '-', '_')"
    alias = (
        f"CASE WHEN {plain} IN ('name', 'user_name', 'full_name') THEN 'nickname' WHEN {plain} IN ('profession', 'job', 'role') THEN 'occupation' WHEN {plain} IN ('company', 'employer') THEN 'organization' "
        f"WHEN {plain} IN ('language', 'preferred_language') THEN 'response_language' WHEN {plain} IN ('length', 'answer_length') THEN 'response_length' WHEN {plain} = 'format' THEN 'response_format' "
        f"WHEN {plain} = 'style' THEN 'tone' WHEN {plain} IN ('interest', 'interests') THEN 'focus_area' WHEN {plain} = 'level' THEN 'expertise_level' ELSE {plain} END"
    )
    slug = f"left(regexp_replace(regexp_replace(replace({alias}, '_', '-'), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 63)"
    known = "('nickname', 'occupation', 'organization', 'response_language', 'response_length', 'response_format', 'tone', 'focus_area', 'expertise_level')"
    return f"CASE WHEN {alias} IN {known} OR regexp_matches({alias}, '^other:[a-z0-9][a-z0-9-]{{0,62}}$') THEN {alias} WHEN {slug} <> '' THEN 'other:' || {slug} ELSE '' END"
