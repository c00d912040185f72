"""Text functions as column expressions; everything stays in the JVM.

White space is Unicode white space, word characters are Unicode letters and digits. Case is folded by ``lower`` with the
sharp s spelt out, which SQL engines without full case folding can repeat. All functions give null for null unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frames import let

#: Patterns that Java and RE2 read alike.
SPACE = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
TERM = r"[\p{L}\p{N}]+(?:[-_.:/][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{N}_]+"
#: A character of a script that is written without spaces (Thai, kana, ideographs, Hangul).
GRAM = r"[\x{e00}-\x{e7f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
CLAUSE = rf"^{SPACE}*(\d+(?:\.\d+)+)\.?{SPACE}+{NOT_SPACE}"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
CITED = r"\[cite:(\d{1,2})\]"
COMMENT = r"(?s)<!--.*?-->"
USED = r"<!--\s*used:([^>]*?)-->"
#: Letters of Vietnamese beyond ASCII, and the labels that a memory key may be given by.
VIETNAMESE = "[ăâđêôơưàảãạáằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]"
KEY_ALIASES = {
    "name": "nickname", "user_name": "nickname", "full_name": "nickname", "profession": "occupation", "job": "occupation", "role": "occupation", "company": "organization", "employer": "organization",
    "language": "response_language", "preferred_language": "response_language", "length": "response_length", "answer_length": "response_length", "format": "response_format", "style": "tone", "interest": "focus_area", "interests": "focus_area", "level": "expertise_level",
}
KEYS = ("nickname", "occupation", "organization", "response_language", "response_length", "response_format", "tone", "focus_area", "expertise_level")


def n_tokens(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.size(F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))).cast("long")


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalized(text: Column) -> Column:
    """Folded, white space collapsed: how headers, memories and summary items are compared."""
    return trimmed(F.regexp_replace(folded(text), SPACE + "+", " "))


def terms(text: Column) -> Column:
    """Search terms: folded words with inner joiners; of scripts without spaces also the characters and pairs of them."""

    def with_grams(low: Column) -> Column:
        pairs = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: F.concat(F.element_at(g, i), F.element_at(g, i + 1)))
        return let(F.regexp_extract_all(low, F.lit(GRAM), F.lit(0)), lambda g: F.concat(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), g, F.when(F.size(g) > 1, pairs(g)).otherwise(F.array().cast("array<string>"))))

    return let(folded(text), lambda low: F.when(low.rlike(GRAM), with_grams(low)).otherwise(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _only(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def language_label(text: Column) -> Column:
    """Label by majority script (th, ko, ja, zh, vi, en) or null below four letters; by script only, so accents read as vi."""

    def label(c: Column) -> Column:
        total = c["th"] + c["ko"] + c["kana"] + c["han"] + c["latin"]
        return (
            F.when(total < 4, None)
            .when(c["th"] * 2 > total, "th")
            .when(c["ko"] * 2 > total, "ko")
            .when((c["kana"] + c["han"]) * 2 > total, F.when(c["kana"] > 0, "ja").otherwise("zh"))
            .when(c["latin"] * 2 > total, F.when(c["wide"].rlike(VIETNAMESE), "vi").otherwise("en"))
        )

    # The rare scripts are only counted where the text is not Latin through and through.
    rest = lambda low: F.regexp_replace(low, r"[\x{0}-\x{24f}]+", "")
    counts = lambda x: F.struct(
        F.regexp_replace(x["low"], r"[\x{0}-\x{7f}]+", "").alias("wide"), _only(x["low"], "a-z").alias("latin"), _only(x["rest"], r"\x{e00}-\x{e7f}").alias("th"), _only(x["rest"], r"\x{ac00}-\x{d7a3}").alias("ko"), _only(x["rest"], r"\x{3040}-\x{30ff}").alias("kana"), _only(x["rest"], r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}").alias("han")
    )
    return let(folded(text), lambda low: let(F.struct(low.alias("low"), rest(low).alias("rest")), lambda x: let(counts(x), label)))


def clause_label(text: Column) -> Column:
    """The dotted number that opens a clause, or null."""
    label = F.regexp_extract(text, CLAUSE, 1)
    return F.when(label != "", label)


def ordinal(label: Column) -> Column:
    """A clause label as an array of numbers, which compares like a tuple."""
    return F.transform(F.split(label, r"\."), lambda x: x.cast("long"))


def clean_answer(text: Column) -> Column:
    """The answer a reader sees: no citation marks, no hidden comments."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"\[cite:\d+\]", ""), COMMENT, ""))


def normalize_answer(text: Column) -> Column:
    """Commas and ASCII punctuation off, articles off, spaces collapsed, lower case."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return trimmed(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the|and)\b", " "), SPACE + "+", " "))


def cited(text: Column) -> Column:
    """The numbers of the citation marks, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), lambda x: x.cast("long")))


def used_ids(text: Column) -> Column:
    """The summary items that an answer names as used: s followed by a number, each once."""
    raw = F.regexp_extract(text, USED, 1)
    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^s\d+$")))


def estimated_tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("long")


def title_from(text: Column, most: int = 42) -> Column:
    """A thread title from its first message: white space collapsed, cut with an ellipsis, a fallback where blank."""
    flat = trimmed(F.regexp_replace(text, SPACE + "+", " "))
    return F.when(flat == "", "New chat").when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def memory_key(key: Column) -> Column:
    """A key as the store takes it: a known name, an alias of one, or other:<slug>; empty where nothing is left."""
    plain = F.replace(F.replace(folded(trimmed(key)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    alias = plain
    for given, meant in KEY_ALIASES.items():
        alias = F.when(plain == given, F.lit(meant)).otherwise(alias)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.replace(alias, F.lit("_"), F.lit("-")), "[^a-z0-9-]+", "-"), "^-+|-+$", ""), 1, 63)
    return F.when(alias.isin(*KEYS) | alias.rlike(r"^other:[a-z0-9][a-z0-9-]{0,62}$"), alias).when(slug != "", F.concat(F.lit("other:"), slug)).otherwise("")


def email(address: Column) -> Column:
    return folded(trimmed(address))


def age_days(since: Column, now: Column) -> Column:
    """Elapsed days of 24 hours, not calendar days."""
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000).cast("long")


def age_phrase(since: Column, now: Column) -> Column:
    days = age_days(since, now)
    return F.when(days <= 1, "").otherwise(F.concat(F.lit("saved "), days.cast("string"), F.lit(" days ago")))


def relative_bucket(at: Column, now: Column) -> Column:
    days = age_days(at, now)
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Past week").when(days <= 30, "Past month").otherwise("Older")


def context_percent(used: Column, usable: Column) -> Column:
    """Share of the context in use, 0 to 100, rounded half to even."""
    return F.when(usable > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(used * 100 / usable).cast("int"))))


def content_id(prefix: str, *parts: Column) -> Column:
    """A stable id from the content: prefix and 24 hex digits of SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Overlap of two boxes [x0, y0, x1, y1] over the narrower width."""
    inner = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    return F.greatest(F.lit(0.0), inner) / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))


def replace_value(text: Column, old: str, new: str) -> Column:
    """Replaces a value however its white space is spelt in the text."""
    pattern = r"\s+".join("\\Q" + part.replace("\\E", "") + "\\E" for part in old.split())
    return F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))


def label_of(reply: Column, allowed: list[str]) -> Column:
    """The label in a judge's reply: the JSON field ``label``, else the only allowed word in it, else null."""
    parsed = F.lower(F.trim(F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.label")))
    inside = F.array_compact(F.array(*[F.when(F.lower(reply).rlike(rf"\b{w}\b"), F.lit(w)) for w in allowed]))
    return F.when(parsed.isin(*allowed), parsed).when(F.size(inside) == 1, inside[0])


def route_kind(path: Column) -> Column:
    """Parser kind of a file by its extension; null where the kind is not taken."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    kinds = {".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".tif": "image", ".tiff": "image"}
    out = F.lit(None).cast("string")
    for e, kind in kinds.items():
        out = F.when(ext == e, F.lit(kind)).otherwise(out)
    return out
