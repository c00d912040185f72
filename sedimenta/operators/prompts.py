"""Prompt assembly and the parsing of what models reply, as column expressions."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def last_relevant(last_used: Column, created: Column) -> Column:
    return F.coalesce(last_used, created)


def memory_line(key: Column, value: Column, age: Column, overrode: Column) -> Column:
    """ "- key: value (saved N days ago; overrides a wider memory)" with only the remarks that apply."""
    remark = F.concat_ws("; ", F.nullif(age, F.lit("")), F.when(overrode, "overrides a wider memory"))
    return F.concat(F.lit("- "), key, F.lit(": "), value, F.when(remark != "", F.concat(F.lit(" ("), remark, F.lit(")"))).otherwise(""))


def memory_sections(memories: DataFrame, most: int) -> DataFrame:
    """(owner_user_id, section): facts and preferences of each owner in the order of their lines, and a note on what is left out.

    memories: (owner_user_id, type, line, place) with place from 0 in the order of carrying; ``most`` lines are shown, so a
    section is small.
    """
    kept = memories.filter(F.col("place") < most)
    lines = lambda kind: F.array_join(F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("line")))), "\n")
    body = kept.groupBy("owner_user_id").agg(lines("fact").alias("facts"), lines("preference").alias("preferences"))
    over = memories.groupBy("owner_user_id").agg(F.sum((F.col("place") >= most).cast("long")).alias("over"))
    part = lambda title, c: F.when(c != "", F.concat(F.lit(title + "\n"), c))
    note = F.when(F.col("over") > 0, F.concat(F.col("over").cast("string"), F.lit(" more are not shown")))
    return body.join(over, "owner_user_id").select("owner_user_id", F.concat_ws("\n\n", part("Facts", F.col("facts")), part("Preferences", F.col("preferences")), note).alias("section"))


def facts(raw: Column, most: int, chars: int) -> Column:
    """The facts of a strict JSON list of strings: blank ones off, cut to ``chars``, at most ``most``; null where it is none."""
    read = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    return F.slice(F.transform(F.filter(F.transform(read, T.trimmed), lambda x: x != ""), lambda x: F.substring(x, 1, chars)), 1, most)


def operations(raw: Column, kinds: list[str], kind: str, text: str, most: int, chars: int) -> Column:
    """The operations of a lenient JSON list of objects: unknown kinds and blank texts are skipped, at most ``most`` are kept."""
    read = F.from_json(raw, "array<string>")
    each = F.transform(read, lambda x: F.struct(F.get_json_object(x, f"$.{kind}").alias("kind"), F.substring(T.trimmed(F.get_json_object(x, f"$.{text}")), 1, chars).alias("text")))
    return F.slice(F.filter(each, lambda x: x["kind"].isin(*kinds) & (F.coalesce(x["text"], F.lit("")) != "")), 1, most)


def rewrite(raw: Column, question: Column, most: int = 3) -> Column:
    """(query, candidates) of a reply with a rewritten question; whatever is wrong with it, the question itself is the query."""
    named = T.trimmed(F.get_json_object(raw, "$.query"))
    listed = F.slice(F.filter(F.from_json(F.get_json_object(raw, "$.candidates"), "array<string>"), lambda x: T.trimmed(x) != ""), 1, most)
    return F.struct(F.coalesce(F.nullif(named, F.lit("")), question).alias("query"), F.coalesce(listed, F.array().cast("array<string>")).alias("candidates"))


def sse_frames(body: Column) -> Column:
    """The frames of an event stream: (event, data) for each block between blank lines that has data."""
    field = lambda frame, name: F.regexp_extract(frame, rf"(?m)^{name}: ?(.*)$", 1)
    frames = F.transform(F.split(body, r"\n\n"), lambda f: F.struct(F.coalesce(F.nullif(field(f, "event"), F.lit("")), F.lit("message")).alias("event"), field(f, "data").alias("data")))
    return F.filter(frames, lambda f: f["data"] != "")


def prompt_items(summary: Column) -> Column:
    """A summary's items as a prompt shows them: ids kept, counters of use and folds off."""
    return F.regexp_replace(summary, r"(?m)^\[(s\d+)\|u:\d+\|f:\d+\] ", "[$1] ")


def usable_tokens(context: Column, reply: Column, share: float = 0.9) -> Column:
    """Tokens that a prompt may take: a share of the context less the reply, never below 0."""
    return F.greatest(F.floor(context * share).cast("long") - reply, F.lit(0).cast("long"))


def chars_per_token(chars: Column, tokens: Column, same_model: Column, default: float = 4.0) -> Column:
    """Measured characters of a token, between 1 and 8; the default for another model or without a measure."""
    return F.when(same_model & (tokens > 0) & (chars > 0), F.least(F.lit(8.0), F.greatest(F.lit(1.0), chars / tokens))).otherwise(F.lit(default))


def tool_status(key: Column, value: Column, scope: Column, most: int = 2_000) -> Column:
    """Why a memory that a tool wants to write is refused, or ok."""
    clean = T.trimmed(F.coalesce(value, F.lit("")))
    return F.when(T.memory_key(key) == "", "invalid_key").when(clean == "", "empty_value").when(F.length(clean) > most, "too_long").when(~F.coalesce(scope.isin("user", "thread", "project"), F.lit(False)), "unknown_scope").otherwise("ok")


def ip_bucket(address: str | None) -> str | None:
    """What an address is limited by: itself, or the /64 network of an IPv6 address; what is no address stands for itself."""
    try:
        found = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return address
    found = getattr(found, "ipv4_mapped", None) or found
    return str(found) if found.version == 4 else str(ipaddress.ip_network((int(found), 64), strict=False))


def hashed(df: DataFrame, column: str, name: str, hash_of) -> DataFrame:
    """Adds ``name``: a value that needs a Python function of one column, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = [hash_of(v) for v in pdf[column]]
            yield pdf

    kind = "long" if hash_of is term_hash else "string"
    return df.mapInPandas(run, df.schema.simpleString()[7:-1].replace(":", " ") + f", {name} {kind}")


def term_hash(term: str | None) -> int | None:
    """The 32-bit id of a search term in an index of hashed terms; different terms may share one."""
    return None if term is None else int.from_bytes(hashlib.blake2b(term.encode(), digest_size=4).digest(), "big")
