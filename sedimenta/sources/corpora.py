"""Corpora, question sets, judgements, conversations and result stores as tables."""

from __future__ import annotations

import html.parser
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PASSAGES = "_id string, title string, text string"


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """(passage_id, title, text) of JSON lines; blank texts are dropped."""
    rows = spark.read.schema(PASSAGES).json(path)
    return rows.filter(F.trim("text") != "").select(F.col("_id").alias("passage_id"), "title", "text")


def read_zipped_passages(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip archives of JSON lines; an archive streams line by line within one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        rows = []
                        with archive.open(name) as f:
                            for line in f:
                                if line.strip():
                                    x = json.loads(line)
                                    rows.append((x.get("_id"), x.get("title"), x.get("text")))
                                if len(rows) == 4_096:
                                    yield pd.DataFrame(rows, columns=["_id", "title", "text"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["_id", "title", "text"])

    return files.mapInPandas(run, PASSAGES).filter(F.trim("text") != "").select(F.col("_id").alias("passage_id"), "title", "text")


def strip_turn_markers(text):
    """Lines without their "|user|:" marks, blank ones dropped, joined by line ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\|\w+\|:\s*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), strip_turn_markers(F.col("text")).alias("text"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, passage_id, grade) of tab-separated judgements; grades up to 0 are dropped, the last row of a pair stands."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("query_id string, passage_id string, grade int").csv(path)
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    last = numbered.groupBy("query_id", "passage_id").agg(F.max_by("grade", "n").alias("grade"))
    return last.filter("grade > 0")


def source_parts(source):
    """(document, page) of a source such as SRS-<document>-page<n>."""
    return F.struct(F.nullif(F.regexp_extract(source, r"^[A-Z]+-(.+?)-page", 1), F.lit("")).alias("document"), F.try_to_number(F.regexp_extract(source, r"-page\s*(\d+)", 1), F.lit("999999")).cast("int").alias("page"))


def read_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, questions) of nested conversations with keys session_1, session_2 and so on.

    messages: (sample_id, session, place, speaker, dia_id, text); questions: (sample_id, question, answer, category, evidence).
    """
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    items = raw.select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    talk = items.select(F.get_json_object("v", "$.sample_id").alias("sample_id"), F.from_json(F.get_json_object("v", "$.conversation"), "map<string,string>").alias("c"))
    entry = talk.select("sample_id", F.explode("c").alias("key", "value")).filter(F.col("key").rlike(r"^session_\d+$"))
    turns = entry.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.posexplode(F.from_json("value", "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>")).alias("place", "m"))
    said = F.when(F.col("m.blip_caption").isNotNull(), F.concat(F.col("m.text"), F.lit(" [shares "), F.col("m.blip_caption"), F.lit("]"))).otherwise(F.col("m.text"))
    messages = turns.select("sample_id", "session", "place", F.col("m.speaker").alias("speaker"), F.col("m.dia_id").alias("dia_id"), said.alias("text"))
    qa = items.select(F.get_json_object("v", "$.sample_id").alias("sample_id"), F.explode(F.from_json(F.get_json_object("v", "$.qa"), "array<struct<question:string,answer:string,category:int,evidence:array<string>>>")).alias("q"))
    return messages, qa.select("sample_id", "q.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(key, row) of a result store of JSON lines; of a key that was stored again the last row stands."""
    rows = spark.read.schema("key string, row string, stored_at timestamp").json(path)
    w = Window.partitionBy("key").orderBy(F.col("stored_at").desc_nulls_last(), F.col("row").desc())
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("key", "row")


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.off = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.off += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.off -= tag in ("script", "style") and self.off > 0

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.out.append(data)


def plain_text(markup: str | None) -> str:
    """The text of HTML: blocks on lines of their own, white space collapsed, scripts and styles left out."""
    parser = _Text()
    parser.feed(markup or "")
    parser.close()
    return "\n".join(x for line in "".join(parser.out).split("\n") if (x := re.sub(r"\s+", " ", line).strip()))


def html_text(df: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, text) by plain_text, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [plain_text(x) for x in pdf[markup]]})

    return df.select(key, markup).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, text string")


def page_blocks(payload: str) -> list[tuple[int, str, str, list[float] | None]]:
    """(page, type, text, box) of a nested conversion answer, in reading order; children follow, pages are inherited."""
    out: list[tuple[int, str, str, list[float] | None]] = []

    def walk(node: object, page: int) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x, page)
        elif isinstance(node, dict):
            page = int(node.get("page", page))
            if node.get("block_type") and (node.get("html") or node.get("text")):
                box = node.get("bbox")
                box = [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])] if isinstance(box, list) and len(box) == 4 else None
                out.append((page, str(node["block_type"]).lower(), plain_text(node.get("html")) or str(node.get("text") or ""), box))
            walk(node.get("children") or [], page + 1 if str(node.get("block_type", "")).lower() == "document" else page)

    walk(json.loads(payload), 0)
    return out
