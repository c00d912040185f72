"""Converted documents: pages in reading order, decoration off, slides as blocks, Markdown, what a page is made of."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import bucketed_rank
from ..functions import text as T
from ..sources.corpora import plain_text
from . import structure

#: Slides that one caption must stand on before its picture counts as decoration, and characters that make a page digital.
REPEATED, DIGITAL = 3, 20


def repeated_figures(converted: DataFrame) -> DataFrame:
    """(doc_id, text): captions of pictures that stand on at least REPEATED slides of a file."""
    figures = converted.filter("block_type = 'figure' AND text IS NOT NULL AND text <> ''")
    return figures.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= REPEATED).select("doc_id", "text")


def slide_blocks(converted: DataFrame) -> DataFrame:
    """(doc_id, page, place, type, text, section) of converted slides: a slide block first, then its contents.

    Furniture, repeated pictures, pictures without a caption and blank blocks go; the first heading names the slide and is
    not said twice. A slide is small, so its window is.
    """
    kept = converted.filter(~F.coalesce("furniture", F.lit(False))).filter("text IS NOT NULL AND text <> ''").join(repeated_figures(converted).withColumn("block_type", F.lit("figure")), ["doc_id", "text", "block_type"], "left_anti")
    title = kept.groupBy("doc_id", "page").agg(F.min_by(F.struct("seq", "text"), F.when(F.col("block_type") == "heading", F.col("seq"))).alias("t"))
    j = kept.join(title, ["doc_id", "page"])
    section = F.coalesce("t.text", F.concat(F.lit("Slide "), F.col("page").cast("string")))
    head = title.select("doc_id", "page", F.lit(-1).alias("seq"), F.lit("slide").alias("type"), section.alias("text"), section.alias("section"))
    body = j.filter("t IS NULL OR seq <> t.seq").select("doc_id", "page", "seq", F.col("block_type").alias("type"), "text", section.alias("section"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")) - 1
    return head.unionByName(body).select("doc_id", "page", place.alias("place"), "type", "text", "section")


def reading_order(blocks: DataFrame, x0: Column, y0: Column) -> DataFrame:
    """Adds block_order: the place in the file by page, then top, then left; ties by the converter's own order."""
    return bucketed_rank(blocks.withColumn("__x", x0).withColumn("__y", y0), ["doc_id"], F.col("page"), [F.col("page"), F.col("__y").asc_nulls_first(), F.col("__x").asc_nulls_first(), F.col("seq")], "block_order").drop("__x", "__y")


def page_kinds(pages: DataFrame) -> DataFrame:
    """(doc_id, page, digital): a page is born digital with enough characters, or with any and a font; the rest is scanned."""
    return pages.select("doc_id", "page", ((F.col("chars") >= DIGITAL) | ((F.col("chars") > 0) & (F.col("fonts") > 0))).alias("digital"))


def converted_blocks(payloads: DataFrame) -> DataFrame:
    """(doc_id, seq, page, block_type, text, bbox, media_name, media_bytes, furniture) of converter answers (doc_id, payload).

    Leaves of the nested answer in order; pages count from 1, boxes are put in order, the first inline picture is decoded.
    Leaves without a page, a box or any content are left out; an answer that cannot be read gives no rows.
    """
    names = ["doc_id", "seq", "page", "block_type", "text", "bbox", "media_name", "media_bytes", "furniture"]
    known = {"sectionheader": "heading", "title": "heading", "table": "table", "figure": "figure", "picture": "figure", "listgroup": "list", "listitem": "list", "caption": "caption", "code": "code", "equation": "formula"}

    def leaves(node: object, page: object) -> Iterator[tuple[dict, object]]:
        if isinstance(node, list):
            for x in node:
                yield from leaves(x, page)
        elif isinstance(node, dict):
            here = node.get("page", node.get("page_id", page))
            if node.get("children"):
                yield from leaves(node["children"], here)
            else:
                yield node, here

    def picture(images: object) -> tuple[str | None, int | None]:
        for name, data in images.items() if isinstance(images, dict) else ():
            try:
                return str(name), len(base64.b64decode(data, validate=True))
            except (binascii.Error, TypeError, ValueError):
                continue
        return None, None

    def rows(doc: str, payload: str | None) -> Iterator[tuple]:
        try:
            tree = json.loads(payload or "")
        except ValueError:
            return
        for seq, (leaf, page) in enumerate(leaves(tree, None)):
            box = leaf.get("bbox")
            if not isinstance(page, (int, float)) or not isinstance(box, list) or len(box) != 4 or not all(isinstance(x, (int, float)) for x in box):
                continue
            kind = "".join(c for c in str(leaf.get("block_type") or "text").lower() if c.isalnum())
            text, (name, size) = plain_text(leaf.get("html") or leaf.get("text")), picture(leaf.get("images"))
            if text or size is not None:
                yield (doc, seq, int(page) + 1, known.get(kind, "paragraph"), text, [float(min(box[0], box[2])), float(min(box[1], box[3])), float(max(box[0], box[2])), float(max(box[1], box[3]))], name, size, kind in ("pageheader", "pagefooter"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for d, p in zip(pdf["doc_id"], pdf["payload"]) for r in rows(d, p)], columns=names)

    return payloads.select("doc_id", "payload").mapInPandas(run, "doc_id string, seq int, page int, block_type string, text string, bbox array<double>, media_name string, media_bytes int, furniture boolean")


def markdown(blocks: DataFrame, part_blocks: int = structure.STEP) -> DataFrame:
    """(doc_id, part, text): the Markdown of each document in parts of ``part_blocks`` places; the parts in order are the whole.

    A document may hold a third of all blocks, so it is never put together in one row. Tables whose rows stand apart and
    cells of cells are left out; rows of one table follow each other without a blank line.
    """
    rows = blocks.filter(F.col("type").isin("table_row", "table_cell") & F.col("parent_block_id").isNotNull())
    outer = rows.select(F.col("doc_id").alias("__d"), F.col("parent_block_id").alias("__b"), F.when(F.col("type") == "table_row", "table").otherwise("table_cell").alias("__t")).distinct()
    kept = blocks.join(outer, (F.col("doc_id") == F.col("__d")) & (F.col("block_id") == F.col("__b")) & (F.col("type") == F.col("__t")), "left_anti")
    r = structure.ranked(structure.markdown_parts(kept))
    after = r.select("doc_id", (F.col("rank") - 1).alias("rank"), F.col("type").alias("__next"), F.col("parent_block_id").alias("__np"))
    j = r.join(after, ["doc_id", "rank"], "left")
    grid = (F.col("type") == "table_row") & (F.col("__next") == "table_row") & F.col("parent_block_id").eqNullSafe(F.col("__np"))
    line = F.concat("prefix", "text", F.when(F.coalesce(grid, F.lit(False)), F.lit("\n")).otherwise(F.col("suffix")))
    parts = j.select("doc_id", F.floor(F.col("rank") / part_blocks).alias("part"), "rank", line.alias("line"))
    return parts.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("text"))


def with_languages(blocks: DataFrame) -> DataFrame:
    """The blocks with their language filled by script where it is missing."""
    return blocks.withColumn("language", F.coalesce("language", T.language_label(F.col("text"))))


def too_long(blocks: DataFrame, most: int) -> DataFrame:
    """(doc_id, n): the documents of more than ``most`` blocks, which a reader refuses."""
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """(block_id, type, target) with new edges put in; an edge that is there stays as it is."""
    return edges.select("block_id", "type", "target").unionByName(new.select("block_id", "type", "target")).distinct()


def read_env(text: str) -> dict[str, str]:
    """Names and values of an environment file: comments and blank lines off, quotes around a value off, the last one stands."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out
