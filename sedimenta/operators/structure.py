"""Operators on the ordered blocks of documents.

Blocks have doc_id, block_id, block_order, type, text; a document may hold a tenth of all rows, so order-dependent
operators take ranks and sums from buckets of the order and meet their neighbours by a join on the rank.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import bucketed_prefix, bucketed_rank, bucketed_sum, fold_streams, stage
from ..functions import text as T

STEP = 1_024
#: Points from the top within which repeated lines are headers, and pages on which they must repeat.
HEADER_TOP, HEADER_PAGES = 72, 3
#: When dotted numbers count as the structure of a document.
CLAUSES, COVERED, LARGEST = 3, 0.6, 0.9
#: Sizes of leaves in tokens.
LEAF_MIN, LEAF_TARGET, LEAF_MAX = 100, 256, 512


def ranked(blocks: DataFrame, name: str = "rank") -> DataFrame:
    """Adds the place of each block in its document; ties of block_order go to the block id."""
    return bucketed_rank(blocks, ["doc_id"], F.floor(F.col("block_order") / STEP), [F.col("block_order").asc_nulls_first(), F.col("block_id").asc_nulls_first()], name)


def running_headers(blocks: DataFrame, key: list[str], y0: Column, page: Column) -> DataFrame:
    """Keys of the blocks whose text stands at the top of at least HEADER_PAGES pages of the document."""
    top = blocks.withColumn("norm", T.normalized(F.col("text"))).filter((y0 <= HEADER_TOP) & F.length("text").between(1, 200) & F.col("type").isin("paragraph", "heading"))
    often = top.groupBy("doc_id", "norm").agg(F.countDistinct(page).alias("pages")).filter(F.col("pages") >= HEADER_PAGES).select("doc_id", "norm")
    return top.join(often, ["doc_id", "norm"], "left_semi").select(*key).distinct()


def caption_figures(blocks: DataFrame, page: Column) -> DataFrame:
    """(doc_id, block_id, figure_id): each caption with the nearest figure before it on its page (a backward as-of join)."""
    rows = blocks.filter(F.col("type").isin("figure", "caption")).withColumn("page", page)
    before = Window.partitionBy("doc_id", "page").orderBy(F.col("block_order"), F.col("block_id")).rowsBetween(Window.unboundedPreceding, -1)
    figure = F.last(F.when(F.col("type") == "figure", F.col("block_id")), ignorenulls=True).over(before)
    return rows.withColumn("figure_id", figure).filter("type = 'caption' AND figure_id IS NOT NULL AND page IS NOT NULL").select("doc_id", "block_id", "figure_id")


def continuations(blocks: DataFrame, page: Column, bbox: Column, top: float = 100.0) -> DataFrame:
    """(doc_id, block_id, next_id): neighbouring blocks that go on over a page break; the second begins above ``top``."""
    rows = ranked(blocks.withColumn("page", page).withColumn("bbox", bbox)).select("doc_id", "block_id", "rank", "type", "text", "page", "bbox")
    nxt = rows.select("doc_id", (F.col("rank") - 1).alias("rank"), F.col("block_id").alias("next_id"), F.col("type").alias("next_type"), F.col("text").alias("next_text"), F.col("page").alias("next_page"), F.col("bbox").alias("next_bbox"))
    pair = rows.join(nxt, ["doc_id", "rank"])
    open_end = ~F.col("text").rlike(r"[.!?:;][\"')\]]?\s*$")
    small = F.regexp_replace("next_text", r"^\s+", "").rlike(r"^[\p{Ll},;:)]")
    prose = (F.col("type") == "paragraph") & (F.col("next_type") == "paragraph") & open_end & small
    table = (F.col("type") == "table") & (F.col("next_type") == "table") & (T.horizontal_overlap(F.col("bbox"), F.col("next_bbox")) >= 0.7)
    return pair.filter((F.col("next_page") == F.col("page") + 1) & (F.get("next_bbox", F.lit(1)) <= top) & (prose | table)).select("doc_id", "block_id", "next_id")


def clause_starts(blocks: DataFrame) -> DataFrame:
    """(doc_id, rank, label, size): the dotted clauses of each document and the characters up to the next one.

    The size is a difference of prefix sums, so no document is gathered.
    """
    order = [F.col("block_order").asc_nulls_first(), F.col("block_id").asc_nulls_first()]
    sized = bucketed_prefix(blocks, ["doc_id"], F.floor(F.col("block_order") / STEP), order, {"rank": F.lit(1).cast("long"), "chars_before": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    # Staged: few and narrow rows, which the steps below read three times.
    starts = stage(sized.withColumn("label", T.clause_label(F.col("text"))).filter("label IS NOT NULL").select("doc_id", "rank", "label", "chars_before"))
    number = bucketed_rank(starts, ["doc_id"], F.floor(F.col("rank") / STEP), [F.col("rank")], "n").select("doc_id", "rank", "label", "n", "chars_before")
    after = number.select("doc_id", (F.col("n") - 1).alias("n"), F.col("chars_before").alias("chars_end"), F.col("label").alias("next_label"))
    totals = blocks.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("total"))
    both = number.join(after, ["doc_id", "n"], "left").join(totals, "doc_id")
    rising = F.coalesce(T.ordinal(F.col("next_label")) > T.ordinal(F.col("label")), F.lit(True))
    return both.select("doc_id", "rank", "label", (F.coalesce("chars_end", "total") - F.col("chars_before")).alias("size"), "total", rising.alias("rising"))


def natural_units(blocks: DataFrame) -> DataFrame:
    """(doc_id, unit, matches, coverage): heading, clause or none for each document."""
    per_doc = blocks.groupBy("doc_id").agg(
        F.sum(F.when(F.size("section_path") > 0, 1).otherwise(0)).alias("paths"),
        F.sum(F.when((F.col("type") == "heading"), 1).otherwise(0)).alias("headings"),
        F.bool_or((F.col("type") == "heading") & (T.trimmed(F.col("text")) != "")).alias("titled"),
    )
    clauses = clause_starts(blocks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.sum("size").alias("covered"), F.max("size").alias("largest"), F.max("total").alias("total"), F.bool_and("rising").alias("rising"))
    d = per_doc.join(clauses, "doc_id", "left")
    passed = (F.col("clauses") >= CLAUSES) & F.col("rising") & (F.col("covered") >= COVERED * F.col("total")) & (F.col("largest") <= LARGEST * F.col("covered"))
    unit = F.when(F.col("paths") > 0, "heading").when(F.coalesce("titled", F.lit(False)), "heading").when(F.coalesce(passed, F.lit(False)), "clause").otherwise("none")
    return d.select(
        "doc_id",
        unit.alias("unit"),
        F.when(F.col("paths") > 0, F.col("paths")).when(unit == "heading", F.col("headings")).when(unit == "clause", F.col("clauses")).otherwise(0).cast("long").alias("matches"),
        F.when(unit == "heading", F.lit(1.0)).when(unit == "clause", F.round(F.col("covered") / F.col("total"), 6)).otherwise(0.0).alias("coverage"),
    )


def clause_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, section): the heading of the clause each block stands in, for documents of clauses.

    The heading is filled down in buckets: within a bucket by a window, across buckets by the last heading before.
    """
    docs = natural_units(blocks).filter("unit = 'clause'").select("doc_id")
    rows = ranked(blocks).join(docs, "doc_id", "left_semi").withColumn("b", F.floor(F.col("rank") / STEP))
    first_line = F.substring(F.element_at(F.split(T.trimmed(F.col("text")), r"\r\n|\r|\n"), 1), 1, 120)
    rows = rows.withColumn("head", F.when(T.clause_label(F.col("text")).isNotNull(), first_line))
    lasts = rows.groupBy("doc_id", "b").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("rank"))).alias("last_head"))
    ahead = Window.partitionBy("doc_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("doc_id", "b", F.last("last_head", ignorenulls=True).over(ahead).alias("carried"))
    upto = Window.partitionBy("doc_id", "b").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("own", F.last("head", ignorenulls=True).over(upto)).join(carried, ["doc_id", "b"])
    return filled.select("doc_id", "block_id", F.coalesce("own", "carried").alias("section")).filter("section IS NOT NULL")


def markdown_parts(blocks: DataFrame) -> DataFrame:
    """Adds prefix, suffix and size of each block as Markdown; blank blocks are dropped."""
    level = F.least(F.greatest(F.size("section_path"), F.lit(1)), F.lit(6))
    kind = F.col("type")
    prefix = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" ")))
        .when((kind == "figure") & F.col("media_ref").isNotNull(), F.concat(F.lit("![]("), F.col("media_ref"), F.lit(")\n\n")))
        .when(kind == "list", "- ")
        .when(kind == "code", "```\n")
        .when(kind == "formula", "$$\n")
        .when(kind == "caption", "*")
        .when(kind == "speech_turn", "> ")
        .when(kind == "slide", "## ")
        .otherwise("")
    )
    suffix = F.when(kind == "code", "\n```").when(kind == "formula", "\n$$").when(kind == "caption", "*").otherwise("")
    out = blocks.filter(T.trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("prefix", prefix).withColumn("suffix", F.concat(suffix, F.lit("\n\n")))
    return out.withColumn("size", (F.length("prefix") + F.length("text") + F.length("suffix")).cast("long"))


def markdown_anchors(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, start, end): where each block's own text stands in the document's Markdown; headings have none."""
    order = [F.col("block_order").asc_nulls_first(), F.col("block_id").asc_nulls_first()]
    placed = bucketed_prefix(markdown_parts(blocks), ["doc_id"], F.floor(F.col("block_order") / STEP), order, {"before": F.col("size")})
    start = F.col("before") + F.length("prefix")
    return placed.filter("type <> 'heading'").select("doc_id", "block_id", start.alias("start"), (start + F.length("text")).alias("end"))


def fixed_windows(blocks: DataFrame, window: int = LEAF_TARGET) -> DataFrame:
    """(doc_id, chunk, n_words, first_block): windows of ``window`` words across the blocks of a document.

    Word numbers are the prefix sums of the block sizes plus the place in the block; blocks are cut, words never move.
    """
    rows = blocks.filter(~F.col("type").isin("heading")).withColumn("n", F.coalesce(T.n_tokens(F.col("text")), F.lit(0)))
    order = [F.col("block_order").asc_nulls_first(), F.col("block_id").asc_nulls_first()]
    r = bucketed_prefix(rows, ["doc_id"], F.floor(F.col("block_order") / STEP), order, {"rank": F.lit(1).cast("long"), "before": F.col("n")}).filter("n > 0")
    low, high = F.floor(F.col("before") / window), F.floor((F.col("before") + F.col("n") - 1) / window)
    cut = r.withColumn("chunk", F.explode(F.sequence(low, high)))
    size = F.least(F.col("before") + F.col("n"), (F.col("chunk") + 1) * window) - F.greatest(F.col("before"), F.col("chunk") * window)
    return cut.groupBy("doc_id", "chunk").agg(F.sum(size).alias("n_words"), F.min_by("block_id", "rank").alias("first_block"))


def section_groups(blocks: DataFrame) -> DataFrame:
    """(doc_id, group, n_blocks, section): runs of neighbouring blocks with one section path (gaps and islands)."""
    path = F.array_join("section_path", " / ")
    rows = ranked(blocks).select("doc_id", "rank", path.alias("section"))
    prev = rows.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("section").alias("prev"), F.lit(True).alias("has"))
    changed = rows.join(prev, ["doc_id", "rank"], "left").withColumn("turn", F.when(F.coalesce("has", F.lit(False)) & (F.col("prev") == F.col("section")), 0).otherwise(1).cast("long"))
    numbered = bucketed_sum(changed, ["doc_id"], F.floor(F.col("rank") / STEP), [F.col("rank")], F.col("turn"), "seen").withColumn("group", F.col("seen") + F.col("turn") - 1)
    return numbered.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("section").alias("section"))


def semantic_breaks(vectors: DataFrame, group: str, order: str, vector: str, share: float = 0.95) -> DataFrame:
    """(group, order, distance, piece): neighbours whose cosine distance is above the percentile open a new piece.

    A group may hold a third of all rows: neighbours meet by a join on the rank, and the percentile is read off the ranks
    of the distances, in buckets of a ten-thousandth.
    """
    rows = vectors.select(group, order, F.col(vector).cast("array<double>").alias("v"))
    r = bucketed_rank(rows, [group], F.floor(F.col(order) / STEP), [F.col(order)], "n")
    before = r.select(group, (F.col("n") + 1).alias("n"), F.col("v").alias("u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    distance = F.round(1 - dot(F.col("u"), F.col("v")) / F.sqrt(dot(F.col("u"), F.col("u")) * dot(F.col("v"), F.col("v"))), 9)
    d = stage(r.join(before, [group, "n"], "left").select(group, order, "n", F.when(F.col("u").isNotNull(), distance).alias("distance")))
    far = d.filter("distance IS NOT NULL")
    sizes = far.groupBy(group).agg((F.lit(share) * (F.count(F.lit(1)) - 1)).alias("at"))
    ranks = bucketed_rank(far, [group], F.floor(F.col("distance") * 10_000), [F.col("distance"), F.col(order)], "place").join(sizes, group)
    near = ranks.filter((F.col("place") == F.floor("at")) | (F.col("place") == F.ceil("at"))).groupBy(group).agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.first("at").alias("at"))
    limit = near.select(group, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("limit"))
    cut = F.when(F.col("distance") > F.col("limit"), 1).otherwise(0).cast("long")
    joined = d.join(limit, group, "left").withColumn("opens", cut)
    summed = bucketed_sum(joined, [group], F.floor(F.col("n") / STEP), [F.col("n")], F.col("opens"), "seen")
    return summed.select(group, order, "distance", (F.col("seen") + F.col("opens")).alias("piece"))


def majority_language(blocks: DataFrame) -> DataFrame:
    """(doc_id, language, n): the commonest language of the blocks, ties by name; documents without one are left out."""
    counts = blocks.filter("language IS NOT NULL").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "language")).alias("t"))
    return top.select("doc_id", F.col("t.language").alias("language"), (-F.col("t.m")).alias("n"))


_LEAF = "doc_id string, leaf int, kind string, section string, block_ids array<string>, n_tokens int, text string, span_start int, span_end int"


def split_sentences(words_of: list[tuple[str, int, int]], limit: int) -> list[tuple[int, int]]:
    """Token ranges of an oversized block: whole sentences packed up to the limit, longer sentences in word windows."""
    out, start = [], 0
    ends = [i + 1 for i, (w, _, _) in enumerate(words_of) if w[-1] in ".!?" or i + 1 == len(words_of)]
    begin = 0
    for end in ends:
        if end - start > limit and begin > start:
            out.append((start, begin))
            start = begin
        while end - start > limit:
            out.append((start, start + limit))
            start += limit
        begin = end
    if start < len(words_of):
        out.append((start, len(words_of)))
    return out


def leaf_chunks(blocks: DataFrame) -> DataFrame:
    """Leaves of each document: prose packed to the target within a section, special blocks alone, oversized blocks split.

    A small tail joins the prose leaf before it in its section. The fold holds the open pack and the last leaf only, so
    documents of any length come out whole; tables and cells that others stand for are dropped by a join before it.
    """
    import re

    token = re.compile(r"\S+")
    rows = ranked(blocks).select("doc_id", "rank", "block_id", "type", "text", F.array_join("section_path", " / ").alias("section"), "parent_block_id")
    inner = rows.filter(F.col("type").isin("table_row", "table_cell") & (F.col("parent_block_id") != ""))
    outer = inner.select(F.col("doc_id").alias("__doc"), F.col("parent_block_id").alias("__block"), F.when(F.col("type") == "table_row", "table").otherwise("table_cell").alias("__type")).distinct()
    nested = (F.col("type") == "table") | (F.col("parent_block_id") != "")
    rows = rows.join(outer, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("block_id") == F.col("__block")) & (F.col("type") == F.col("__type")) & nested, "left_anti")

    def put(state: dict, leaf: dict | None) -> Iterator[tuple]:
        """The last leaf goes out as the next one comes, or at the end."""
        last = state["last"]
        if last:
            yield (state["n"], last["kind"], last["section"], last["ids"], last["n"], last["text"], *last["span"])
            state["n"] += 1
        state["last"] = leaf

    def flush(state: dict) -> Iterator[tuple]:
        pack, last = state["pack"], state["last"]
        if not pack:
            return
        state["pack"] = []
        n = sum(p[1] for p in pack)
        if n < LEAF_MIN and last and last["kind"] == "prose" and last["section"] == pack[0][3] and last["n"] + n <= LEAF_MAX:
            last["ids"] += [p[0] for p in pack]
            last["text"] += "\n\n" + "\n\n".join(p[2] for p in pack)
            last["n"] += n
        else:
            yield from put(state, {"kind": "prose", "section": pack[0][3], "ids": [p[0] for p in pack], "text": "\n\n".join(p[2] for p in pack), "n": n, "span": (None, None)})

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        _, block_id, kind, text, section = row
        filled = bool(text and text.strip())
        if kind == "heading":
            yield from flush(state)
        elif kind != "paragraph":
            if kind in ("table", "table_row", "table_cell", "figure", "caption", "code", "formula", "list", "speech_turn", "slide"):
                yield from flush(state)
                if filled:
                    yield from put(state, {"kind": kind, "section": section, "ids": [block_id], "text": text, "n": len(token.findall(text)), "span": (None, None)})
        elif filled:
            spans = [(m.group(), m.start(), m.end()) for m in token.finditer(text)]
            if len(spans) > LEAF_MAX:
                yield from flush(state)
                for a, b in split_sentences(spans, LEAF_MAX):
                    s, e = spans[a][1], spans[b - 1][2]
                    yield from put(state, {"kind": "part", "section": section, "ids": [block_id], "text": text[s:e], "n": b - a, "span": (s, e)})
                return
            pack = state["pack"]
            if pack and (pack[0][3] != section or sum(p[1] for p in pack) + len(spans) > LEAF_TARGET):
                yield from flush(state)
            state["pack"].append((block_id, len(spans), text, section))

    def finish(state: dict) -> Iterator[tuple]:
        yield from flush(state)
        yield from put(state, None)

    return fold_streams(rows, ["doc_id"], ["rank"], lambda: {"pack": [], "last": None, "n": 0}, step, finish, ["rank", "block_id", "type", "text", "section"], _LEAF)


def chunk_tree(blocks: DataFrame) -> DataFrame:
    """(doc_id, level, chunk_id, parent_id, n_children, n_tokens): leaves, sections by path across gaps, and the document."""
    leaves = leaf_chunks(blocks).withColumn("chunk_id", T.content_id("chk_", F.col("doc_id"), F.lit("leaf"), F.array_join("block_ids", ","), F.coalesce(F.col("span_start").cast("string"), F.lit("")), F.col("text"), F.col("section")))
    named = leaves.filter("section <> ''").select("doc_id", "section").distinct().withColumn("section_id", T.content_id("chk_", F.col("doc_id"), F.lit("section"), F.col("section")))
    doc_id = T.content_id("chk_", F.col("doc_id"), F.lit("document"))
    leaf = leaves.join(named, ["doc_id", "section"], "left").withColumn("parent_id", F.coalesce("section_id", doc_id))
    low = leaf.select("doc_id", F.lit("leaf").alias("level"), "chunk_id", "parent_id", F.lit(0).cast("long").alias("n_children"), F.col("n_tokens").cast("long").alias("n_tokens"))
    mid = leaf.filter("section_id IS NOT NULL").groupBy("doc_id", F.col("section_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_tokens").alias("n_tokens"))
    mid = mid.select("doc_id", F.lit("section").alias("level"), "chunk_id", doc_id.alias("parent_id"), "n_children", "n_tokens")
    top = low.unionByName(mid).groupBy("doc_id").agg(F.sum(F.when(F.col("parent_id") == doc_id, 1).otherwise(0)).cast("long").alias("n_children"), F.sum(F.when(F.col("level") == "leaf", F.col("n_tokens")).otherwise(0)).alias("n_tokens"))
    top = top.select("doc_id", F.lit("document").alias("level"), doc_id.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), "n_children", "n_tokens")
    return low.unionByName(mid).unionByName(top)


def edit_diff(old: DataFrame, new: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, state): what an edit makes of each id: fresh, kept, moved (another parent) or stale (a full outer join)."""
    o = old.select(F.col(key), F.col(parent).alias("__old"), F.lit(True).alias("__in_old")).distinct()
    n = new.select(F.col(key), F.col(parent).alias("__new"), F.lit(True).alias("__in_new")).distinct()
    state = F.when(F.col("__in_old").isNull(), "fresh").when(F.col("__in_new").isNull(), "stale").when(F.col("__old").eqNullSafe(F.col("__new")), "kept").otherwise("moved")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))
