"""Problem 1: oversized items cut at natural boundaries.

Method: byte-range processing. A long text is cut into ranges of about RANGE characters; each range is moved to a natural
boundary near its nominal place and carries a left halo (the last OVERLAP tokens before it), so that it can be worked
alone. Workers detect the boundaries of their range; the boundary tables of an item's ranges are stitched by merging
(head, longest inner, tail) for each kind of boundary. For the pieces the tables of an item are read as one stream, whose
state is the tokens of the open piece, and lengths are summed as prefixes; the ranges then give the text by offset. So the
pieces are the same whatever the ranges. No worker needs more than one range of a text. Texts within a range are a single
range.

A token is a maximal run of characters without the Unicode property White_Space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import SPACES, bucketed_rank, bucketed_sum, fold_streams, in_groups, stage

LIMIT = 512
OVERLAP = 40
#: Characters of a range of a long text, and how far from its nominal end a boundary is looked for at a time.
RANGE = 32_768
SEARCH = 4_096
#: Blocks of a unit that are planned together, and rows that are ranked together.
RUN = 256
RANKED = 1_024

KINDS = ("paragraph", "line", "sentence", "word")
# Python's \s also takes U+001C to U+001F, which are no white space here.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _NS = f"[{_SPACE}]", f"[^{_SPACE}]"
_END = r"(?:\r\n|\r(?!\n)|[\n\x0b\x0c\x85\u2028\u2029])"
_CLOSERS = r"[\"'”’“‘»›«‹)\]}」』】）］]*"
TOKEN = re.compile(rf"{_NS}+")
SPACE_RUN = re.compile(rf"{_S}+")
BLANK_LINE = re.compile(rf"{_END}(?:(?!{_END}){_S})*{_END}{_S}*")
LINE_END = re.compile(rf"{_END}{_S}*")
SENTENCE_END = re.compile(rf"(?<=[.!?…]){_CLOSERS}{_S}+")
_STOPPED = re.compile(rf"[.!?…]{_CLOSERS}$")
_SEPARATORS = {0x1C: "x", 0x1D: "x", 0x1E: "x", 0x1F: "x"}
_HAS_SEPARATORS = re.compile("[\x1c-\x1f]")


def count_tokens(text: str) -> int:
    if _HAS_SEPARATORS.search(text):
        text = text.translate(_SEPARATORS)
    return len(text.split())


def gap_kind(before: str, gap: str) -> int:
    """The kind of boundary (index in KINDS) of the white space between a token and the next."""
    if gap != " ":
        if BLANK_LINE.search(gap):
            return 0
        if LINE_END.search(gap):
            return 1
    return 2 if _STOPPED.search(before) else 3


def segment_sizes(text: str) -> list[list[int]]:
    """Tokens of the segments of a text when cut at paragraphs, at lines too, and at sentences too."""
    if _HAS_SEPARATORS.search(text):
        text = text.translate(_SEPARATORS)
    paragraphs = BLANK_LINE.split(text)
    lines = [LINE_END.split(p) for p in paragraphs]
    sentences = [[len(s.split()) for s in SENTENCE_END.split(line)] for p in lines for line in p]
    return [[len(p.split()) for p in paragraphs], [len(line.split()) for p in lines for line in p], [n for line in sentences for n in line]]


def boundary_of(sizes: list[int], limit: int = LIMIT) -> str | None:
    """From (total, longest segment by paragraph, line, sentence): the first kind that works, None within the limit."""
    if sizes[0] <= limit:
        return None
    return next((k for k, n in zip(KINDS, sizes[1:]) if n <= limit), "word")


def longest(text: str) -> list[int]:
    """(total, longest segment by paragraph, line, sentence); finer kinds are only looked at where needed."""
    total = count_tokens(text)
    if total <= LIMIT:
        return [total, total, total, total]
    return [total, *(max(s) for s in segment_sizes(text))]


def anchor(text: str, at: int) -> int:
    """The token start after the coarsest boundary within SEARCH characters from ``at`` on (further where none is)."""
    end, size = len(text), SEARCH
    while at < end:
        # Two characters earlier, so that a boundary that began before is seen whole.
        window = text[max(0, at - 2) : at + size]
        for kind in (BLANK_LINE, LINE_END, SENTENCE_END, SPACE_RUN):
            for m in kind.finditer(window):
                place = max(0, at - 2) + m.end()
                if place >= at and m.end() < len(window):
                    return place
        if at + size >= end:
            break
        size *= 2
    return end


def left_halo(text: str, at: int, tokens: int = OVERLAP) -> int:
    """The offset of the token that is ``tokens`` before ``at``, or of the first."""
    size = 16 * tokens
    while True:
        low = max(0, at - size)
        starts = [low + m.start() for m in TOKEN.finditer(text[low:at])]
        if low == 0:
            return starts[-tokens] if len(starts) >= tokens else 0
        if len(starts) > tokens:  # the first may be cut
            return starts[-tokens]
        size *= 2


def slice_ranges(text: str, size: int = RANGE) -> Iterator[tuple[int, int, int, int]]:
    """(k, halo start, start, end) of the ranges of a text; every range but the first starts with a token."""
    start, k = 0, 0
    while True:
        end = len(text) if len(text) - start <= size else anchor(text, start + size)
        yield k, left_halo(text, start) if start else 0, start, end
        if end >= len(text):
            return
        start, k = end, k + 1


def range_table(halo: str, body: str) -> list:
    """The boundary table of a range: the kind of boundary before it, tokens, then head, longest, tail and segments by kind."""
    lead = None
    if halo:
        bare = halo.rstrip(SPACES)
        lead = gap_kind(bare, halo[len(bare) :])
    out = [lead, count_tokens(body)]
    for sizes in segment_sizes(body):
        out += [sizes[0], max(sizes), sizes[-1], len(sizes)]
    return out


def stitch(tables: list[list]) -> list[int]:
    """(total, longest by paragraph, line, sentence) from the boundary tables of an item, in order."""
    out = [sum(t[1] for t in tables)]
    for kind in range(3):
        best = tail = 0
        for t in tables:
            head, most, last, segments = t[2 + 4 * kind : 6 + 4 * kind]
            joined = t[0] is not None and t[0] > kind
            first = tail + head if joined else head
            best = max(best, tail, first, most)
            tail = first if segments == 1 else last
        out.append(max(best, tail))
    return out


def boundaries(text: str, own: int = 0) -> tuple[list[int], list[int], list[int]]:
    """(starts, ends, kinds) of the tokens from the offset ``own`` on; kinds[i] is the boundary before token i.

    The kind of the first token is that after the halo, 0 without one.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    first = next((i for i, (s, _) in enumerate(spans) if s >= own), len(spans))
    kinds = [0 if i == 0 else gap_kind(text[spans[i - 1][0] : spans[i - 1][1]], text[spans[i - 1][1] : spans[i][0]]) for i in range(first, len(spans))]
    return [s for s, _ in spans[first:]], [e for _, e in spans[first:]], kinds


class Planner:
    """Plans the pieces of an item whose boundary tables come in order; holds the tokens from the open piece's begin on.

    Each piece begins ``overlap`` tokens before its own part, which ends at the last of the coarsest boundaries in reach.
    """

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP) -> None:
        self.limit, self.overlap = limit, overlap
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[int] = []
        self.at = 0  # where the open piece's own part begins

    def feed(self, starts: list[int], ends: list[int], kinds: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens) of the pieces that more tokens settle."""
        self.starts += starts
        self.ends += ends
        self.kinds += kinds
        begin = max(0, self.at - self.overlap)
        # A cut needs the boundary behind the last token in reach.
        while len(self.starts) > begin + self.limit:
            reach = begin + self.limit
            best = min(self.kinds[self.at + 1 : reach + 1])
            cut = next(i for i in range(reach, self.at, -1) if self.kinds[i] == best)
            yield self.starts[begin], self.ends[cut - 1], cut - begin
            self.at, begin = cut, max(0, cut - self.overlap)
        del self.starts[:begin], self.ends[:begin], self.kinds[:begin]
        self.at -= begin

    def rest(self) -> Iterator[tuple[int, int, int]]:
        if self.at < len(self.starts):
            begin = max(0, self.at - self.overlap)
            yield self.starts[begin], self.ends[-1], len(self.starts) - begin


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text."""
    planner = Planner(limit, overlap)
    return [*planner.feed(*boundaries(text)), *planner.rest()]


_TABLE = "lead int, tokens long, " + ", ".join(f"{k}_{c} long" for k in ("p", "l", "s") for c in ("head", "most", "tail", "n"))
_TABLE_NAMES = [x.split()[0] for x in _TABLE.split(", ")]


def _items(df: DataFrame, key: str, text: str, extra: list[Column] = ()) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("body"), *extra)


def _ranges(items: DataFrame, carry: list[str], size: int) -> DataFrame:
    """Long texts as range rows, spread over the cluster."""
    schema = items.select("item_id", *carry).schema.simpleString()[7:-1].replace(":", " ") + ", k int, start long, own int, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                text, own = row.body, [getattr(row, c) for c in carry]
                yield pd.DataFrame([(row.item_id, *own, k, halo, start - halo, text[halo:end]) for k, halo, start, end in slice_ranges(text, size)], columns=["item_id", *carry, "k", "start", "own", "body"])

    return items.mapInPandas(run, schema).repartition("item_id", "k")


def token_sizes(df: DataFrame, key: str, text: str, carry: list[Column] = (), range_chars: int = RANGE) -> DataFrame:
    """(item_id, carried columns, tokens, paragraph, line, sentence): tokens of each text and of its longest segments.

    A null or blank text has no tokens. A repeated row comes at least once.
    """
    names = [c for c in df.select(*carry).columns] if carry else []
    items = _items(df, key, text, list(carry))
    schema = items.drop("body").schema.simpleString()[7:-1].replace(":", " ") + ", tokens long, paragraph long, line long, sentence long"

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [longest(t) if t else [0, 0, 0, 0] for t in pdf["body"]]
            out = pdf.drop(columns="body")
            for i, c in enumerate(("tokens", "paragraph", "line", "sentence")):
                out[c] = [s[i] for s in sizes]
            yield out

    whole = items.filter(F.coalesce(F.length("body"), F.lit(0)) <= range_chars).mapInPandas(small, schema)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [range_table(b[:own], b[own:]) for b, own in zip(pdf["body"], pdf["own"])]
            yield pd.concat([pdf.drop(columns=["body", "own", "start"]).reset_index(drop=True), pd.DataFrame(rows, columns=_TABLE_NAMES).astype("Int64")], axis=1)

    long = items.filter(F.length("body") > range_chars)
    # A hash keeps different texts of one id apart while their ranges are stitched.
    long = long.withColumn("copy", F.xxhash64("item_id", "body", *names))
    ranges = _ranges(long, [*names, "copy"], range_chars)
    tables = ranges.mapInPandas(table, ranges.drop("body", "own", "start").schema.simpleString()[7:-1].replace(":", " ") + ", " + _TABLE)
    width = len(names)

    def fold(group: tuple, rows: list[tuple]) -> Iterator[tuple]:
        once = {}
        for r in rows:
            once[r[width]] = r
        ordered = [once[k] for k in sorted(once)]
        yield (group[0], *ordered[0][:width], *stitch([[None if r[width + 1] is None else int(r[width + 1]), *map(int, r[width + 2 :])] for r in ordered]))

    # The tables of an item are a few numbers for each RANGE characters.
    stitched = in_groups(tables, ["item_id", "copy"], ["k"], fold, [*names, "k", *_TABLE_NAMES], schema)
    return whole.unionByName(stitched)


def _kind(tokens: str = "tokens") -> Column:
    return F.when(F.col("paragraph") <= LIMIT, 0).when(F.col("line") <= LIMIT, 1).when(F.col("sentence") <= LIMIT, 2).otherwise(3)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def ranked_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each block among the distinct blocks of its file, by block_order.

    Ties go to the block id. A file may hold a tenth of all rows, so ranks come from buckets of the order.
    """
    return bucketed_rank(blocks, ["doc_id"], F.floor(F.col("block_order") / RANKED), [F.col("block_order").asc_nulls_first(), F.col("item_id").asc_nulls_first()], "rank")


def unit_of_blocks(ranked: DataFrame, detections: DataFrame) -> DataFrame:
    """Adds ``unit``: the last of the file's starts at or before the block's rank (an as-of join in buckets of ranks)."""
    starts = detections.select("doc_id", F.explode("starts").alias("start")).filter("doc_id IS NOT NULL AND start IS NOT NULL").distinct()
    bucket = lambda c: F.floor(F.col(c) / RANKED).cast("long")
    # What a bucket inherits: the last start of the buckets before it.
    marks = starts.withColumn("b", bucket("start")).groupBy("doc_id", "b").agg(F.max("start").alias("top"))
    here = ranked.withColumn("b", bucket("rank")).select("doc_id", "b").distinct()
    grid = here.join(marks, ["doc_id", "b"], "full_outer")
    before = Window.partitionBy("doc_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select("doc_id", "b", F.max("top").over(before).alias("carried"))
    lines = ranked.withColumn("b", bucket("rank")).withColumn("at", F.col("rank")).withColumn("start", F.lit(None).cast("int"))
    marks_rows = starts.withColumn("b", bucket("start")).withColumn("at", F.col("start").cast("long")).select("doc_id", "b", "at", "start")
    both = lines.unionByName(marks_rows, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id", "b").orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("own", F.last("start", ignorenulls=True).over(upto)).filter("rank IS NOT NULL")
    return filled.join(carried, ["doc_id", "b"], "left").withColumn("unit", F.coalesce("own", "carried")).drop("b", "at", "start", "own", "carried")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """token_sizes of the distinct blocks, with doc_id and block_order."""
    sized = token_sizes(blocks, "block_id", "text", [F.col("doc_id"), F.col("block_order")])
    return sized.groupBy("item_id", "doc_id", "block_order").agg(*[F.max(c).alias(c) for c in ("tokens", "paragraph", "line", "sentence")])


def unit_sizes(sized: DataFrame, detections: DataFrame) -> DataFrame:
    """(doc_id, unit, tokens, kind): tokens of each unit; kind is the finest boundary among its oversized blocks, -1 if none."""
    members = unit_of_blocks(ranked_blocks(sized), detections).filter("unit IS NOT NULL")
    kind = F.when(F.col("tokens") > LIMIT, _kind()).otherwise(-1)
    return members.groupBy("doc_id", "unit").agg(F.sum("tokens").alias("tokens"), F.max(kind).alias("kind"))


def found(blocks: DataFrame, chunks: DataFrame, detections: DataFrame) -> DataFrame:
    """(item_table, item_id, boundary) of the items of more than LIMIT tokens.

    Nulls: a null text has no tokens, a file without detections or without an id has no units, a null block_order comes first. Starts
    behind the last block open empty units, which are within the limit.
    """
    # Staged, as blocks and units read it: a few numbers for each block.
    sized = stage(block_sizes(blocks))
    own = sized.filter(F.col("tokens") > LIMIT).select(F.lit("blocks").alias("item_table"), "item_id", _name(_kind()).alias("boundary"))
    # Within the limit by length alone: LIMIT tokens need LIMIT characters and the white space between.
    long = chunks.filter(F.length("source_text") > 2 * LIMIT)
    chunk = token_sizes(long, "chunk_id", "source_text").filter(F.col("tokens") > LIMIT).select(F.lit("chunks").alias("item_table"), "item_id", _name(_kind()).alias("boundary")).distinct()
    unit = (
        unit_sizes(sized, detections)
        .filter(F.col("tokens") > LIMIT)
        .select(F.lit("units").alias("item_table"), F.concat_ws(":", "doc_id", F.col("unit").cast("string")).alias("item_id"), F.when(F.col("kind") < 0, "block").otherwise(_name(F.col("kind"))).alias("boundary"))
    )
    return own.unionByName(chunk).unionByName(unit)


_PIECES = "start_char long, end_char long, tokens int"


def ranged_pieces(ranges: DataFrame, span: int = RANGE) -> DataFrame:
    """(item_id, piece, start_char, end_char, tokens, text) of items given as ranges (item_id, k, start, own, body).

    ``body`` begins with a halo of ``own`` characters; ``start`` is the offset of what follows it in the item. First every
    range gives its boundary table, then the tables of an item stream through the planner, then the ranges that a piece
    lies in give its text, so that one giant item is spread over the cluster but for its numbers. ``span`` is about the
    characters of a range.
    """
    ranges = stage(ranges.select("item_id", F.col("k").cast("int").alias("k"), F.col("start").cast("long").alias("start"), F.col("own").cast("int").alias("own"), "body"))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, k, start, own, body in zip(pdf["item_id"], pdf["k"], pdf["start"], pdf["own"], pdf["body"]):
                starts, ends, kinds = boundaries(body, own)
                out.append((item, k, [start + s - own for s in starts], [start + e - own for e in ends], kinds))
            yield pd.DataFrame(out, columns=["item_id", "k", "starts", "ends", "kinds"])

    tables = ranges.mapInPandas(table, "item_id string, k int, starts array<long>, ends array<long>, kinds array<int>")

    def step(state: list, row: tuple) -> Iterator[tuple]:
        _, starts, ends, kinds = row
        for a, b, n in state[0].feed(list(map(int, starts)), list(map(int, ends)), list(map(int, kinds))):
            yield state[1], a, b, n
            state[1] += 1

    planned = fold_streams(tables, ["item_id"], ["k"], lambda: [Planner(), 0], step, lambda state: [(state[1], *p) for p in state[0].rest()], ["k", "starts", "ends", "kinds"], "item_id string, piece long, " + _PIECES)
    planned = stage(planned)
    # A piece lies in the ranges from that of its start to that of its end; an as-of join on the starts of the ranges.
    # Both sides share buckets of ``span`` characters: a range is named in every bucket it reaches into.
    size = F.length("body") - F.col("own")
    placed = ranges.withColumn("stop", F.col("start") + size).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.greatest(F.col("start"), F.col("stop") - 1) / span))))
    wanted = planned.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_char") / span), F.floor((F.col("end_char") - 1) / span))))
    inside = (F.col("start_char") < F.col("stop")) & (F.col("end_char") > F.col("start"))
    met = wanted.join(placed.select("item_id", "bucket", "k", "start", "stop", "own", "body"), ["item_id", "bucket"]).filter(inside)
    low, high = F.greatest("start_char", "start"), F.least("end_char", "stop")
    cut = F.substr("body", (low - F.col("start") + F.col("own") + 1).cast("int"), (high - low).cast("int"))
    parts = met.select("item_id", "piece", "start_char", "end_char", "tokens", "k", cut.alias("text")).distinct()
    whole = parts.groupBy("item_id", "piece", "start_char", "end_char", "tokens").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.select("item_id", "piece", "start_char", "end_char", "tokens", "text")


def text_pieces(df: DataFrame, key: str, text: str, range_chars: int = RANGE) -> DataFrame:
    """(item_id, piece, start_char, end_char, tokens, text): the ordered pieces of every text of more than LIMIT tokens.

    Neighbours share OVERLAP tokens; laid at their offsets the pieces give the text from its first to its last token. The
    pieces do not depend on ``range_chars``. Repeated rows of one item give its pieces once; of different texts with one
    key the greatest stands.
    """
    items = _items(df, key, text).filter(F.length("body") > 2 * LIMIT).groupBy("item_id").agg(F.max("body").alias("body"))
    names = ["item_id", "piece", "start_char", "end_char", "tokens", "text"]

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, p, a, b, n, t[a:b]) for i, t in zip(pdf["item_id"], pdf["body"]) if count_tokens(t) > LIMIT for p, (a, b, n) in enumerate(pieces(t))], columns=names)

    whole = items.filter(F.length("body") <= range_chars).mapInPandas(small, "item_id string, piece long, " + _PIECES + ", text string")
    long = items.filter(F.length("body") > range_chars)
    # A long text of few long words is within the limit.
    over = token_sizes(long, "item_id", "body", range_chars=range_chars).filter(F.col("tokens") > LIMIT).select("item_id")
    cut = ranged_pieces(_ranges(long.join(over, "item_id", "left_semi"), [], range_chars).withColumn("start", F.col("start") + F.col("own")), range_chars)
    return whole.unionByName(cut)


def token_start(file: BinaryIO, at: int, size: int) -> int:
    """The byte where the first token behind the first white space from byte ``at`` on begins; the size where none does.

    Only windows of SEARCH bytes are read, from the next whole character on.
    """
    if at <= 0:
        return 0
    file.seek(at)
    lead = file.read(4)
    at += next((i for i, b in enumerate(lead) if b & 0xC0 != 0x80), len(lead))
    blank = False
    while at < size:
        file.seek(at)
        window = file.read(SEARCH)
        text = window.decode("utf-8", "ignore")  # a character that is cut off comes with the next window
        if not text:
            return size
        for m in (SPACE_RUN if not blank else TOKEN).finditer(text):
            if blank:
                return at + len(text[: m.start()].encode())
            token = TOKEN.search(text, m.end())
            if token:
                return at + len(text[: token.start()].encode())
            blank = True
            break
        at += len(text.encode())
    return size


def bytes_before(file: BinaryIO, at: int) -> str:
    """The text of the last OVERLAP tokens before byte ``at``, and what stands between them and it."""
    size = 16 * OVERLAP
    while True:
        low = max(0, at - size)
        file.seek(low)
        raw = file.read(at - low)
        raw = raw[next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), 0) :]
        text = raw.decode("utf-8")
        starts = [m.start() for m in TOKEN.finditer(text)]
        if low == 0 or len(starts) > OVERLAP:
            return text[starts[-OVERLAP] if len(starts) >= OVERLAP else 0 :]
        size *= 2


def file_pieces(files: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """text_pieces of UTF-8 files (path, size) that all executors can open: byte ranges, never a whole file in one task.

    Each range begins with the first token behind its nominal byte, which the range before finds, too; it is read with its
    halo, and its offset in characters is the sum of the lengths of the ranges before it. Files of at most LIMIT tokens
    give none.
    """
    spans = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))).alias("k"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, k in zip(pdf["path"], pdf["size"], pdf["k"]):
                with open(path, "rb") as file:
                    low, high = token_start(file, k * range_bytes, size), token_start(file, (k + 1) * range_bytes, size)
                    if low >= high:
                        continue
                    halo = bytes_before(file, low) if low else ""
                    file.seek(low)
                    body = file.read(high - low).decode("utf-8")
                yield pd.DataFrame([(path, int(k), len(halo), len(body), halo + body)], columns=["item_id", "k", "own", "chars", "body"])

    ranges = spans.repartition("path", "k").mapInPandas(read, "item_id string, k int, own int, chars long, body string")
    placed = bucketed_sum(stage(ranges), ["item_id"], F.floor(F.col("k") / RANKED), [F.col("k")], F.col("chars"), "start")
    out = ranged_pieces(placed.select("item_id", "k", "start", "own", "body"), range_bytes)
    several = out.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item_id")
    return out.join(several, "item_id", "left_semi")


def unit_pieces(blocks: DataFrame, detections: DataFrame, sized: DataFrame | None = None, run_blocks: int = RUN) -> DataFrame:
    """The pieces of the oversized units; a unit's text is that of its blocks with a blank line between.

    The blocks of a unit are its ranges in runs of ``run_blocks``, so that one unit may hold any number of blocks; offsets
    count in the unit by prefix sums of the run lengths. The pieces do not depend on the runs.
    """
    sized = block_sizes(blocks) if sized is None else sized
    members = unit_of_blocks(ranked_blocks(sized), detections).filter("unit IS NOT NULL")
    total = members.groupBy("doc_id", "unit").agg(F.sum("tokens").alias("all")).filter(F.col("all") > LIMIT)
    inside = members.join(total, ["doc_id", "unit"], "left_semi").select("doc_id", "unit", "rank", F.col("item_id").alias("block_id"))
    texts = blocks.groupBy("doc_id", "block_id").agg(F.max("text").alias("text"))
    rows = inside.join(texts, ["doc_id", "block_id"]).withColumn("run", F.floor((F.col("rank") - F.col("unit")) / run_blocks))

    def fold(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        doc, unit, run = key
        body = "".join((t or "") + "\n\n" for _, t in group)
        yield (f"{doc}:{int(unit)}", int(run), len(body), body)

    runs = in_groups(rows, ["doc_id", "unit", "run"], ["rank"], fold, ["rank", "text"], "item_id string, k int, size long, body string")
    # Between runs stands a blank line, so that a run needs no halo: the boundary before it is that of a paragraph.
    placed = bucketed_sum(runs, ["item_id"], F.floor(F.col("k") / RANKED), [F.col("k")], F.col("size"), "start")
    return ranged_pieces(placed.select("item_id", "k", "start", F.lit(0).alias("own"), "body"), 4 * RANGE)


def all_pieces(blocks: DataFrame, chunks: DataFrame, detections: DataFrame) -> DataFrame:
    """(item_table, item_id, piece, start_char, end_char, tokens, text) of blocks, chunks and units."""
    parts = {"blocks": text_pieces(blocks, "block_id", "text"), "chunks": text_pieces(chunks, "chunk_id", "source_text"), "units": unit_pieces(blocks, detections)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("item_table"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out
