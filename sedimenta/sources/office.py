"""Office files as ordered blocks, read with the standard library only.

Files come as (path, content) rows, for example from the binaryFile source; one file is one row, and its blocks come out
as rows. Archives are checked before anything is inflated. A file that cannot be read gives one row of type ``error``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits of an archive: entries, bytes when inflated, ratio of inflated to packed bytes; and cells of a workbook.
ENTRIES, INFLATED, RATIO, CELLS = 5_000, 400_000_000, 200, 2_000_000
BLOCKS = "path string, block_order int, type string, text string, section_path array<string>, parent int, part string, metadata map<string,string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


class Refused(ValueError):
    """A file that is not read."""


def open_archive(content: bytes) -> zipfile.ZipFile:
    """The archive, or Refused where it is broken or would inflate beyond the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise Refused(str(error)) from error
    infos = archive.infolist()
    size = sum(i.file_size for i in infos)
    if len(infos) > ENTRIES or size > INFLATED or any(i.file_size > 10_000_000 and i.file_size > RATIO * max(1, i.compress_size) for i in infos):
        raise Refused("the archive is too large when inflated")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:2_000]:
        raise Refused("a document type definition")
    return ElementTree.fromstring(data)


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    if root is None:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/") if not r.get("Target", "").startswith("/") else r.get("Target").lstrip("/") for r in root}


def docx_blocks(content: bytes) -> Iterator[tuple]:
    """(type, text, section path, parent, part, metadata): headings open sections, tables come with rows and cells."""
    body = _xml(open_archive(content), "word/document.xml")
    if body is None:
        raise Refused("no document part")
    body = body.find(f"{_W}body")
    sections: list[str] = []
    n = 0
    say = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = say(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = re.match(r"(?i)heading\s*(\d)", name)
            if not text:
                continue
            if level:
                del sections[int(level[1]) - 1 :]
                sections.append(text)
                yield "heading", text, list(sections), None, "body", {"heading_level": level[1]}
            else:
                kind = "list" if node.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph"
                yield kind, text, list(sections), None, "body", {"style": name} if name else {}
            n += 1
        elif node.tag == f"{_W}tbl":
            rows = [[say(cell).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            table = n
            yield "table", "\n".join(" | ".join(r) for r in rows), list(sections), None, "body", {}
            n += 1
            for i, cells in enumerate(rows):
                row = n
                yield "table_row", " | ".join(cells), list(sections), table, "body", {"row": str(i)}
                n += 1
                for cell in cells:
                    yield "table_cell", cell, list(sections), row, "body", {}
                    n += 1


def _column(ref: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def cell_text(value: str | None, kind: str, shared: list[str], dated: bool = False) -> str:
    """A stored cell as text: shared strings, truth values, whole numbers without a point, dates from their serial."""
    if value is None:
        return ""
    if kind == "s":
        return " ".join(shared[int(value)].split()) if int(value) < len(shared) else ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in ("str", "inlineStr", "e"):
        return " ".join(value.split())
    try:
        number = float(value)
    except ValueError:
        return value
    if dated:
        import datetime

        day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)
        return day.date().isoformat() if number == int(number) else day.isoformat(sep=" ", timespec="seconds")
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def xlsx_blocks(content: bytes) -> Iterator[tuple]:
    """A grid header and its rows for each sheet; of merged cells the first has the text, formulas give their stored result."""
    archive = open_archive(content)
    book = _xml(archive, "xl/workbook.xml")
    if book is None:
        raise Refused("no workbook part")
    strings = _xml(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings.findall(f"{_S}si")] if strings is not None else []
    styles = _xml(archive, "xl/styles.xml")
    dated: set[int] = set()
    if styles is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
        xfs = styles.find(f"{_S}cellXfs")
        for i, xf in enumerate(xfs if xfs is not None else []):
            code = int(xf.get("numFmtId", 0))
            if 14 <= code <= 22 or re.search(r"(?i)[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, ""))):
                dated.add(i)
    links, n, seen = _relations(archive, "xl/workbook.xml"), 0, 0
    for sheet in book.iter(f"{_S}sheet"):
        part = _xml(archive, links.get(sheet.get(f"{_R}id"), ""))
        if part is None:
            continue
        title = sheet.get("name", "")
        # Merged ranges by their bounds: a range over a whole sheet is one entry, not a set of its cells.
        merged: list[tuple[int, int, int, int]] = []
        for m in part.iter(f"{_S}mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            if not b:
                continue
            top, bottom = int(re.sub(r"\D", "", a)), int(re.sub(r"\D", "", b))
            left, right = _column(a), _column(b)
            merged.append((top, bottom, left, right))
        grid = []
        for row in part.iter(f"{_S}row"):
            number = int(row.get("r", len(grid) + 1))
            cells: dict[int, str] = {}
            here = [m for m in merged if m[0] <= number <= m[1]]
            for at, c in enumerate(row.findall(f"{_S}c")):
                seen += 1
                if seen > CELLS:
                    raise Refused("too many cells")
                place = _column(c.get("r", "")) if c.get("r") else at
                if any(left <= place <= right and (number, place) != (top, left) for top, _, left, right in here):
                    continue
                inline = c.find(f"{_S}is")
                value = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else c.findtext(f"{_S}v")
                text = cell_text(value, c.get("t", "n"), shared, int(c.get("s", 0)) in dated)
                if text:
                    cells[place] = text
            if cells:
                grid.append((number, [cells.get(i, "") for i in range(max(cells) + 1)]))
        if not grid:
            continue
        head = n
        extra = {"grid": title} | ({"hidden": "true"} if sheet.get("state") in ("hidden", "veryHidden") else {})
        width = max(len(cells) for _, cells in grid)
        yield "table", "| " + " | ".join([*grid[0][1], *[""] * (width - len(grid[0][1]))]) + " |", [title], None, title, extra
        n += 1
        for number, cells in grid[1:]:
            yield "table_row", "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |", [title], head, title, {**extra, "row": str(number)}
            n += 1


def _shapes(tree: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The shapes of a slide, groups opened up."""
    for node in tree:
        if node.tag == f"{_P}grpSp":
            yield from _shapes(node)
        elif node.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}pic"):
            yield node


def pptx_blocks(content: bytes) -> Iterator[tuple]:
    """Titles, paragraphs, tables, pictures and notes of the slides, in the order of the presentation."""
    archive = open_archive(content)
    deck = _xml(archive, "ppt/presentation.xml")
    if deck is None:
        raise Refused("no presentation part")
    links = _relations(archive, "ppt/presentation.xml")
    parts = [links[i.get(f"{_R}id")] for i in deck.iter(f"{_P}sldId") if i.get(f"{_R}id") in links]
    lines = lambda node: [x for p in node.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
    for number, part in enumerate(parts, 1):
        slide = _xml(archive, part)
        tree = slide.find(f"{_P}cSld/{_P}spTree") if slide is not None else None
        if tree is None:
            continue
        title, where = "", {"slide": str(number)}
        for shape in _shapes(tree):
            if shape.tag == f"{_P}pic":
                name = shape.find(f"{_P}nvPicPr/{_P}cNvPr")
                yield "figure", (name.get("descr") or "") if name is not None else "", [title] if title else [], None, part, where
                continue
            table = shape.find(f".//{_A}tbl")
            if table is not None:
                rows = [" | ".join(" ".join(lines(c)) for c in r.findall(f"{_A}tc")) for r in table.findall(f"{_A}tr")]
                yield "table", "\n".join(rows), [title] if title else [], None, part, where
                continue
            holder = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            if holder is not None and holder.get("type") in ("title", "ctrTitle"):
                title = " ".join(lines(shape))
                if title:
                    yield "slide", title, [title], None, part, where
                continue
            for line in lines(shape):
                yield "paragraph", line, [title] if title else [], None, part, where
        for link in _relations(archive, part).values():
            if "notesSlide" in link and (notes := _xml(archive, link)) is not None:
                text = "\n".join(x for x in lines(notes) if not x.isdigit())
                if text:
                    yield "paragraph", text, [title] if title else [], None, part, {**where, "speaker_notes": "true"}


def workbook_facts(content: bytes) -> dict[str, int]:
    """What a workbook is made of, read as a stream: sheets, cells, formulas, formulas with a stored result, pictures.

    A workbook whose formulas have no stored results was never calculated; cells are counted before anything is kept.
    """
    archive = open_archive(content)
    facts = dict.fromkeys(("sheets", "cells", "formulas", "stored", "pictures"), 0)
    for name in archive.namelist():
        if re.fullmatch(r"xl/media/.+", name):
            facts["pictures"] += 1
        if not re.fullmatch(r"xl/worksheets/[^/]+\.xml", name):
            continue
        facts["sheets"] += 1
        with archive.open(name) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{_S}c":
                    facts["cells"] += 1
                    if facts["cells"] > CELLS:
                        raise Refused("too many cells")
                    if node.find(f"{_S}f") is not None:
                        facts["formulas"] += 1
                        facts["stored"] += bool(node.findtext(f"{_S}v"))
                    node.clear()
                elif node.tag == f"{_S}row":
                    node.clear()
    return facts


PARSERS = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pptx": pptx_blocks}


def parse(files: DataFrame) -> DataFrame:
    """Blocks of (path, content) rows; kinds without a parser, broken and refused files give one error row each."""
    routed = files.select("path", "content", T.route_kind(F.col("path")).alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, kind in zip(pdf["path"], pdf["content"], pdf["kind"]):
                try:
                    if kind not in PARSERS:
                        raise Refused("no parser for this kind of file")
                    if content is None:
                        raise Refused("no content")
                    rows = list(PARSERS[kind](bytes(content)))
                    if not any(r[1].strip() for r in rows):
                        raise Refused("no text")
                    out += [(path, i, *r) for i, r in enumerate(rows)]
                except (Refused, ElementTree.ParseError, KeyError, ValueError, zipfile.BadZipFile) as error:
                    out.append((path, 0, "error", str(error), [], None, None, {}))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"parent": "Int64"})

    return routed.mapInPandas(run, BLOCKS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all office files under a path."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))
