"""Problem 3: text of scanned pages repaired into continuous paragraphs.

Method: a vocabulary trie of the words of all pages is intersected with a Levenshtein automaton for each doubtful word,
which gives every candidate within the allowed edits (usual confusions of characters count as one edit); candidates are
ranked with the words around them. Where the edits alone are no proof, the words around must know the candidate, and the
word as it stands is ranked with it. Then running heads and page numbers are removed, whatever the furniture flag says,
broken words are joined and the lines are reflowed.

Files may be of any length: pages are worked in buckets of PAGES pages that know the body lines next to their borders,
counts are grouped, and the trie is cut into shards that each meet every doubtful word type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import fold_streams, in_groups, stage

PAGES = 64
#: Blocks at the top and the foot of a page that may be its number, and pages that a line must open to be a running head.
TOPS, AGAIN = 2, 2
#: Share of the height of the text on a page below which notes may stand.
NOTES = 0.8
_NOTE = re.compile(r"^\s*(?:\[?\d{1,3}\]?[.)]?|[*†‡§])\s+\S")
#: A word is seen so many times oftener than its misreading.
OFTENER = 8
EDITS = 2
#: Word types that are asked for, and vocabulary words of a trie, in one task.
ASKED, TRIE = 50_000, 50_000

#: Usual confusions of scanned characters, right form and what is read.
CONFUSED = [
    ("e", "c"), ("c", "e"), ("t", "+"), ("i", "!"), ("i", "1"), ("i", "l"), ("i", "|"), ("l", "1"), ("l", "i"), ("l", "|"), ("l", "!"), ("o", "0"), ("s", "5"), ("s", "$"), ("g", "9"), ("g", "q"),
    ("b", "6"), ("b", "8"), ("z", "2"), ("a", "@"), ("q", "9"), ("é", "6"), ("è", "6"), ("ó", "6"), ("ò", "6"), ("ô", "6"), ("ö", "6"), ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("â", "a"),
    ("ä", "a"), ("ö", "o"), ("ó", "o"), ("ô", "o"), ("ü", "u"), ("ú", "u"), ("ü", "ii"), ("í", "i"), ("ñ", "n"), ("ç", "c"), ("ß", "b"), ("ß", "8"), ("m", "rn"), ("rn", "m"), ("m", "nn"), ("d", "cl"),
    ("cl", "d"), ("u", "ii"), ("ii", "u"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("n", "ri"), ("ri", "n"), ("b", "lo"), ("k", "lc"), ("y", "v"),
]
_ODD = re.compile(r"[^\W_]*[\d+!|$@ﬁﬂﬀﬃ][^\W_]*")
#: Each character spelt out as the simplest that it is read as, so that misreadings fold to one form.
_FOLD = str.maketrans({
    "0": "o", "1": "i", "!": "i", "l": "i", "|": "i", "5": "s", "$": "s", "6": "b", "8": "b", "9": "g", "q": "g", "+": "t", "2": "z", "@": "a", "c": "e", "d": "ei", "h": "ii", "u": "ii", "m": "rn", "w": "vv", "ﬁ": "fi", "ﬂ": "fi", "ﬀ": "ff",
    "é": "b", "è": "b", "ê": "e", "ó": "b", "ò": "b", "ô": "b", "ä": "a", "à": "a", "á": "a", "â": "a", "ö": "b", "ü": "ii", "ú": "ii", "ß": "b", "ñ": "n", "í": "i", "ç": "e",
})
_ROMAN = r"(?i:(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})(?![^\W\d_]))"
_NUMBER = rf"(?:[0-9IlOoSsB|!]{{0,4}}\d[0-9IlOoSsB|!]{{0,4}}|{_ROMAN}|[lIOSB|]{{1,3}}(?![^\W\d_]))"
PAGE_NUMBER = re.compile(rf"^[\s\W]*(?:(?i:page|seite|página|pagina|pág|pag|p|s|blatt|folio)\s*\.?\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur|\|)\s*{_NUMBER})?[\s\W]*$")
_PAGE_MARK = re.compile(rf"^\s*(?:[\[(–—|-]*\s*(?:(?:page|seite|página|p)\s*\.?\s*)?{_NUMBER}(?:\s*/\s*{_NUMBER})?\s*[\])–—|-]*)(?=\s)|(?<=\s)(?:[\[(–—|-]*\s*(?:(?:page|seite|página|p)\s*\.?\s*)?{_NUMBER}(?:\s*/\s*{_NUMBER})?\s*[\])–—|-]*)\s*$", re.I)
_LINE = re.compile(r"\r\n|\r|\n")
_HYPHENS = "-‐‑¬\xad"
_BROKEN = re.compile(rf"(\S*[^\W\d_]\S*?|\S*[!+|ﬁﬂ]\S*?)[{_HYPHENS}]$")
_EDGE = ".,;:?()[]{}\"'«»„“”’‘…"
#: Words after a hyphen that stands for an omitted part.
_AND = {"and", "or", "und", "oder", "bzw", "et", "ou", "y", "o", "e", "u", "to", "bis"}
_CODE = re.compile(r"^[a-z]{1,4}-[\dloisb|]+$", re.I)
BODY = ("paragraph", "list")


def word_of(token: str) -> str:
    """A token in lower case without punctuation around it."""
    bare = token.strip(_EDGE)
    if bare.endswith("!"):
        bare = bare.rstrip("!")
    return bare.lower()


def fold(line: str) -> str:
    """A line as misreadings leave it alone: page marks, case, spaces and confusable characters folded away."""
    s = line.strip()
    for _ in range(2):
        cut = _PAGE_MARK.sub("", s).strip(" |·•–—-\t")
        if not cut or cut == s:
            break
        s = cut
    return "".join(s.lower().split()).translate(_FOLD)


def is_page_number(line: str) -> bool:
    bare = line.strip()
    if not bare or len(bare) > 24:
        return False
    return bool(PAGE_NUMBER.match(bare)) and any(c.isalnum() or c in "|!" for c in bare)


def lines_of(text: str | None) -> list[str]:
    return [line.rstrip() for line in _LINE.split(text or "")]


def _heads(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, head): 'block' where the whole block is a running head, 'line' where its first line is one.

    A head is the first line of a page, page numbers aside, that the file has as a heading or that opens AGAIN pages as a
    block; lines are compared folded, so misread ones agree. Where blocks stand on the page in points does not matter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, s, p, kind, text in zip(pdf["doc_id"], pdf["seq"], pdf["page"], pdf["block_type"], pdf["text"]):
                filled = [line for line in lines_of(text) if line.strip()]
                if filled:
                    out.append((d, s, p, kind, len(filled), fold(filled[0]) if len(filled[0]) <= 120 else "", len(filled) == 1 and is_page_number(filled[0])))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "page", "block_type", "n_lines", "folded", "number"])

    lines = blocks.select("doc_id", "seq", "page", "block_type", "text").mapInPandas(run, "doc_id string, seq int, page int, block_type string, n_lines int, folded string, number boolean")
    headings = lines.filter("block_type = 'heading' AND n_lines = 1 AND folded <> ''").select("doc_id", "folded")
    first = F.min_by(F.struct("seq", "n_lines", "folded"), "seq")
    tops = lines.filter(F.col("block_type").isin(*BODY) & ~F.col("number")).groupBy("doc_id", "page").agg(first.alias("t")).select("doc_id", "page", "t.*").filter("folded <> ''")
    again = tops.groupBy("doc_id", "folded").agg(F.countDistinct("page").alias("pages"), F.min("n_lines").alias("least")).filter((F.col("pages") >= AGAIN) & (F.col("least") == 1)).select("doc_id", "folded")
    known = headings.unionByName(again).distinct()
    marked = tops.join(known, ["doc_id", "folded"], "left_semi")
    return marked.select("doc_id", "seq", F.when(F.col("n_lines") == 1, "block").otherwise("line").alias("head"))


class Page:
    """The blocks of one page, sorted out."""

    def __init__(self, rows: list[tuple], height: float) -> None:
        # rows: (seq, text, y0, block_type, head); height: how far down the text of these pages reaches.
        self.noise: list[tuple[int, str]] = []
        self.body: list[tuple[int, str, list[str]]] = []
        #: Notes at the foot: they are text, but stand outside the flow from page to page.
        self.notes: list[tuple[int, str, list[str]]] = []
        numbered = False
        body = []
        texts = [(seq, y0, kind, head, filled) for seq, text, y0, kind, head in rows if kind in BODY and (filled := [line for line in lines_of(text) if line.strip()])]
        for n, (seq, y0, kind, head, filled) in enumerate(texts):
            if head == "block":
                self.noise.append((seq, "running_head"))
            elif len(filled) == 1 and (n < TOPS or n >= len(texts) - TOPS) and is_page_number(filled[0]):
                self.noise.append((seq, "page_number"))
                numbered = True
            else:
                body.append((seq, kind, filled, head, y0))
        while body and body[-1][4] is not None and body[-1][4] >= NOTES * height and _NOTE.match(body[-1][2][0]):
            self.notes.insert(0, body.pop()[:3])
        body = [b[:4] for b in body]
        for i, (seq, kind, filled, head) in enumerate(body):
            if head == "line":
                self.noise.append((seq, "running_head"))
                filled = filled[1:]
            if i == 0 and not numbered and len(filled) > 1 and is_page_number(filled[0]):
                self.noise.append((seq, "page_number"))
                filled, numbered = filled[1:], True
            if i == len(body) - 1 and not numbered and len(filled) > 1 and is_page_number(filled[-1]):
                self.noise.append((seq, "page_number"))
                filled = filled[:-1]
            if filled:
                self.body.append((seq, kind, filled))


def break_at(line: str, following: str) -> tuple[str, str] | None:
    """(left, right) where a word is broken between two lines."""
    m = _BROKEN.search(line)
    if not m or not following.strip():
        return None
    right = following.split()[0]
    bare = right.strip(_EDGE)
    if not bare or bare.lower() in _AND or not (bare[0].islower() or bare[0] in "+!|ﬁﬂ0156") or not any(c.isalpha() for c in bare):
        return None
    left = m.group(1).lstrip(_EDGE)
    return (left, bare) if left else None


def block_tokens(filled: list[str], following: str | None) -> tuple[list[tuple[str, str, int]], bool]:
    """((left or word, right, flag) of a block; whether its last word goes on in the next block). flag 1: a broken word."""
    out: list[tuple[str, str, int]] = []
    skip = False
    for n, line in enumerate(filled):
        words = line.split()
        if skip:
            words, skip = words[1:], False
        nxt = filled[n + 1] if n + 1 < len(filled) else following
        pair = break_at(line, nxt) if nxt is not None and words else None
        if pair:
            out += [(word_of(w), "", 0) for w in words[:-1]]
            out.append((pair[0].lower(), pair[1].lower(), 1))
            skip = True
        else:
            out += [(word_of(w), "", 0) for w in words]
    return out, skip


def _flow(group: list[tuple]) -> tuple[list[tuple[int, str]], list[tuple[int, str, list[str]]], str | None, str | None, list[tuple[int, str, list[str]]]]:
    """(noise, body blocks in order, body line before, body line after, notes) of a bucket; rows: (look, page, seq, text, y0, block_type, head, ...)."""
    pages: dict = {}
    edge: dict = {}
    for look, page, seq, text, y0, kind, head, *_ in group:
        if look:
            edge[int(look)] = text
        else:
            pages.setdefault(page if page is not None and page == page else 0, []).append((int(seq), text, y0, kind, head))
    height = max((y for rows in pages.values() for _, _, y, _, _ in rows if y is not None and y == y), default=0.0)
    sorted_out = [Page(rows, height) for _, rows in sorted(pages.items())]
    return [n for p in sorted_out for n in p.noise], [b for p in sorted_out for b in p.body], edge.get(-1), edge.get(1), [n for p in sorted_out for n in p.notes]


_LOOK = ["look", "page", "seq", "text", "y0", "block_type", "head"]


def _bordered(rows: DataFrame) -> DataFrame:
    """Adds bucket and look: 0 for the rows, and rows of -1 and 1 with the last body line before a bucket and the first one after it.

    Only files of several buckets are read for these lines; buckets without body text are passed over, however many.
    """
    rows = rows.withColumn("bucket", F.floor(F.coalesce("page", F.lit(0)) / PAGES)).withColumn("look", F.lit(0))
    several = rows.groupBy("doc_id").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).filter("low < high").select("doc_id")

    def edges(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        _, flow, *_ = _flow(group)
        if flow:
            yield (*key, flow[0][2][0], flow[-1][2][-1])

    found = in_groups(rows.join(several, "doc_id", "left_semi"), ["doc_id", "bucket"], _LOOK[:3], edges, _LOOK, "doc_id string, bucket long, first string, last string")
    w = Window.partitionBy("doc_id").orderBy("bucket")
    halo = found.select("doc_id", "bucket", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    halo = halo.select("doc_id", "bucket", F.explode(F.array(F.struct(F.lit(-1).alias("look"), F.col("before").alias("text")), F.struct(F.lit(1).alias("look"), F.col("after").alias("text")))).alias("h"))
    return rows.unionByName(halo.select("doc_id", "bucket", "h.look", "h.text").filter("text IS NOT NULL"), allowMissingColumns=True)


_OUT = "doc_id string, seq int, noise string, tokens array<string>, rights array<string>"


def _worked(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, noise, tokens, rights): noise rows of the furniture, and the words of each body block and note.

    Notes have 'note' as noise. rights holds the second half where a token is the first half of a broken word, else an empty string.
    """
    rows = blocks.join(_heads(blocks), ["doc_id", "seq"], "left")

    def run(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        doc = key[0]
        noise, flow, before, after, notes = _flow(group)
        for seq, kind in noise:
            yield doc, seq, kind, None, None
        for seq, _, filled in notes:
            words, _ = block_tokens(filled, None)
            yield doc, seq, "note", [w for w, _, _ in words], [r for _, r, _ in words]
        skip = bool(flow and before and break_at(before, flow[0][2][0]))
        for i, (seq, _, filled) in enumerate(flow):
            if skip:
                first = filled[0].split(maxsplit=1)
                filled = [*([first[1]] if len(first) > 1 else []), *filled[1:]]
            following = flow[i + 1][2][0] if i + 1 < len(flow) else after
            words, skip = block_tokens(filled, following)
            yield doc, seq, None, [w for w, _, _ in words], [r for _, r, _ in words]

    return in_groups(_bordered(rows), ["doc_id", "bucket"], _LOOK[:3], run, _LOOK, _OUT)


class Trie:
    """A vocabulary trie that a Levenshtein automaton with confusions runs over."""

    END = ""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.root: dict = {}
        for w, n in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[self.END] = n
        self.most = max((n for _, n in words), default=0)

    def near(self, word: str, edits: int, free: bool) -> dict[str, tuple[int, int]]:
        """word -> (edits, count) of all vocabulary words within ``edits``; without ``free`` only confusions count."""
        found: dict[str, tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        size = len(word)
        stack = [(self.root, "", 0, 0)]
        while stack:
            node, path, at, used = stack.pop()
            state = (id(node), at, used)
            if state in seen:
                continue
            seen.add(state)
            if at == size and self.END in node:
                n = node[self.END]
                if path not in found or used < found[path][0]:
                    found[path] = (used, n)
            if at < size and word[at] in node:
                stack.append((node[word[at]], path + word[at], at + 1, used))
            if used == edits:
                continue
            for read, right in _BY_READ.get(word[at : at + 1], ()):
                if word.startswith(read, at):
                    down = node
                    for c in right:
                        down = down.get(c)
                        if down is None:
                            break
                    else:
                        stack.append((down, path + right, at + len(read), used + 1))
            if free:
                if at < size:
                    stack.append((node, path, at + 1, used + 1))
                for c, down in node.items():
                    if c:
                        stack.append((down, path + c, at, used + 1))
                        if at < size and c != word[at]:
                            stack.append((down, path + c, at + 1, used + 1))
        return found


_BY_READ: dict[str, list[tuple[str, str]]] = {}
for _right, _read in CONFUSED:
    _BY_READ.setdefault(_read[0], []).append((_read, _right))


def doubtful(word: str) -> bool:
    """Whether a word type is looked up: no code, no number, no sign alone."""
    return len(word) > 1 and not _CODE.match(word) and any(c.isalpha() for c in word)


def offers(word: str, n: int, trie: Trie, whole: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(candidate, edits, count, sure) of a word type seen n times.

    Sure are confusions, and any edits where signs inside show that the word is none, of a candidate that is OFTENER times
    as frequent. Other edits, words of two letters and rarer candidates of such signs are offered for ``whole`` words only,
    as the words around them have to decide.
    """
    odd = bool(_ODD.search(word)) and not word.replace("-", "").replace("'", "").replace("’", "").isalpha()
    clear = len(word) > 2 or bool(_ODD.fullmatch(word))
    if trie.most < (n if odd and whole else OFTENER * n) or not (clear or whole):
        return
    known = trie.near(word, EDITS, odd and len(word) > 3)
    for candidate, (edits, m) in known.items():
        sure = clear and m >= OFTENER * n
        if candidate != word and (sure or whole and m >= (n if odd else OFTENER * n)):
            yield candidate, edits, m, sure
    if whole and len(word) > 2 and not (odd and len(word) > 3):
        for candidate, (edits, m) in trie.near(word, 1 if len(word) < 5 else EDITS, True).items():
            if candidate != word and candidate not in known and m >= OFTENER * n:
                yield candidate, edits, m, False


def _candidates(types: DataFrame) -> DataFrame:
    """(word, candidate, edits, n, sure): the vocabulary words that each doubtful type may be. types: (word, n, vocabulary, whole).

    A type without signs inside that only unsure candidates are offered to is its own candidate, too.

    The vocabulary is cut into tries of about TRIE words, the types into parts of about ASKED; every part meets every trie.
    """
    types = stage(types)
    usable = F.col("vocabulary") & F.col("word").rlike(r"^[\p{L}]+(?:[-'’][\p{L}]+)*$")
    sizes = types.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(usable.cast("long")), F.lit(0)).alias("words")).first()
    parts, shards = sizes.types // ASKED + 1, sizes.words // TRIE + 1
    vocabulary = types.filter(usable).select(F.lit(0).alias("part"), F.pmod(F.xxhash64("word"), F.lit(shards)).alias("shard"), F.lit(0).alias("ask"), "word", "n")
    vocabulary = vocabulary.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = types.select(F.pmod(F.hash("word"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.when(F.col("whole"), 1).otherwise(2).alias("ask"), "word", "n")

    def start() -> list:
        return [[], None]

    def step(state: list, row: tuple) -> Iterator[tuple]:
        """The words of the trie come first, then the types that are asked for stream through."""
        ask, w, n = row
        if not ask:
            state[0].append((w, int(n)))
            return
        if state[1] is None:
            state[1], state[0] = Trie(state[0]), []
        if doubtful(w):
            for candidate, edits, m, sure in offers(w, int(n), state[1], ask == 1):
                yield w, candidate, edits, m, int(n), sure

    found = fold_streams(vocabulary.unionByName(asked), ["part", "shard"], ["ask", "word"], start, step, lambda state: [], ["ask", "word", "n"], "part int, shard long, word string, candidate string, edits int, n long, own long, sure boolean")
    found = stage(found)
    sure = found.filter("sure")
    unsure = found.filter("NOT sure").join(sure.select("word").distinct(), "word", "left_anti")
    itself = unsure.filter(~F.col("word").rlike(r"[\d+!|$@ﬁﬂﬀﬃ]")).select("word", F.col("word").alias("candidate"), F.lit(0).alias("edits"), F.col("own").alias("n"), "sure").distinct()
    return sure.unionByName(unsure).select("word", "candidate", "edits", "n", "sure").unionByName(itself)


def repairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, place, noise, word, repaired, note) of every furniture block, broken word and misread word.

    place is the word's index in the block; furniture has -1 and an empty repair. Repeated rows count once by (doc_id,
    seq); a null text, page or box is an empty block, page 0 or a block in the text area.
    """
    y0 = F.try_element_at("bbox", F.lit(2))
    flat = blocks.filter("doc_id IS NOT NULL AND seq IS NOT NULL").select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("page").cast("int").alias("page"), "text", y0.cast("double").alias("y0"), "block_type")
    flat = flat.groupBy("doc_id", "seq").agg(*[F.max(c).alias(c) for c in ("page", "text", "y0", "block_type")])
    # Staged, as counts, contexts and results read it.
    worked = stage(_worked(flat))
    furniture = worked.filter("noise <> 'note'").select("doc_id", "seq", F.lit(-1).alias("place"), "noise", F.lit("").alias("word"), F.lit("").alias("repaired"), F.lit(False).alias("note"))
    words = worked.filter("noise IS NULL OR noise = 'note'").select("doc_id", "seq", F.col("noise").isNotNull().alias("note"), F.posexplode(F.arrays_zip("tokens", "rights")).alias("place", "t"), "tokens", "rights")
    context = lambda shift: F.when(F.try_element_at("rights", F.col("place") + 1 + shift) == "", F.try_element_at("tokens", F.col("place") + 1 + shift))
    before = F.when(F.col("place") > 0, F.when(F.get("rights", F.col("place") - 1) == "", F.get("tokens", F.col("place") - 1)))
    words = words.select("doc_id", "seq", "note", "place", F.col("t.tokens").alias("left"), F.col("t.rights").alias("right"), before.alias("before"), context(1).alias("after"))
    whole = words.filter("right = ''")
    broken = words.filter("right <> ''").withColumn("joined", F.concat("left", "right")).withColumn("kept", F.concat_ws("-", "left", "right"))
    counted = whole.filter("NOT note")
    counts = counted.groupBy(F.col("left").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    types = counts.withColumns({"vocabulary": F.lit(True), "whole": F.lit(True)})
    # Broken words are asked for in both forms, also where no whole word is like them; words of notes are asked for, but not counted.
    others = broken.select(F.explode(F.array("joined", "kept")).alias("word"), F.lit(False).alias("whole")).unionByName(whole.filter("note").select(F.col("left").alias("word"), F.lit(True).alias("whole")))
    others = others.groupBy("word").agg(F.max("whole").alias("whole")).join(counts, "word", "left_anti").select("word", F.lit(1).cast("long").alias("n"), F.lit(False).alias("vocabulary"), "whole")
    candidates = stage(_candidates(types.unionByName(others)))
    # The words around decide between candidates: pairs are counted for words that may be candidates only.
    maybe = candidates.select("candidate").distinct()
    pairs = counted.filter("before IS NOT NULL").groupBy("before", "left").agg(F.count(F.lit(1)).alias("times"))
    ahead = pairs.join(maybe, pairs["left"] == maybe["candidate"], "left_semi").select(F.col("before"), F.col("left").alias("candidate"), F.col("times").alias("t1"))
    behind = pairs.join(maybe, pairs["before"] == maybe["candidate"], "left_semi").select(F.col("left").alias("after"), F.col("before").alias("candidate"), F.col("times").alias("t2"))
    # What a word's own place adds to the counts of its pairs is no evidence for it.
    itself = F.col("candidate") == F.col("word")
    t1, t2 = (F.greatest(F.coalesce(t, F.lit(0)) - itself.cast("int"), F.lit(0)) for t in ("t1", "t2"))
    score = F.log("n") - 2.5 * F.col("edits") + 2.0 * F.log1p(t1) + 2.0 * F.log1p(t2)
    # Unsure candidates must be known between the words around, where there are any.
    fits = (F.col("before").isNull() | (t1 > 0)) & (F.col("after").isNull() | (t2 > 0)) & (t1 + t2 > 0)

    def ranked(occurrences: DataFrame, offered: DataFrame) -> DataFrame:
        offered = occurrences.join(offered, "word").join(ahead, ["before", "candidate"], "left").join(behind, ["after", "candidate"], "left").filter(F.col("sure") | itself | fits).withColumn("score", score)
        return offered.groupBy("doc_id", "seq", "note", "place", "word").agg(F.max_by("candidate", F.struct("score", "candidate")).alias("repaired"))

    # A misreading has no company of its own: a word that most of its places know as it is stays everywhere.
    chosen = stage(ranked(whole.withColumnRenamed("left", "word"), candidates))
    wrong = chosen.groupBy("word").agg(F.avg((F.col("repaired") != F.col("word")).cast("int")).alias("share")).filter("share > 0.5").select("word")
    misread = chosen.filter("repaired <> word").join(wrong, "word", "left_semi").select("doc_id", "seq", "place", F.lit("misread").alias("noise"), "word", "repaired", "note")
    known_j = counts.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    known_k = counts.select(F.col("word").alias("kept"), F.col("n").alias("n_kept"))
    b = broken.join(known_j, "joined", "left").join(known_k, "kept", "left")
    better_j = ranked(broken.withColumnRenamed("joined", "word"), candidates.filter("sure")).select("doc_id", "seq", "place", F.col("repaired").alias("fixed"))
    better_k = ranked(broken.withColumnRenamed("kept", "word"), candidates.filter("sure")).select("doc_id", "seq", "place", F.col("repaired").alias("fixed_kept"))
    b = b.join(better_j, ["doc_id", "seq", "place"], "left").join(better_k, ["doc_id", "seq", "place"], "left")
    nj, nk = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_kept", F.lit(0))
    form = (
        F.when((nk > nj) & F.col("fixed_kept").isNull(), F.col("kept"))
        .when(F.col("fixed").isNotNull(), F.col("fixed"))
        .when(F.col("fixed_kept").isNotNull() & (nj == 0), F.col("fixed_kept"))
        .otherwise(F.col("joined"))
    )
    joined = b.select("doc_id", "seq", "place", F.lit("hyphen_break").alias("noise"), F.col("joined").alias("word"), form.alias("repaired"), "note")
    return furniture.unionByName(misread).unionByName(joined)


def found(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, noise, repaired): each noise found; what is repaired in notes is none."""
    return repairs(blocks).filter("NOT note").select("doc_id", "seq", "noise", "repaired").distinct()


def _case_like(word: str, repaired: str) -> str:
    bare = word.strip(_EDGE)
    if bare[:1].isupper():
        repaired = repaired.upper() if len(bare) > 3 and bare.isupper() else repaired[:1].upper() + repaired[1:]
    head = word[: len(word) - len(word.lstrip(_EDGE))]
    tail = word[len(word.rstrip(_EDGE)) :]
    return head + repaired + tail


def reflowed(filled: list[str], following: str | None, fixes: dict[str, str]) -> tuple[str, bool]:
    """(the lines of a block as one, repaired by place; whether its last word goes on in the next block)."""
    raw: list[str] = []
    cut = False
    for n, line in enumerate(filled):
        words = line.split()
        if cut:
            words, cut = words[1:], False
        nxt = filled[n + 1] if n + 1 < len(filled) else following
        pair = break_at(line, nxt) if nxt is not None and words else None
        if pair:
            cut = True
            words[-1] = words[-1][:-1] + nxt.split()[0]
        raw += words
    return " ".join(_case_like(w, fixes[str(n)]) if str(n) in fixes else w for n, w in enumerate(raw)), cut


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, bucket, par, first_seq, text): the repaired body text, reflowed; par counts up in a bucket of PAGES pages.

    A block that goes on in the next (no end sign, or a broken word, and a small letter there) is one paragraph with it;
    a paragraph that goes on over the border of a bucket stands where it begins.
    """
    fixes = repairs(blocks).filter("noise IN ('misread', 'hyphen_break')").groupBy("doc_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("string"), "repaired"))).alias("fixes"))
    y0 = F.try_element_at("bbox", F.lit(2))
    flat = blocks.filter("doc_id IS NOT NULL AND seq IS NOT NULL").select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("page").cast("int").alias("page"), "text", y0.cast("double").alias("y0"), "block_type")
    flat = flat.groupBy("doc_id", "seq").agg(*[F.max(c).alias(c) for c in ("page", "text", "y0", "block_type")])
    rows = flat.join(_heads(flat), ["doc_id", "seq"], "left").join(fixes, ["doc_id", "seq"], "left").withColumn("fixes", F.to_json("fixes"))

    def run(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        import json

        fix = {int(seq): json.loads(f) if f else {} for look, _, seq, *_, f in group if not look}
        _, flow, before, after, notes = _flow(group)
        done: list[tuple[int, str]] = []
        skip = bool(flow and before and break_at(before, flow[0][2][0]))
        for i, (seq, _, filled) in enumerate(flow):
            if skip:
                first = filled[0].split(maxsplit=1)
                filled = [*([first[1]] if len(first) > 1 else []), *filled[1:]]
            mended, cut = reflowed(filled, flow[i + 1][2][0] if i + 1 < len(flow) else after, fix[seq])
            if done and mended[:1].islower() and (skip or not done[-1][1].rstrip().endswith((".", "!", "?", ":"))):
                done[-1] = (done[-1][0], done[-1][1] + " " + mended)
            elif mended:
                done.append((seq, mended))
            skip = cut
        for n, (seq, text) in enumerate(done):
            last = n + 1 == len(done)
            yield (*key, n, seq, text, n == 0 and text[:1].islower(), last, last and (skip or not text.rstrip().endswith((".", "!", "?", ":"))))
        # Notes are paragraphs of their own behind the flow.
        for n, (seq, _, filled) in enumerate(notes):
            yield (*key, len(done) + n, seq, reflowed(filled, None, fix[seq])[0], False, False, False)

    # Staged, as the stitching of the borders reads the ends of the buckets first.
    parts = stage(in_groups(_bordered(rows), ["doc_id", "bucket"], _LOOK[:3], run, [*_LOOK, "fixes"], "doc_id string, bucket long, par int, first_seq int, text string, small boolean, last boolean, open boolean"))
    w = Window.partitionBy("doc_id").orderBy("bucket", "par")
    ends = parts.filter("par = 0 OR last").select("doc_id", "bucket", "par", (F.col("small") & F.coalesce(F.lag("open").over(w), F.lit(False))).alias("joins"))
    home = F.last(F.when(~F.col("joins"), F.struct(F.col("bucket").alias("home"), F.col("par").alias("place"))), ignorenulls=True).over(w)
    joined = ends.withColumn("h", home).filter("joins").select("doc_id", "bucket", "par", "h.home", "h.place")
    touched = joined.unionByName(joined.select("doc_id", F.col("home").alias("bucket"), F.col("place").alias("par"), "home", "place").distinct())
    names = ["doc_id", "bucket", "par", "first_seq", "text"]
    whole = parts.join(touched, ["doc_id", "bucket", "par"], "left_anti").select(*names)
    long = parts.join(touched, ["doc_id", "bucket", "par"]).groupBy("doc_id", F.col("home").alias("bucket"), F.col("place").alias("par")).agg(
        F.min_by("first_seq", F.struct(parts["bucket"], parts["par"])).alias("first_seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(parts["bucket"], "text"))), lambda x: x["text"]), " ").alias("text")
    )
    return whole.unionByName(long.select(*names))
