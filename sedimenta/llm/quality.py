"""Problem 8: text quality statistics of each document and its kind.

Method: a text is cut into runs of lines of one shape. A run is described by distributions: over word classes (function
words of the nearest language among them), over character classes, and over its basic counts (shape, words in a line, line
ends, whole sentences, different words, markup). Each distribution is compared by Jensen-Shannon divergence with structural
profiles of prose, lists, tables and junk, which exist by language; the weighted sum of the divergences is the distance, and
the nearest profile alone decides. The kind of the document is the one that most characters of its runs belong to.

The profiles are fitted in each run of the query, over all different texts: their runs get a first label by simple counts,
their mean distributions are the first profiles, and ROUNDS of reassignment to the nearest profile follow. Fixed examples
count as PRIOR runs each, so that small tables are judged, too. Texts are described once; the rounds and the result read
the staged descriptions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import SPACES, UNICODE_SPACE, spread, stage

KINDS = ("prose", "list", "table", "junk")
#: Most words that are taken as common words; the table of them is a fixed list.
MOST_COMMON_WORDS = 20_000
#: Rounds of reassignment, the weight of a fixed example in runs, and the runs a profile needs: so many, and one in so many of all.
#: The share holds for tables of any size; with a number alone, every slip of the first labels would get a profile in a large one.
ROUNDS, PRIOR, LEAST, SHARE = 1, 6, 2, 4_000
#: Characters besides white space below which a text is next to nothing.
NOTHING = 12
#: Shapes of runs.
SHAPES = ("plain", "short", "mark", "ruled", "columns", "fields", "contents", "rule")
#: Texts of each kind, whose runs are the fixed profiles.
EXAMPLES = {
    "prose": (
        "The pump is part of the unit and it was tested with care by the team. It is not possible to change the order at this point, as the system was moved to the lab.",
        "Die Pumpe ist ein Teil der Anlage und wurde mit Sorgfalt vom Team geprüft. Es ist nicht möglich, die Reihenfolge jetzt zu ändern, weil das System in das Labor gebracht wurde.",
        "La pompe est une partie de la machine et elle a été testée avec soin par les gens de cette équipe. Il est impossible de changer cet ordre, car le banc est dans le laboratoire.",
        "La bomba es una parte de la máquina y fue probada con cuidado por el equipo. No es posible cambiar el orden en este momento, porque el sistema se llevó al laboratorio.",
        "1. The pump is part of the unit and it was tested with care.\n2. It is not possible to change the order at this point.\n3. The system was moved to the lab by the team.",
        "we did not go to the lab\nit was closed for the day\nthe team will be there on monday",
    ),
    "list": ("- pump\n- lamp\n- the red unit\n- lab\n- system", "* Pump A\n* Lamp B\n* Unit C", "1) pump\n2) lamp\n3) unit", "pump\nlamp\nunit\nlab\nsystem", "Pump – SRS-440\nLamp – SRS-540\nUnit – SRS-640", "red pump\nsmall lamp\nthe unit", "1.1 The pump ........ 3\n1.2 The lamp ....... 5\n2 Lab .... 9"),
    "table": (
        "| pump | 3.5 | kPa |\n|---|---|---|\n| lamp | 4.5 | kPa |\n| unit | 6.5 | MB |", "a | 3.5 | kPa\nb | 4.5 | kPa\nc | 6.5 | MB", "pump\tlamp\tunit\nlab\tsystem\torder", "SRS-1\t3.5\t4.5\nSRS-2\t6.5\t7.5", "41.1 22.3 9.0\n13.2 55.1 7.7",
        "REQ-1,pump,3.2\nREQ-2,,4.1\nREQ-3,lamp,9.9", "pump;lamp;unit\nlab;system;order", "pump    3.5    kPa\nlamp    4.5    kPa",
    ),
    "junk": (
        "=====\n-----\n#####", "?????!!!!!?????", "rnvkfakn wtzfwicrggl srpliwl hluqcrmw olfhesj twvy yacgrc msbms cpyqjdk ddvan jkjgq duepg lek zozn", "dd76d927 be681754 9b669c9a d1f392bc c13b8d89", "\u00b743{)t82~*a,7s5d!\"*17.\\es4\\i\u00b7; \"02=8b8\u25a1*'}*0{'(900(e,!~l2a}",
        '<div class="a"><span>&nbsp;</span></div>' * 5, "Click here\n" * 9, "Click here " * 20, "next\n" * 20, "word " * 60, "Click here | " * 12, "qzzJ0LYrNM/k00EUlemMVOoAqKYLEWbugc5K4I/cSZgVF0YWZCvVdVoSdWKk2zEjesjqcfdpaZ18",
    ),
}
#: The distributions of a run: where each begins in its description, and what its divergence weighs.
PARTS = ((0, 6, 1.0), (6, 13, 1.0), (13, 21, 0.9), (21, 26, 0.5), (26, 28, 0.5), (28, 30, 0.8), (30, 32, 0.8), (32, 34, 2.5))
WIDTH = 34
#: The parts that are compared with every profile; the others only where these leave it in reach.
_QUICK, _SLOW = [PARTS[i] for i in (2, 5, 6, 7)], [PARTS[i] for i in (0, 1, 3, 4)]

_LINE = re.compile(r"\r\n|\r|\n")
_CONTENTS = re.compile(r"(?:\.{3,}|…{1,}|(?: \.){3,}|_{4,}|·{3,})\s*(?:\d+|[ivxlcdm]+)\s*$")
_SOMETHING = re.compile(rf"(?:\s*\S){{{NOTHING}}}")
_LEADERS = ("...", "…", " . . .", "____", "···")
_MARK = re.compile(r"^\s*(?:[-*•·–—‣▪○●+>]\s+|\(?(?:\d{1,4}(?:\.\d+)*|[a-zA-Z]|[ivxlcdm]{1,6})[.):]\)?\s+|\[[ xX]?\]\s+|[A-Z]{1,6}-\d+[:.)]\s+)")
_NUMBER = re.compile(r"^[-+]?[\d.,]+%?$")
_WORD = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*$")
_GAP = re.compile(r"\S(?: {2,}|\t+| *\t *)(?=\S)")
_END = re.compile(r"[.!?…][\"'”’»“)\]]*\s*$")
_EDGE = "\"'“”„‘’«»()[]{}<>.,;:!?¿¡…*"
_MIXED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")
_CELLS = str.maketrans(dict.fromkeys("|;,\t\"", " "))
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|&[a-z]{2,8};|\{\{[^{}\n]{0,80}\}\}")


def _char_class(c: str) -> int:
    if c.isalpha():
        return 1 if c.isupper() else 0
    if c.isdigit():
        return 2
    if c.isspace():
        return 3
    return 4 if c in ".!?…" else 5 if c in ",;|:" else 6


class _Chars(dict):
    def __missing__(self, c: int) -> str:
        out = self[c] = str(_char_class(chr(c)))
        return out


_CHARS = _Chars()
_LATIN = bytes(_char_class(chr(c)) for c in range(256))


def char_shares(text: str) -> tuple:
    n = max(1, len(text))
    try:
        classes = text.encode("latin-1").translate(_LATIN)
        return tuple(classes.count(i) / n for i in range(7))
    except UnicodeEncodeError:
        wide = text.translate(_CHARS)
        return tuple(wide.count(str(i)) / n for i in range(7))


def _word_class(word: str, common: dict[str, int]) -> int:
    """The class of a word, and for function words eight times the bits of their languages."""
    bare = word.strip(_EDGE)
    if not bare:
        return 4
    low = bare.lower()
    known = common.get(low)
    if known:
        return known << 3
    if _WORD.match(bare) and len(bare) <= 30:
        tail = bare[1:]
        return 1 if bare == low else 2 if tail == tail.lower() or bare.isupper() or "-" in bare or "'" in bare else 5
    if len(bare) <= 14 and any(c.isdigit() for c in bare) and not _MIXED.search(low):
        return 3
    if len(bare) < 4 and not any(c.isalnum() for c in bare):
        return 4
    return 5


class WordClasses(dict):
    """Word -> _word_class, kept for the words seen lately."""

    KEPT = 200_000

    def __init__(self, common: dict[str, int]) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        out = self[word] = _word_class(word, self.common)
        return out


def word_shares(codes: list[int]) -> tuple[tuple, int]:
    """(shares of the word classes with the nearest language's function words, that language or -1)."""
    counts, by_lang = [0] * 6, Counter()
    for code, times in Counter(codes).items():
        counts[code & 7] += times
        bits, lang = code >> 3, 0
        while bits:
            if bits & 1:
                by_lang[lang] += times
            bits, lang = bits >> 1, lang + 1
    lang, best = min(by_lang.items(), key=lambda x: (-x[1], x[0]), default=(-1, 0))
    counts[1] += counts[0] - best
    counts[0] = best
    n = max(1, len(codes))
    return tuple(c / n for c in counts), lang


def _shape(line: str) -> str:
    """The shape of a line by its separators and marks."""
    bare = line.strip()
    if not any(c.isalnum() for c in bare):
        return "|" if bare.count("|") > 1 else "rule"
    if bare.count("|") > 1:
        return "|"
    tabs = line.rstrip("\r\n").count("\t")
    if tabs > 1:
        return "tab"
    if bare.count(";") > 1 and not _END.search(bare) and bare.count("; ") < bare.count(";"):
        return ";"
    commas = bare.count(",")
    if commas > 1 and bare.count(", ") * 2 < commas and bare.count(" ") < 4 * (commas + 1):
        return ","
    if bare[-1].isalnum() and any(dots in bare for dots in _LEADERS) and _CONTENTS.search(bare):
        return "contents"
    if ("  " in bare or tabs) and len(_GAP.findall(bare)) + (line[:1] == " " and len(line) - len(line.lstrip()) > 9) > 1:
        return "gap"
    if bare[0] in "+-.,0123456789":
        parts = bare.split()
        if len(parts) > 2 and all(_NUMBER.match(p) for p in parts):
            return "numbers"
    return "mark" if _MARK.match(line) else "plain"


_GROUP = {"|": "ruled", "tab": "columns", "gap": "columns", "numbers": "columns", ";": "fields", ",": "fields"}
_PLACE = {shape: i for i, shape in enumerate(SHAPES)}


def _is_sentence(ended: bool, codes: list[int]) -> bool:
    n = len(codes)
    if n < 4:
        return False
    function = sum(code > 7 for code in codes)
    return function >= 0.1 * n if ended else n >= 7 and function >= 0.2 * n


def runs_of(text: str) -> Iterator[tuple[str, list[str]]]:
    """(shape, lines) of the runs of a text; blank lines separate, a wrapped paragraph stays together."""
    run: list[str] = []
    shape = ""
    flow = False  # the line before is prose that may go on
    after_blank = True
    for line in _LINE.split(text):
        if not line.strip():
            after_blank = True
            continue
        s = _shape(line)
        goes_on = flow and not after_blank and run and not _END.search(run[-1]) and len(run[-1]) > 40
        if s in ("plain", "mark", ",", "numbers") and goes_on and shape == "plain":
            s = "plain"  # wrapped prose goes on whatever its next line begins with
        if s == "plain":
            # Long lines and short ones are runs of their own; the last line of a wrapped paragraph stays in it.
            count = len(line.split())
            key = "plain" if count > 6 or count > 3 and _END.search(line) or goes_on else "short"
        else:
            key = _GROUP.get(s, s)
        if key != shape and not (shape == "ruled" and key == "rule"):
            if run:
                yield shape, run
            run, shape = [], key
        run.append(line)
        flow = key == "plain"
        after_blank = False
    if run:
        yield shape, run


def describe(shape: str, lines: list[str], common: WordClasses) -> tuple[list[float], int]:
    """(the distributions of a run one after the other, its language or -1)."""
    text = "\n".join(lines)
    celled = shape in ("ruled", "columns", "fields")
    lengths, ended, sentences, size = [0] * 5, 0, 0, 0
    words: list[str] = []
    codes: list[int] = []
    for line in lines:
        parts = (line.translate(_CELLS) if celled else line).split()
        of = list(map(common.__getitem__, parts))
        words += parts
        codes += of
        closed = bool(_END.search(line.rstrip()[-24:]))
        ended += closed
        if celled:
            n, body = len(line.split()), line
        elif shape == "mark":
            body = _MARK.sub("", line)
            n = len(body.split())
            of = of[len(of) - n :]
        else:
            n, body = len(parts), line
        lengths[0 if n < 2 else 1 if n < 4 else 2 if n < 7 else 3 if n < 15 else 4] += 1
        size += len(body)
        if not celled and _is_sentence(closed, of):
            sentences += len(body)
    shares, lang = word_shares(codes)
    shapes = [0.0] * len(SHAPES)
    shapes[_PLACE[shape]] = 1.0
    markup = sum(map(len, _TAG.findall(text))) / max(1, len(text)) if "<" in text or "&" in text or "{{" in text else 0.0
    n = len(words)
    variety = math.log(1 + len(set(words))) / math.log(1 + n) if n else 0.0
    two = [x for v in (ended / len(lines), sentences / max(1, size), min(1.0, markup), variety) for x in (v, 1.0 - v)]
    return [*shares, *char_shares(text), *shapes, *(x / len(lines) for x in lengths), *two], lang


def first_label(d: list[float], shape: str) -> tuple[str, str]:
    """(kind, variant) that the counts of a run suggest: only where the fitting of the profiles begins."""
    function, odd, signs = d[0], d[5], d[12]
    ended, sentences, markup, variety = d[26], d[28], d[30], d[32]
    length = d.index(max(d[21:26]), 21) - 21
    modes = f"{d.index(max(d[:6]))} {d.index(max(d[6:13])) - 6}"  # the commonest class of words and of characters
    prose = shape in ("plain", "short", "mark")
    if markup > 0.5:
        return "junk", "markup"
    if shape == "rule":
        return "junk", "rule"
    if variety < (0.5 if prose else 0.4):
        return "junk", f"phrase {shape} {length} {modes}"
    if shape == "contents":
        return "list", shape
    if odd > 0.4 or signs > 0.25 or signs > 0.08 and shape == "plain":
        return "junk", f"signs {shape} {modes}"
    if not prose:
        return ("prose", shape) if function >= 0.25 and ended > 1 / 3 else ("table", f"{shape} {modes}")
    if sentences > 0.5:
        return "prose", shape
    if shape == "plain" and length > 2:
        return ("prose", shape) if function >= 0.12 else ("junk", f"{shape} {modes}")
    return "list", f"{shape} {length} {modes}"


def _entropy(x: np.ndarray) -> np.ndarray:
    return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(axis=-1)


def _divergence(p: np.ndarray, q: np.ndarray, parts: list[tuple[int, int, float]]) -> np.ndarray:
    """Weighted sums of the Jensen-Shannon divergences over the last axis."""
    out = 0.0
    for low, high, weight in parts:
        a, b = p[..., low:high], q[..., low:high]
        out = out + weight * (_entropy((a + b) / 2) - (_entropy(a) + _entropy(b)) / 2)
    return out


def distances(runs: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Weighted sums of the Jensen-Shannon divergences of every run from every profile."""
    return _divergence(runs[:, None, :], profiles[None, :, :], PARTS)


class Profiles:
    """Structural profiles: rows of a matrix, with the kind and the language of each."""

    def __init__(self, keys: list[tuple[str, str, int]], matrix: np.ndarray) -> None:
        self.keys, self.matrix = keys, matrix
        self.kind = np.array([KINDS.index(k) for k, _, _ in keys])
        self.lang = np.array([lang for _, _, lang in keys])

    def nearest(self, runs: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """The number of the nearest profile of each run, among those of its language and those of none.

        Divergences are no less than 0, so a profile that is farther by the quick parts than another one by all is left out.
        """
        out = np.empty(len(runs), int)
        for low in range(0, len(runs), 1_024):
            own = runs[low : low + 1_024]
            d = _divergence(own[:, None, :], self.matrix[None, :, :], _QUICK)
            d[(self.lang[None, :] >= 0) & (self.lang[None, :] != langs[low : low + 1_024, None])] = np.inf
            guess = d.argmin(axis=1)
            bound = d[np.arange(len(own)), guess] + _divergence(own, self.matrix[guess], _SLOW)
            i, k = np.nonzero(d <= bound[:, None] + 1e-9)
            whole = np.full_like(d, np.inf)
            whole[i, k] = d[i, k] + _divergence(own[i], self.matrix[k], _SLOW)
            out[low : low + 1_024] = whole.argmin(axis=1)
        return out


class Texts:
    """The runs of texts: a row of distributions and a language each, and their number and characters by text."""

    def __init__(self, runs: np.ndarray, langs: np.ndarray, sizes: list[np.ndarray]) -> None:
        self.runs, self.langs, self.sizes = runs.reshape(-1, WIDTH), langs.astype(int), sizes

    @classmethod
    def of(cls, texts: list[str | None], common: WordClasses) -> Texts:
        rows = [described(t, common) for t in texts]
        return cls(np.array([d for r in rows for d in r[0]], float), np.array([lang for r in rows for lang in r[1]], int), [np.array(r[2], float) for r in rows])


def described(text: str | None, common: WordClasses) -> tuple[list[list[float]], list[int], list[int]]:
    """(distributions, languages, characters) of the runs of a text; those of next to nothing have no characters to weigh."""
    bare = (text or "").replace("\ufeff", "")
    something = bool(_SOMETHING.match(bare))
    runs, langs, sizes = [], [], []
    for shape, lines in runs_of(bare):
        d, lang = describe(shape, lines, common)
        runs.append(d)
        langs.append(lang)
        sizes.append(sum(map(len, lines)) if something else 0)
    return runs, langs, sizes


Sums = dict[tuple[str, str, int], tuple[np.ndarray, int]]


def add(sums: Sums, texts: Texts, profiles: Profiles | None) -> None:
    """Adds to (kind, variant, language) -> sum and number of runs, by their first label or by the nearest profile.

    A run counts for its profile in all languages, and in prose and lists for that of its own language, too.
    """
    if not len(texts.runs):
        return
    if profiles is None:
        labels = [first_label(d, SHAPES[d.index(1.0, 13) - 13]) for d in texts.runs.tolist()]
    else:
        labels = [profiles.keys[i][:2] for i in profiles.nearest(texts.runs, texts.langs)]
    for label, d, lang in zip(labels, texts.runs, texts.langs.tolist()):
        for key in {(*label, -1), (*label, lang)} if label[0] in ("prose", "list") else {(*label, -1)}:
            total, n = sums.get(key, (0.0, 0))
            sums[key] = (total + d, n + 1)


def examples(common: WordClasses) -> Sums:
    """The fixed examples as PRIOR runs each; those that the counts read right share their profile with the data."""
    out: Sums = {}
    for kind, texts in EXAMPLES.items():
        for n, text in enumerate(texts):
            for shape, lines in runs_of(text):
                d = describe(shape, lines, common)[0]
                own, variant = first_label(d, shape)
                out[kind, variant if own == kind else f"example {n} {shape}", -1] = (PRIOR * np.array(d), PRIOR)
    return out


def profiles_of(sums: Sums, common: WordClasses) -> Profiles:
    """The mean of every label that enough runs have or an example shows; runs of other labels count by the next round."""
    shown = examples(common)
    whole = dict(shown)
    least = max(LEAST, sum(n for (_, _, lang), (_, n) in sums.items() if lang < 0) / SHARE)
    for key, (total, n) in sums.items():
        had, m = shown.get(key, (0.0, 0))
        whole[key] = (had + total, m + n)
    kept = {k: total / n for k, (total, n) in sorted(whole.items()) if k in shown or n >= least}
    return Profiles(list(kept), np.array(list(kept.values())))


def fit(texts: list[str | None], common: WordClasses) -> Profiles:
    """Profiles from texts; repeated and null texts are fine, without texts those of the fixed examples are left."""
    rows, profiles = Texts.of(texts, common), None
    for _ in range(ROUNDS + 1):
        sums: Sums = {}
        add(sums, rows, profiles)
        profiles = profiles_of(sums, common)
    return profiles


def kinds_by(texts: Texts, profiles: Profiles) -> list[str]:
    """The kind of each text: prose, list, table or junk. Null, empty and blank texts and next to nothing are junk."""
    weight = np.zeros((len(texts.sizes), len(KINDS)))
    weight[:, 3] = 0.5  # nothing to weigh is junk
    if len(texts.runs):
        kind = profiles.kind[profiles.nearest(texts.runs, texts.langs)]
        owner = np.repeat(np.arange(len(texts.sizes)), list(map(len, texts.sizes)))
        np.add.at(weight, (owner, kind), np.concatenate(texts.sizes).astype(float))
    return [KINDS[k] for k in weight.argmax(axis=1)]


def kinds_of(texts: list[str | None], common: WordClasses, profiles: Profiles) -> list[str]:
    return kinds_by(Texts.of(texts, common), profiles)


def common_words(words: DataFrame) -> dict[str, int]:
    """word -> bits of the languages that have it, from the fixed table (lang, word); refuses more than MOST_COMMON_WORDS rows."""
    rows = words.select("lang", "word").filter("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    langs = {lang: i for i, lang in enumerate(sorted({r.lang for r in rows}))}
    out: dict[str, int] = {}
    for r in rows:
        out[r.word.lower()] = out.get(r.word.lower(), 0) | 1 << langs[r.lang]
    return out


def _texts(pdf: pd.DataFrame) -> Texts:
    runs, langs = (np.concatenate(pdf[c].tolist() or [np.empty(0)]) for c in ("runs", "langs"))
    return Texts(runs, langs, pdf["sizes"].tolist())


def descriptions(documents: DataFrame, common: dict[str, int]) -> DataFrame:
    """(doc_id, digest, runs, langs, sizes) of every document; the distributions of its runs stand one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = WordClasses(common)
        for pdf in batches:
            rows = [described(t, classes) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "runs": [[x for d in r[0] for x in d] for r in rows], "langs": [r[1] for r in rows], "sizes": [r[2] for r in rows]})

    texts = spread(documents.select("doc_id", "text")).withColumn("digest", F.md5("text"))
    return texts.mapInPandas(run, "doc_id long, digest string, runs array<double>, langs array<int>, sizes array<int>")


def fitted_on(texts: DataFrame, common: dict[str, int]) -> Profiles:
    """fit() over all rows of a table of descriptions, each text once; only the sums by label come to the driver."""
    texts = stage(texts.dropDuplicates(["digest"]).select("runs", "langs", "sizes"))
    profiles = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Sums = {}
        for pdf in batches:
            add(sums, _texts(pdf), profiles)
        yield pd.DataFrame([(*key, total.tolist(), n) for key, (total, n) in sums.items()], columns=["kind", "variant", "lang", "total", "n"])

    for _ in range(ROUNDS + 1):
        parts = texts.mapInPandas(run, "kind string, variant string, lang int, total array<double>, n long")
        rows = parts.groupBy("kind", "variant", "lang").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(WIDTH)]).alias("total"), F.sum("n").alias("n")).collect()
        profiles = profiles_of({(r.kind, r.variant, r.lang): (np.array(r.total), r.n) for r in rows}, WordClasses(common))
    return profiles


def kinds(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, kind) of every document. Repeated texts are judged each; other columns are not read."""
    common = common_words(words)
    rows = stage(descriptions(documents, common))
    profiles = fitted_on(rows, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "kind": kinds_by(_texts(pdf), profiles)})

    return rows.select("doc_id", "runs", "langs", "sizes").mapInPandas(run, "doc_id long, kind string")


def found(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are not natural prose."""
    return kinds(documents, words).filter("kind <> 'prose'")


def stats(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Figures on each text: words, mean word length, share of symbols, of lines with an end sign, of common words.

    All expressions run in the JVM; the common words are one set over the languages. A null text counts as empty, and
    shares of nothing are 0.
    """
    text = F.coalesce("text", F.lit(""))
    listed = sorted(common_words(words)) or [""]
    times = lambda column, pattern: F.regexp_count(F.col(column), F.lit(pattern))
    word = rf"[^{UNICODE_SPACE}]"
    # All white space as blanks: the passes below then look for one character.
    flat = F.translate(text, SPACES, " " * len(SPACES))
    # One split takes the signs around words with the blank between them.
    bare = F.split(F.lower("flat"), r"[^\p{L}]* [^\p{L}]*|^[^\p{L}]+|[^\p{L}]+$")
    ended = rf"[.!?…][\"'”’»)\]]*[{UNICODE_SPACE}&&[^\r\n]]*(?=[\r\n]|\z)"
    d = spread(documents.select("doc_id", text.alias("text"))).select("doc_id", "text", flat.alias("flat")).select(
        "doc_id",
        times("flat", "[^ ]+").alias("n"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).alias("dense"),
        F.length("text").alias("size"),
        times("flat", r"[^\p{L}\p{N} ]").alias("signs"),
        times("text", rf"{word}[^\r\n]*").alias("lines"),
        times("text", ended).alias("ended"),
        F.size(F.filter(bare, lambda w: w.isin(*listed) & (w != ""))).alias("k"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), share("dense", "n").alias("mean_word_length"), share("signs", "size").alias("symbol_ratio"), share("ended", "lines").alias("ended_lines"), share("k", "n").alias("common_share"))
