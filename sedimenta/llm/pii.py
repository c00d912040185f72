"""Problem 2: personal information inside free text.

Method: a skip-chain conditional random field over each document. Its nodes are the words of the windows in which a name
may stand, and the candidate spans of the other types: e-mail addresses, numbers (phone, identity number or neither) and
street addresses. Neighbouring words share transition potentials, candidates that overlap exclude each other, and equal or
similar words, numbers and addresses of one document share skip potentials, however far apart they are. Max-sum loopy
message passing decides all labels of a document together.

Node potentials are log-odds counted over all texts in each run. For words of names: how often a word is written in lower
case, how many different given names stand before it, and how many different surnames stand after it. For candidates: how
often the words around them stand around numbers of unmistakable shape (a plus sign or brackets, letters inside), and how
often around numbers that have no such shape at all; no list says what numbers are called. Transitions and skip potentials
are fixed parameters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import in_groups, stage

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Most given names that are taken from the table of them, which is a fixed list.
MOST_GIVEN_NAMES = 20_000
#: Rounds of message passing where skip edges close loops.
ROUNDS = 6
#: What one given name can say for a surname, and how many times a word must be seen for full evidence.
EACH, ENOUGH = 3, 60

# --- e-mail addresses -------------------------------------------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|ät|arroba|arobase|@)\s?[\])}>]\s?|\s(?:at|ät|arroba|arobase)\s)"
_DOT = r"(?:\.|\s\.\s|\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?|\s(?:dot|punkt|point|punto)\s)"
_EMAIL = re.compile(rf"(?<![\w.+%-])([^\W_][\w.+%-]*)({_AT})([^\W_][\w-]*)((?:{_DOT}[^\W_][\w-]*)+)", re.I)
_HINT_EMAIL = re.compile(_AT, re.I)

# --- numbers ----------------------------------------------------------------------------------------------------------

_SEP = r"[ .\-/]"
_PHONE = re.compile(
    r"(?<![\w+])(?<![\d][.,:/\-])(?<![A-Za-z]-)(?:"
    rf"(?:\+\d{{1,3}}|00[1-9]\d){_SEP}?(?:\(0\){_SEP}?)?(?:\(\d{{1,5}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}"
    rf"|\((?:0|\+|00)?\d{{2,5}}\){_SEP}?\d{{2,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}"
    rf"|0\d{{1,5}}{_SEP}\d{{2,8}}(?:{_SEP}\d{{2,8}}){{0,4}}"
    r"|0\d{9,10}"
    r"|1[ .\-]\d{3}[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}"
    r"|[6-9]\d{2}[ .\-]\d{3}[ .\-]\d{3}|9\d[ .\-]\d{3}[ .\-]\d{2}[ .\-]\d{2}|[6-9]\d{2}(?:[ .\-]\d{2}){3}"
    r")(?![\w]|[.,\-/:]\d|-\w)"
)
_ID = re.compile(
    r"(?<![\w+])(?<![\d][.,:/\-])(?<![A-Za-z]-)(?<!\d )(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]\d[A-Z0-9]\d{6}|[A-Z]{2}\d{7}|\d{2}[A-Z]{2}\d{5}"
    r"|[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?"
    r"|\d{2} \d{6} [A-Z] \d{3}"
    r"|\d{2}(?: \d{3}){3}|\d{11}"
    r"|\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r")(?![\w]|[.,\-/:]\d|-\w)"
)
# --- addresses --------------------------------------------------------------------------------------------------------

_W = r"[^\W\d_][\w'’\-]*"
_ADDRESS = re.compile(
    r"(?<![\w/.,\-])(?:"
    rf"(?P<en>\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}?(?:street|st|road|rd|avenue|ave|lane|ln|drive|court|boulevard|blvd|terrace|crescent|square|parkway|highway)\b\.?)"
    r"|(?P<fr>\d{1,4}(?: ?(?:bis|ter|quater))?(?:,| ,)? (?:rue|avenue|av\.?|allée|all\.|boulevard|bd\.?|place|pl\.|chemin|impasse|quai|route|square|passage)(?=\s)(?: (?:de la|de l['’]|du|des|de|d['’])(?=[ \w]))? ?" + _W + ")"
    rf"|(?P<de>(?:[^\W\d_][\w\-]*?(?:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer|ring|chaussee|steig|pfad)|(?:am|an der|an dem|im|zum|zur|auf dem|auf der|unter den|in der|hinter dem) [A-ZÄÖÜ][^\W\d_]+(?:[ \-][A-ZÄÖÜ][^\W\d_]+)?) \d{{1,4}}(?: ?[a-z])?(?![\w%]))"
    r"|(?P<es>(?:calle|c/|c\.|avda\.?|avenida|plaza|pza\.?|paseo|p\.º|camino|ronda|carretera|ctra\.?|travesía)(?= ) (?:de la |de los |de las |del |de )?" + _W + r"(?: " + _W + r"){0,3}?(?:,|,? n\.?º)? \d{1,4}(?![\w%]))"
    r")",
    re.I,
)
#: Street names spelt small throughout are rarely meant; what may follow a street address.
_AFTER_ADDRESS = re.compile(r"[,;]? ?(?:\d{4,5}\b|(?:apt|suite|unit|flat|apto|piso|bât|étage|etage|app)\b|,|\.\s|\.?$)", re.I)

# --- candidates -------------------------------------------------------------------------------------------------------

#: Kinds of candidates, the types that their labels 1, 2 stand for, and the classes that contexts are counted for.
CANDIDATES = {"email": ("email",), "number": ("phone", "id_number"), "street": ("address",)}
CLASSES = ("phone", "id_number", "address", "plain")
#: What a word of the context weighs, the bounds of its log-odds, and how often it must be seen for full and any weight.
WEIGHT, BOUND, OFTEN, SELDOM = 0.8, 5.0, 10, 3
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"(?<!\w)[+(]?\d\w*(?:[ .,:/\-]?\w*\d\w*)*")
_BREAK = re.compile(r"[;!?\n\x00]|(?<=[^\W\d_]{5})\.\s|(?<=\d)\.\s")
_AHEAD = re.compile(r"[ ,]{0,2}([^\W\d_]+)(?: ([^\W\d_]+))?")


def context(text: str, start: int, end: int) -> list[str]:
    """The words around a span: three before it in its sentence, two after it, and the sign it leans on."""
    before = _LETTERS.findall(_BREAK.split(text[max(0, start - 60) : start])[-1])[-3:]
    ahead = _AHEAD.match(text[end : end + 40])
    lean = text[start - 1 : start]
    out = ["<" + w.casefold() for w in before] + ([f"{mark}{w.casefold()}" for mark, w in zip((">", "»"), ahead.groups()) if w] if ahead else [])
    return list(dict.fromkeys(out + (["=" + lean] if lean and not lean.isspace() and not lean.isalnum() else [])))


# --- names ------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|[,.]|\d+|[^\w\s]")
_PARTICLES = {"von", "van", "de", "del", "der", "den", "du", "di", "da", "dos", "la", "le", "zu", "ten", "ter", "af", "al", "bin", "ibn", "mac", "des", "della", "vom"}
_TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "herrn", "frau", "mme", "mlle", "monsieur", "madame", "sr", "sra", "srta", "don", "doña", "señor", "señora", "miss", "sir", "ing", "dipl"}
LABELS = ("O", "G", "P", "S", "K", "T")  # outside, given name or initial, particle, surname, comma inside a name, surname before it
_NEVER = -1e4
#: Transition potentials between the labels of neighbours.
_STEP = {
    ("O", "O"): 0.0, ("O", "G"): -0.3, ("O", "P"): -2.0, ("O", "S"): -2.2, ("O", "T"): -0.6,
    ("G", "O"): -1.0, ("G", "G"): 0.0, ("G", "P"): 0.6, ("G", "S"): 2.2, ("G", "T"): -2.0,
    ("P", "P"): 0.0, ("P", "S"): 2.2, ("P", "T"): 1.4,
    ("S", "O"): 0.0, ("S", "G"): -2.5, ("S", "S"): -3.0, ("S", "P"): -3.0, ("S", "T"): -2.8,
    ("T", "K"): 0.6, ("K", "G"): 2.0,
}
STEP = [[_STEP.get((a, b), _NEVER) for b in LABELS] for a in LABELS]
#: A break (sign, end of a sentence) between neighbours: nothing goes on over it.
_BROKEN = [[(0.0 if a in "OGS" and b in "OGPST" else _NEVER) + (-1.0 if a == "G" else 0) + {"G": -0.3, "P": -2.0, "S": -2.2, "T": -0.6}.get(b, 0.0) for b in LABELS] for a in LABELS]
#: Skip edges: agreement of equal or similar words of a document.
_SKIP = [[0.8 if a in "OGST" and b in "OGST" and (a == b or {a, b} == {"S", "T"}) else 0.0 for b in LABELS] for a in LABELS]


def best_labels(unary: list[list[float]], edges: list[tuple[int, int, list[list[float]]]], rounds: int = ROUNDS) -> list[int]:
    """Max-sum message passing; exact where the edges form a forest and the rounds reach over it, loopy otherwise.

    edges: (i, j, potential[label of i][label of j]); nodes may have different numbers of labels. A chain given in order
    settles in one sweep forth and one back.
    """
    n = len(unary)
    sent: dict[tuple[int, int], list[float]] = {}
    near: list[list[int]] = [[] for _ in range(n)]
    table: dict[tuple[int, int], list[list[float]]] = {}
    for i, j, p in edges:
        near[i].append(j)
        near[j].append(i)
        table[i, j] = p
        table[j, i] = [list(c) for c in zip(*p)]
        sent[i, j], sent[j, i] = [0.0] * len(unary[j]), [0.0] * len(unary[i])
    # A chain settles in one sweep forth and back, a tree in two.
    settle = rounds if len(edges) >= n else 1 if all(j - i == 1 for i, j, _ in edges) else 2
    for _ in range(settle):
        for order in (range(n), range(n - 1, -1, -1)):
            forth = order.step > 0
            for i in order:
                total = list(unary[i])
                for k in near[i]:
                    total = [t + m for t, m in zip(total, sent[k, i])]
                for j in near[i]:
                    if (j > i) == forth:
                        bare = [t - m for t, m in zip(total, sent[j, i])]
                        out = [max(v + row[y] for v, row in zip(bare, table[i, j])) for y in range(len(unary[j]))]
                        top = max(out)
                        sent[i, j] = [v - top for v in out]
    labels = []
    for i in range(n):
        total = list(unary[i])
        for k in near[i]:
            total = [t + m for t, m in zip(total, sent[k, i])]
        labels.append(max(range(len(total)), key=total.__getitem__))
    return labels


def email_candidates(text: str) -> list[tuple[int, int, float]]:
    """(start, end, potential): a spelt "at" is a word as well, so the local part or the dots must show what is meant."""
    if not _HINT_EMAIL.search(text):
        return []
    out, place = [], 0
    while m := _EMAIL.search(text, place):
        local, at, _, rest = m.groups()
        # What begins inside a candidate that is none may be one: "reach Doe at jane.doe [at] mail . example".
        place = m.end(1)
        # What is no top-level label is trimmed from the end.
        keep = re.match(rf"(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,24}}(?![\w-])", rest, re.I) or re.match(rf"(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,24}}", rest, re.I)
        if keep:
            signs = 3.0 * ("@" in at or any(c in at for c in "[({<")) + 3.0 * bool(re.search(r"[._+\d-]", local)) + 3.0 * (not rest.startswith("."))
            if signs:
                out.append((m.start(), m.start(4) + keep.end(), signs - 1.5))
                place = m.start(4) + keep.end()
    return out


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def candidates(text: str) -> tuple[list[tuple], list[tuple[str, list[str]]], str]:
    """(candidates, contexts, rest) of a text.

    Candidates are (kind, start, end, potentials of their types by shape, context); contexts are (class, words) of what is
    unmistakable by shape, for counting; the rest is the text with its likely candidates masked, in which names are looked for.
    """
    out = [("email", a, b, (v,), []) for a, b, v in email_candidates(text)]
    rest = masked(text, [(a, b) for _, a, b, v, _ in out if v[0] > 0])
    if not any(c.isdigit() for c in text):
        return out, [], rest
    counted: list[tuple[str, list[str]]] = []
    ids = {m.start(): m.end() for m in _ID.finditer(rest)}
    phones = {m.start(): m.end() for m in _PHONE.finditer(rest) if 8 <= _digits(m.group()) <= 15 and (_digits(m.group()) > 8 or m.group()[0] in "+(")}
    taken, spans = -1, []
    for at in sorted({*ids, *phones}):
        if at < taken:
            continue
        end = max(ids.get(at, 0), phones.get(at, 0))
        n, around = rest[at:end], context(rest, at, end)
        as_phone, as_id = _NEVER, _NEVER
        threes = bool(re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", n))
        lettered = any(c.isalpha() for c in n)
        if at in ids and ids[at] >= phones.get(at, 0):
            as_id = 2.2 if threes or lettered else 0.5
            if threes or lettered:
                counted.append(("id_number", around))
        if at in phones:
            parted = len(re.split(_SEP, n)) > 1
            as_phone = (1.5 if n[0] in "+(" or n[0] == "0" and parted or len(re.split(_SEP, n)) > 2 else 0.5) - (3.0 if threes or re.fullmatch(r"00 \d{3} \d{3} \d{3}", n) else 0.0)
            if n[0] in "+(" and not lettered:
                counted.append(("phone", around))
        if re.match(r"-?[A-Za-z]\b|\s?(?:ms|MB|kPa|%)", rest[end : end + 8]):
            as_phone, as_id = as_phone - 3.0, as_id - 3.0  # a longer code, or a unit
        out.append(("number", at, end, (as_phone, as_id), around))
        spans.append((at, end))
        taken = end
    streets = []
    for m in _ADDRESS.finditer(rest):
        a, b = m.span()
        names = [w for w in _LETTERS.findall(m.group()) if len(w) > 1]
        small = not any(w[0].isupper() for w in (names[:-1] if m.lastgroup == "en" else names[1:] if m.lastgroup in ("fr", "es") else names))
        follows = bool(_AFTER_ADDRESS.match(rest[b : b + 10]))
        around = context(rest, a, b)
        out.append(("street", a, b, (1.0 + follows - (0.75 if m.lastgroup == "en" else 1.5) * small,), around))
        streets.append((a, b))
        if follows and not small:
            counted.append(("address", around))
    spans += streets
    for m in _PLAIN.finditer(rest):
        if not any(m.start() < b and a < m.end() for a, b in spans):
            counted.append(("plain", context(rest, m.start(), m.end())))
    return out, counted, masked(rest, [(a, b) for k, a, b, v, _ in out if k != "email" and max(v) > 0])


def odds_of(word: dict[str, float] | None, totals: dict[str, float], kind: str) -> float:
    """The log-odds that one word of the context gives to a class against plain numbers."""
    seen = sum(word.values()) if word else 0
    if seen < SELDOM:
        return 0.0
    v = math.log((word[kind] + 0.5) / (totals[kind] + 1)) - math.log((word["plain"] + 0.5) / (totals["plain"] + 1))
    return max(-BOUND, min(BOUND, v)) * min(1.0, seen / OFTEN)


def windows(text: str, given: frozenset) -> list[list[tuple[int, str, bool]]]:
    """The runs of words in which a name may stand: lists of (start, word, whether something separates it from the word before)."""
    tokens = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t == "." and tokens and tokens[-1][0] + len(tokens[-1][1]) == m.start() and (len(tokens[-1][1]) == 1 and tokens[-1][1].isupper() or tokens[-1][1].lower() in _TITLES):
            tokens[-1] = (tokens[-1][0], tokens[-1][1] + ".", tokens[-1][2])
            continue
        end = tokens[-1][0] + len(tokens[-1][1]) if tokens else 0
        gap = text[end : m.start()]
        tokens.append((m.start(), t, bool(tokens) and not (gap in (" ", "", "\xa0"))))
    out, n = [], len(tokens)
    kind = ["x"] * n
    for i, (_, t, _) in enumerate(tokens):
        bare = t.rstrip(".")
        if t == ",":
            kind[i] = ","
        elif not bare or not bare[0].isalpha():
            kind[i] = "x"
        elif bare[0].isupper():
            kind[i] = "I" if len(bare) == 1 and t.endswith(".") else "C"
        elif bare in _PARTICLES:
            kind[i] = "p"
        else:
            kind[i] = "l"
    i = 0
    while i < n:
        if kind[i] not in "CIp":
            i += 1
            continue
        j = i
        while j + 1 < n and kind[j + 1] in "CIp," and not tokens[j + 1][2]:
            if kind[j + 1] == "," and not (j + 2 < n and kind[j + 2] in "CIp"):
                break
            j += 1
        caps = [k for k in range(i, j + 1) if kind[k] in "CI"]
        if len(caps) > 1:
            first = max(0, i - 2)
            out.append(tokens[first : j + 2])
        i = j + 1
    return out


def count_words(text: str, runs: list[list[tuple[int, str, bool]]], given: frozenset, out: Counter) -> None:
    """Adds (word, kind, partner) -> times of a text: 'low' and 'cap' forms; 'after' and 'before' a known given name (partner); 'then' another capital word (partner)."""
    for w in _WORDS.findall(text):
        out[w.casefold(), "low" if w[0].islower() else "cap", ""] += 1
    for run in runs:
        told: list[str] = []
        ahead = [t for _, t, _ in run]
        for k, t in enumerate(ahead):
            low = t.casefold()
            if low in given and t[0].isupper():
                told = [low]
                # surname, given
                if k > 1 and ahead[k - 1] == "," and ahead[k - 2][:1].isupper() and ahead[k - 2].casefold() not in given:
                    out[ahead[k - 2].casefold(), "before", low] += 1
            elif t[:1].isupper() and len(t.rstrip(".")) > 1:
                if told and "the" not in {a.casefold() for a in ahead[max(0, k - 3) : k - 1]}:
                    out[low, "after", told[0]] += 1
                told = []
                nxt = k + 1
                while nxt < len(ahead) and ahead[nxt].lower() in _PARTICLES:
                    nxt += 1
                # "Ask Doe, Jane" says nothing of Ask.
                turned = nxt + 2 < len(ahead) and ahead[nxt + 1] == "," and ahead[nxt + 2][:1].isupper()
                if nxt < len(ahead) and len(ahead[nxt].rstrip(".")) > 1 and ahead[nxt][:1].isupper() and not run[nxt][2] and not turned:
                    out[low, "then", ahead[nxt].casefold()] += 1
            elif not (t.lower() in _PARTICLES or len(t.rstrip(".")) == 1 and t != ","):
                told = []


_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def lexicon(counts: DataFrame) -> DataFrame:
    """(word, low, cap, surname, givens): how a word is written over all texts, and what stands around it.

    counts: (word, kind, partner, n), each once. surname: times a known given name stands before (or, with a comma, after)
    the word, at most EACH for each different one; givens: times that a word with such evidence follows it.
    """
    forms = counts.groupBy("word").agg(
        F.sum(F.when(F.col("kind") == "low", F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("kind") == "cap", F.col("n")).otherwise(0)).alias("cap"),
        F.sum(F.when(F.col("kind").isin("after", "before"), F.least(F.col("n"), F.lit(EACH))).otherwise(0)).alias("surname"),
        F.countDistinct(F.when(F.col("kind").isin("after", "before"), F.col("partner"))).alias("different"),
    )
    surnames = forms.filter("different >= 2 AND low * 20 <= cap").select(F.col("word").alias("partner"))
    firsts = counts.filter("kind = 'then'").join(surnames, "partner", "left_semi").groupBy("word").agg(F.sum("n").alias("givens"))
    return forms.join(firsts, "word", "left").select("word", "low", "cap", "surname", F.coalesce("givens", F.lit(0)).alias("givens"))


def _is_monsieur(rows: list[tuple], i: int, given: frozenset) -> bool:
    """Whether "M." is a title: a given name or an initial follows, or a turned name that the sentence goes on from."""
    ahead = [r for r in rows[i + 1 : i + 6] if r[0] == rows[i][0]]
    words = [r[3] for r in ahead]
    if not words:
        return False
    if words[0].casefold() in given or len(words[0]) == 2 and words[0].endswith(".") or len(words) > 1 and words[1] != "," and words[0][:1].isupper() and words[1][:1].isupper() and len(words[1]) > 2 and not ahead[1][4]:
        return True
    return len(words) > 3 and words[1] == "," and words[2][:1].isupper() and words[3].lower() in ("habite", "a", "est", "au", "et", "qui", "ou")


def similar(a: str, b: str) -> bool:
    """Whether two folded words may be spellings of one: at most one letter changed, added or missing, in five or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[head + (len(a) >= len(b)) :] == b[head + (len(b) >= len(a)) :]


def name_nodes(rows: list[tuple], given: frozenset) -> tuple[list[list[float]], list[tuple]]:
    """(potentials, edges) of the words of one document; rows: (window, place, start, word, apart, low, cap, surname, givens), in order."""
    unary, edges = [], []
    # Words met before, by the halves of which similar ones share at least one.
    seen: dict[tuple, dict[str, int]] = {}
    for i, (win, _, _, word, apart, low, cap, surname, givens) in enumerate(rows):
        bare = word.rstrip(".")
        o, g, p, s, k = 0.0, _NEVER, _NEVER, _NEVER, _NEVER
        if word == ",":
            k = 0.0
        elif bare.lower() in _TITLES or not bare or not bare[0].isalpha() or word == "M." and _is_monsieur(rows, i, given):
            pass
        elif bare[0].isupper() and len(bare) == 1:
            g = 0.2
        elif bare[0].isupper():
            known = bare.casefold() in given
            low, cap = low or 0, max(1, cap or 0)
            # Log-odds of being an ordinary word, of being a surname and of being a given name, from the counts.
            o = max(0.0, min(4.0, 1.0 + 0.6 * math.log((low + 0.5) / (cap + 0.5)))) if not known else 0.0
            if bare.isupper() and len(bare) < 4:
                o += 3.0
            g = 1.6 if known else min(1.6, 1.6 + 2.0 * math.log(((givens or 0) + 0.2) / (cap + 0.5) + 0.02))
            # One given name alone says nothing of a word that is seen often.
            told = max(0.0, (surname or 0) - (EACH - 0.5) * min(1.0, cap / 10))
            s = min(2.2, 1.5 + 1.4 * math.log((told + 0.25) / (min(cap, ENOUGH) + 0.5))) if not known else -1.5
        elif bare in _PARTICLES:
            p = 0.3
        unary.append([o, g, p, s, k, s])
        if i and rows[i - 1][0] == win:
            before = rows[i - 1][3].rstrip(".").lower()
            if before == "the":
                # The Rose Valley build: what follows an article is no person.
                unary[i][1] -= 2.5
                unary[i][3] -= 2.5
                unary[i][5] -= 2.5
            if before in _TITLES or rows[i - 1][3] == "M." and unary[i - 1][1] <= _NEVER:
                unary[i][3] += 1.6
            edges.append((i - 1, i, _BROKEN if apart else STEP))
        elif i:
            edges.append((i - 1, i, [[0.0] * len(LABELS) for _ in LABELS]))
        if len(bare) > 2 and bare[0].isupper():
            form = bare.casefold()
            half = len(form) // 2
            keys = [(0, form[: max(2, half - 1)]), (1, form[-max(2, half - 1) :])]
            linked = {at for k in keys for other, at in seen.get(k, {}).items() if i - at > 1 and similar(form, other)}
            edges += [(at, i, _SKIP) for at in sorted(linked)]
            for k in keys:
                seen.setdefault(k, {})[form] = i
    return unary, edges


def read_names(rows: list[tuple], labels: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the names that the labels of the words spell."""
    out, i, n = [], 0, len(rows)
    while i < n:
        win = rows[i][0]

        def run_of(at: int, kinds: str, first: bool = False) -> int:
            end = at
            while end < n and labels[end] in kinds and rows[end][0] == win and (end == at and first or not rows[end][4]):
                end += 1
            return end

        if labels[i] in "GPST":
            g = run_of(i, "G", True)
            p = run_of(g, "P", g == i)
            s = run_of(p, "S", p == i)
            if s > p:  # given names, particles, surname; a lone surname counts behind a title
                if g > i or i and rows[i - 1][0] == win and rows[i - 1][3].rstrip(".").lower() in _TITLES | {"m"}:
                    out.append((rows[i][2], rows[s - 1][2] + len(rows[s - 1][3])))
                i = s
                continue
            if g > i:  # a lone given name
                i = g
                continue
            t = run_of(p, "T", p == i)
            k = run_of(t, "K")
            back = run_of(k, "G")
            if back > k > t > p:  # surname, given names
                # A small particle after a small word is a preposition: "the parcel of Doe, Jane" in French or Spanish.
                led = p > i and i and rows[i - 1][0] == win and rows[i - 1][3][:1].islower() and rows[i][3][:1].islower()
                out.append((rows[p if led else i][2], rows[back - 1][2] + len(rows[back - 1][3])))
                i = back
                continue
        i += 1
    return out


def candidate_nodes(found: list[tuple], offset: int) -> tuple[list[list[float]], list[tuple]]:
    """(potentials, edges) of the candidates (kind, start, end, text, potentials), numbered from ``offset``, by place."""
    unary = [[0.0, *v] for *_, v in found]
    edges = []
    last: dict[tuple, int] = {}
    for i, (kind, start, end, text, _) in enumerate(found):
        width = len(unary[i])
        for j in range(i - 1, -1, -1):
            if found[j][2] <= start and found[j][0] != "street":
                break
            if found[j][2] > start:
                # Candidates that overlap: at most one of them is something.
                edges.append((offset + j, offset + i, [[_NEVER if x and y else 0.0 for y in range(width)] for x in range(len(unary[j]))]))
        key = (kind, re.sub(r"\W", "", text).casefold())
        if key in last and not any(e[:2] == (offset + last[key], offset + i) for e in edges):
            edges.append((offset + last[key], offset + i, [[0.7 if x == y else 0.0 for y in range(width)] for x in range(width)]))
        last[key] = i
    return unary, edges


def document_spans(words: list[tuple], found: list[tuple], given: frozenset) -> list[tuple[str, int, int]]:
    """(type, start, end) of all mentions of a document, by one field over its words and candidates."""
    unary, edges = name_nodes(words, given)
    n = len(unary)
    more, links = candidate_nodes(found, n)
    if not unary and not more:
        return []
    labels = best_labels(unary + more, edges + links)
    out = [("name", a, b) for a, b in read_names(words, [LABELS[x] for x in labels[:n]])] if words else []
    return out + [(CANDIDATES[kind][x - 1], a, b) for (kind, a, b, _, _), x in zip(found, labels[n:]) if x]


def given_names(names: DataFrame) -> frozenset:
    """The given names of the fixed table, folded; refuses more than MOST_GIVEN_NAMES rows."""
    rows = names.select("given_name").filter("given_name IS NOT NULL").distinct().limit(MOST_GIVEN_NAMES + 1).collect()
    if len(rows) > MOST_GIVEN_NAMES:
        raise ValueError(f"more than {MOST_GIVEN_NAMES} given names")
    return frozenset(r.given_name.casefold() for r in rows)


_SPANS = "src_table string, record_id string, text_id long, pii_type string, start_char int, end_char int"
_NODES = "src_table string, record_id string, text_id long, win int, place int, start int, stop int, token string, apart boolean, shape array<double>, word string, partner string"
_NODE_NAMES = [x.split()[0] for x in _NODES.split(", ")]


def nodes(texts: DataFrame, given: frozenset) -> DataFrame:
    """The nodes of every document, one pass over its text: words of windows (win from 0), candidates (win -1, a row for
    each word of the context), and counts, summed within batches: of contexts (win -2, token the class, start the count)
    and of words (win -3, token the kind).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            count: Counter = Counter()
            words: Counter = Counter()
            for s, r, i, t in zip(pdf["src_table"], pdf["record_id"], pdf["text_id"], pdf["text"]):
                found, contexts, rest = candidates(t)
                for k, (kind, a, b, shape, around) in enumerate(found):
                    out += [(s, r, i, -1, k, a, b, f"{kind} {t[a:b]}", False, list(shape), w, None) for w in (around or [""])]
                for kind, around in contexts:
                    count.update((kind, w) for w in around)
                    count[kind, ""] += 1
                runs = windows(rest, given)
                count_words(rest, runs, given, words)
                for w, run_of in enumerate(runs):
                    out += [(s, r, i, w, k, start, start + len(word), word, apart, None, word.rstrip(".").casefold(), None) for k, (start, word, apart) in enumerate(run_of)]
            out += [("", "", 0, -2, 0, n, 0, kind, False, None, w, None) for (kind, w), n in count.items()]
            out += [("", "", 0, -3, 0, n, 0, kind, False, None, w, partner) for (w, kind, partner), n in words.items()]
            yield pd.DataFrame(out, columns=_NODE_NAMES)

    return texts.mapInPandas(run, _NODES)


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src_table, record_id, text_id, pii_type, start_char, end_char) of every mention in (src_table, record_id, text).

    Null and blank texts have none; equal rows give one result; records with several texts are told apart by text_id, a
    hash of the text. Texts are read whole. An empty table of given names leaves what initials and the texts themselves
    teach; in a table too small to teach anything, shapes alone decide.
    """
    given = given_names(names)
    texts = texts.filter("text IS NOT NULL").select("src_table", "record_id", "text").distinct().withColumn("text_id", F.xxhash64("text"))
    # Staged, as the counts of contexts and the documents read it.
    node = stage(nodes(texts, given))
    counts = node.filter("win = -2").groupBy("word").agg(*[F.sum(F.when(F.col("token") == c, F.col("start")).otherwise(0)).cast("double").alias(c) for c in CLASSES])
    totals = counts.filter("word = ''").select(F.struct(*CLASSES).alias("totals"))
    said = node.filter("win = -3").groupBy("word", F.col("token").alias("kind"), "partner").agg(F.sum("start").alias("n"))
    learned = lexicon(said).select("word", "low", "cap", "surname", "givens", F.lit(None).cast("array<double>").alias("around"))
    around = counts.filter("word <> ''").select("word", *[F.lit(0).cast("long").alias(c) for c in ("low", "cap", "surname", "givens")], F.array(*CLASSES).alias("around"))
    # One row at most: the totals of the classes.
    rows = node.filter("win > -2").drop("partner").join(learned.unionByName(around), "word", "left").join(F.broadcast(totals), F.lit(True), "left")

    def fold(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        words, found = [], {}
        for win, place, start, stop, token, apart, shape, low, cap, surname, givens, seen, totals in group:
            if win >= 0:
                words.append((int(win), int(place), int(start), token, bool(apart), low or 0, cap or 0, surname or 0, givens or 0))
                continue
            kind, _, text = token.partition(" ")
            entry = found.setdefault(int(place), [kind, int(start), int(stop), text, list(shape)])
            if seen is not None and totals is not None and kind != "email":
                word, whole = dict(zip(CLASSES, seen)), totals if isinstance(totals, dict) else totals.asDict()
                for x, c in enumerate(CANDIDATES[kind]):
                    entry[4][x] += WEIGHT * odds_of(word, whole, c)
        for kind, a, b in document_spans(words, sorted(map(tuple, found.values()), key=lambda c: (c[1], c[2])), given):
            yield (*key, kind, a, b)

    return in_groups(rows, ["src_table", "record_id", "text_id"], ["win", "place"], fold, ["win", "place", "start", "stop", "token", "apart", "shape", "low", "cap", "surname", "givens", "around", "totals"], _SPANS)


def redacted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src_table, record_id, text): every text that is not null, each mention replaced by the placeholder of its type."""
    found_spans = mentions(texts, names).groupBy("src_table", "record_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("spans"))
    rows = texts.filter("text IS NOT NULL").select("src_table", "record_id", "text").distinct().withColumn("text_id", F.xxhash64("text"))
    on = [rows[c].eqNullSafe(found_spans[c]) for c in ("src_table", "record_id", "text_id")]
    joined = rows.join(found_spans, on, "left").select(rows["src_table"], rows["record_id"], rows["text"], "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [replaced(t, [] if s is None else [(x["start_char"], x["end_char"], x["pii_type"]) for x in s]) for t, s in zip(pdf["text"], pdf["spans"])]
            yield pdf.drop(columns="spans")

    return joined.mapInPandas(run, "src_table string, record_id string, text string")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join([*out, text[at:]])


def sources(messages: DataFrame, memories: DataFrame, reports: DataFrame) -> DataFrame:
    one = lambda df, name, key, text: df.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
    return one(messages, "thread_messages", "message_id", "content").unionByName(one(memories, "memories", "memory_id", "value")).unionByName(one(reports, "message_reports", "report_id", "details"))


def found(messages: DataFrame, memories: DataFrame, reports: DataFrame, names: DataFrame) -> DataFrame:
    """(src_table, record_id, pii_type, start_char): each mention in the three tables."""
    return mentions(sources(messages, memories, reports), names).select("src_table", "record_id", "pii_type", "start_char").distinct()
