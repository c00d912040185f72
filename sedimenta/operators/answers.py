"""Answer metrics over question sets: token overlap, F1, BLEU-1, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import let
from ..functions import text as T

RELEVANT = 0.5


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words, without leaving the row."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda s: F.aggregate(F.array_intersect(s["b"], s["a"]), F.lit(0), lambda n, w: n + F.least(times(s["a"], w), times(s["b"], w))))


def _sides(a: Column, b: Column, use) -> Column:
    """``use`` on a struct of both arrays, their sizes and their overlap, each worked out once."""
    sized = lambda s: F.struct(F.size(s["p"]).alias("n"), F.size(s["r"]).alias("m"), overlap(s["p"], s["r"]).alias("same"))
    return let(F.struct(a.alias("p"), b.alias("r")), lambda s: let(sized(s), use))


def _words(text: Column) -> Column:
    return F.filter(F.split(T.normalize_answer(text), " "), lambda x: x != "")


def held_share(text: Column, gold: Column) -> Column:
    """Share of the gold passage's words that a text holds; null where the passage has none."""
    return _sides(T.words(text), T.words(gold), lambda s: F.when(s["m"] > 0, F.round(s["same"] / s["m"], 6)))


def f1(prediction: Column, reference: Column) -> Column:
    """Token F1 of normalised answers, unstemmed; 0 without common words."""
    return _sides(_words(prediction), _words(reference), lambda s: F.when(s["same"] == 0, 0.0).otherwise(F.round(2.0 * s["same"] / (s["n"] + s["m"]), 6)))


def bleu1(prediction: Column, reference: Column) -> Column:
    """Clipped unigram precision with brevity penalty; 0 for an empty side, smoothed where no word is common."""

    def score(s: Column) -> Column:
        precision = F.when(s["same"] == 0, 0.1 / s["n"]).otherwise(s["same"] / s["n"])
        return F.when((s["n"] <= 0) | (s["m"] <= 0), 0.0).otherwise(F.round(precision * F.when(s["n"] < s["m"], F.exp(1 - s["m"] / s["n"])).otherwise(1.0), 6))

    return _sides(_words(prediction), _words(reference), score)


def multi_f1(prediction: Column, reference: Column) -> Column:
    """Mean over the comma-separated references of the best F1 among the comma-separated predictions."""
    parts = lambda c: F.transform(F.split(c, ","), T.trimmed)
    best = F.transform(parts(reference), lambda r: F.array_max(F.transform(parts(prediction), lambda p: f1(p, r))))
    return F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best), 6)


def category_f1(prediction: Column, reference: Column, category: Column) -> Column:
    """F1 by question category: lists for 1, the part before a semicolon for 3, plain for 2 and 4, null for 5."""
    return F.when(category == 1, multi_f1(prediction, reference)).when(category == 3, f1(prediction, T.trimmed(F.element_at(F.split(reference, ";"), 1)))).when(category.isin(2, 4), f1(prediction, reference))


def summarise(rows: DataFrame, by: list[str], means: list[str], label: str | None = None) -> DataFrame:
    """Means to four digits and, with a label column, its shares in percent to two digits."""
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in means])
    if label is None:
        return base
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("k"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, by).select(*by, label, F.round(100.0 * F.col("k") / F.col("n"), 2).alias("percent"))


_VOWEL = "aeiou"


def _shape(word: str) -> str:
    """A word as runs of consonants (c) and vowels (v); y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in _VOWEL or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).replace("cc", "c").count("vc")


#: The published suffix rules by step, as (suffix, what takes its place); the measure asked for is 0, 0 and 1.
_STEPS = (
    (0, "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble"),
    (0, "icate ic ative - alize al iciti ic ical ic ful - ness -"),
    (1, "al - ance - ence - er - ic - able - ible - ant - ement - ment - ent - ion - ou - ism - ate - iti - ous - ive - ize -"),
)


def stem(word: str) -> str:
    """The stem of an English word by the published suffix-stripping algorithm of 1980; short words stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            w = w[: len(w) - len(ending)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for ending in ("ed", "ing"):
            base = w[: len(w) - len(ending)]
            if w.endswith(ending) and "v" in _shape(base):
                double = len(base) > 1 and base[-1] == base[-2] and base[-1] not in "lsz" and _shape(base)[-1] == "c"
                w = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if double else base + "e" if _measure(base) == 1 and _short(base) else base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for least, rules in _STEPS:
        listed = rules.split()
        found = max((r for r in zip(listed[::2], listed[1::2]) if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if found:
            base = w[: len(w) - len(found[0])]
            if _measure(base) > least and not (found[0] == "ion" and base[-1:] not in ("s", "t")):
                w = base + found[1].replace("-", "")
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _short(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _short(base: str) -> bool:
    """Ends consonant, vowel, consonant, and not in w, x or y."""
    return _shape(base)[-3:] == "cvc" and base[-1] not in "wxy"


def stemmed_f1(pairs: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """(key, f1): token F1 of normalised answers over stems; in Arrow batches, as stemming is no built-in function."""
    import pandas as pd

    rows = pairs.select(key, _words(F.col(prediction)).alias("p"), _words(F.col(reference)).alias("r"))

    def run(batches):
        from collections import Counter

        known: dict[str, str] = {}
        for pdf in batches:
            out = []
            for p, r in zip(pdf["p"], pdf["r"]):
                a, b = (Counter(known.setdefault(w, stem(w)) for w in (x if x is not None else ())) for x in (p, r))
                same = sum((a & b).values())
                out.append(round(2.0 * same / (sum(a.values()) + sum(b.values())), 6) if same else 0.0)
            if len(known) > 200_000:
                known.clear()
            yield pd.DataFrame({key: pdf[key], "f1": out})

    return rows.mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, f1 double")
