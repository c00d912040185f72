"""Problem 4: defects of question-answer pairs.

Method: the openings of all answers are clustered by MinHash with verified Jaccard similarity. An answer has several: its
first words, and the words after a lead such as "Sorry, but". A template, that is a cluster, counts when it recurs across
unrelated prompts: questions whose own openings fall into different clusters. Its evidence is the log-odds between the
prompts that got an apology or wording of declining with it and those that did not; the strongest template of an answer
decides, so that wordings no list holds are found by their company, and an apology in a template of plain facts is none.
Copies, foreign languages and broken ends are found by direct checks, the last two with counts of words over all pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import SPACES, UNICODE_SPACE, fold_streams, stage

#: Words of the openings, codes, numbers and names masked; where a lead may end; shingles have GRAM characters.
DEPTHS, LEAD, TOPIC = (3, 5, 8), 6, 3
GRAM = 4
BANDS, ROWS = 8, 4
SIMILAR = 0.8
#: Questions, and clusters of questions, that a template must answer to count as recurring across unrelated prompts.
RECURRING, UNRELATED = 3, 2
#: Log-odds that an apology of the answer itself counts for, and its lack against.
OWN = 0.5
#: Words of a short phrase, and how many times as often as it the answers in which its last word goes on may stand before it counts as cut.
PHRASE, GOES_ON = 6, 4

#: Texts that stand for nothing.
PLACEHOLDERS = {
    "na", "n a", "nan", "none", "null", "nil", "nothing", "tbd", "tba", "todo", "empty", "blank", "undefined", "missing", "no answer", "not available", "not applicable",
    "no response", "no answer given", "no answer available", "unanswered", "keine antwort", "keine angabe", "k a", "entfällt", "leer", "sin respuesta", "no disponible", "no aplica",
    "vacío", "ninguna respuesta", "sans réponse", "pas de réponse", "aucune réponse", "non disponible", "vide", "s o", "xxx", "answer", "antwort", "réponse", "respuesta", "placeholder", "to be determined", "to be done", "pending",
}
#: Labels before a copied question.
LABELS = {"q", "question", "frage", "f", "pregunta", "p", "a", "answer", "antwort", "réponse", "respuesta", "r", "prompt", "user"}

#: Function words by language.
FUNCTION = {
    "en": "the of and is are was were be been being to that which with for from this these it its by as at on in if not but they their there can cannot has have had will would what when where who why how does did do may must because before after until than or an any every each both according",
    "de": "der die das den dem des und ist sind war werden wird wurde nicht mit auf für von zu zum zur im ein eine einen einem einer eines auch als bei nach wenn wie was wer wo warum wann welche sich dass damit oder aber es er sie aus über unter vor durch haben hat weil wir ohne um bis sowohl dabei diesem lange darf muss kann ihr ich mich mir",
    "fr": "le la les des du une un et est sont était dans pour par sur avec sans que qui quoi où quand comment pourquoi quel quelle ne pas plus ce cette ces il elle nous vous ils se sa son ses au aux en mais ou afin après avant même si je cas trop dont depuis jusqu entre parce qu d l n c s j m",
    "es": "el la los las un una unos unas y es son era está en de del al que qué quién cómo cuándo dónde cuál por para con sin sobre no se su sus lo le les nos pero o más muy este esta estos desde hasta cuando si yo porque hay ha han fue entre según puede ya",
    "it": "il lo la gli le un una di del della dei delle e è sono era in nel nella che chi non con per su da al alla prima dopo ogni si suo sua come quando dove perché ma più anche questo questa questi ha hanno fino ai dal",
    "nl": "de het een en is zijn was van in op met voor niet dat die deze dit te om naar bij aan uit door als wanneer waar wie hoe waarom maar of ook elke elk hij zij tot na heeft hebben wordt worden nog over tijdens totdat",
    "pt": "o a os as um uma uns umas e é são era em no na nos nas de do da dos das que quem não com por para sem sobre se seu sua seus mais muito este esta isso quando onde como porque mas ou ao à pelo pela depois antes todas todos cada até foi está",
    "pl": "i w na z do nie się jest są to że jak po przed przez dla od który która ale lub oraz każdy po gdy gdzie kiedy",
    "sv": "och är en ett det den som på av för med till inte att om från vid efter innan när var hur varför men eller har hade varje alla kan",
    "da": "og er en et det den som på af for med til ikke at om fra ved efter før når hvor hvordan hvorfor men eller har havde hver alle kan",
    "tr": "ve bir bu için ile de da değil olarak her sonra önce ne nasıl neden nerede kadar gibi ama veya çok daha",
}
_LANGS = {lang: frozenset(words.split()) for lang, words in FUNCTION.items()}
#: Words after which no sentence or phrase can end.
OPEN_ENDED = {
    "en": "the a an of and or to with for from by as at in on into if because although but that which whose every each both their its his her my your our unless until while whenever than between during about under over after before when is are was were be been has have had shall must may will would can could should not so even only such no any according without within this these those where who and/or via per",
    "de": "der die das den dem des und oder mit auf für von zu zum zur im am an ein eine einen einem einer eines als bei nach wenn dass damit aber aus über unter vor durch weil ohne um sowohl auch ist sind wird werden muss kann darf nicht nur trotz während gemäß innerhalb in beim vom ins jeder jede jedes diese dieser dieses derselben wie bis zwischen sich",
    "fr": "le la les des du une un et ou dans pour par sur avec sans que qui dont ne ce cette ces se sa son ses au aux en mais si de à afin avant après même chaque leur leurs est sont doit peut selon vers chez entre pendant malgré d l qu n c s j m jusqu parce trop très lorsque quand où depuis sous plus ni",
    "es": "el la los las un una unos unas y o en de del al que por para con sin sobre no se su sus lo le les pero este esta estos si porque según es son está debe puede hasta desde cuando como muy cada entre a e u durante tras ha han hay más tan aunque donde cuyo nos me mi",
}
_OPEN = frozenset(w for words in OPEN_ENDED.values() for w in words.split())
# Endings that are words of one language and common endings in another, or units.
_MAY_END = {"en": {"in", "on", "so", "no", "can", "not", "is", "are", "was", "were", "has", "have", "before", "after", "must", "may", "will"}}

_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|‹[^›]*›|(?<!\w)'[^']*'(?!\w)")
_CODE = re.compile(r"\b[A-Z]{1,6}-\d+\b|\b\w*\d\w*\b")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
_CLOSED = re.compile(r"[.!?][\"'”’»“)\]]*\s*$|[;:]\s*$")
_ELLIPSIS = re.compile(r"(?:\.{3,}|…+)\s*$")

#: What a speaker says of itself, and words of declining, by language.
_SELF = re.compile(r"\b(?:i|i'm|i’m|me|my|myself|i'd|i'll|ich|mir|mich|mein\w*|je|j['’]\w+|m['’]\w+|moi|me|mon|mes|puedo|debo|prefiero|tengo|quiero|estoy|soy|se me|we (?:can(?:not|'t|’t)|are (?:not|unable)|do not|will not|must decline)|wir (?:können|dürfen|möchten)|nous ne|no podemos)\b", re.I)
_DECLINE = re.compile(
    r"\b(?:can(?:not|'t|’t| not)|can no longer|won['’]t|will not|would not|unable|not able|not allowed|not permitted|not authori[sz]ed|barred|declin\w+|refus\w+|guidelines|polic(?:y|ies)|do(?:n['’]t| not) have (?:access|permission|the right)|no comment"
    r"|rather (?:not|leave)|falls? outside|against my|must pass|unanswered|beyond what"
    r"|nicht (?:beantworten|helfen|sprechen|möglich|zu|dienen|weiterhelfen|äußern|erlaubt|gestattet|mitteilen)|kein\w* auskunft|kein\w* angaben|verweiger\w*|ablehnen|steht es mir nicht|nicht zu\b"
    r"|(?:ne|n['’]\w*) .{0,25}\bpas\b|pas en mesure|m['’]abstenir|impossible|dépasse|droit|refuser|décliner"
    r"|no puedo|no se me|no tengo|no estoy|debo (?:rechazar|declinar)|prefiero no|fuera de lo|rechazar|no me (?:es|está)|no quiero|abstenerme)",
    re.I,
)
_SORRY = re.compile(
    r"^\W*(?:(?:i['’]?m |i am |we['’]re )?(?:so |very |really )?sorry\s*(?:,|but|\.|!)|apologies\b|i apologi[sz]e|unfortunately\b|regrettably\b|as an? (?:ai |language )?(?:assistant|model)\b|thank you for asking\b|i['’]m afraid\b"
    r"|leider\b|es tut mir leid|entschuldig\w+|tut mir leid|bedauerlicherweise|als assistent\w*|je suis désolée?|désolée?\b|malheureusement|en tant qu['’]assistant\w*|je regrette|pardon\b|lo siento|perdón\b|lamentablemente|disculp\w+|lamento|como asistente)",
    re.I,
)

#: Declining without a speaker, by language; it counts for templates that recur across unrelated questions only.
_IMPERSONAL = re.compile(
    r"\b(?:this|that|such an?|your|these|such) (?:questions?|requests?|topics?|subjects?|matters?|query|queries|inquiry)\b[^.!?]{0,40}?\b(?:can(?:not|['’]t| not)|could not|may not|must not|will not|won['’]t|is not|are not|not going to) (?:be )?(?:\w+ )?(?:answered|discussed|addressed|fulfilled|granted|processed|completed|handled|met|shared|covered|taken)"
    r"|\bno (?:answer|comment|reply|response|information|statement|help|assistance|advice|details)\b[^.!?]{0,40}\b(?:given|provided|offered|possible|shared|made)\b"
    r"|\b(?:answer|reply|response|information|details|help|assistance|advice|comment)\b[^.!?]{0,20}\b(?:cannot|can['’]t|can not|may not|must not|will not|won['’]t) be (?:given|provided|shared|disclosed|offered|made)"
    r"|\b(?:not (?:possible|permitted|allowed)|impossible|forbidden|prohibited) to (?:answer|discuss|comment|help|respond|disclose)\b|\b(?:answering|discussing|commenting|disclosing)\b[^.!?]{0,40}\b(?:not (?:possible|permitted|allowed)|impossible|forbidden|prohibited)\b"
    r"|\bnot something (?:that )?(?:can|may) be (?:answered|discussed|shared)|\b(?:must|has to|will have to) (?:remain|stay|go) unanswered\b|\boff[- ]limits\b"
    r"|\b(?:diese|deine|ihre|eure|solche)\w? (?:fragen?|anfragen?|themen?)\b[^.!?]{0,60}\bnicht (?:\w+ )?(?:beantwortet|besprochen|bearbeitet|behandelt|erfüllt)|\bkein\w* (?:antwort|auskunft|angaben|stellungnahme|kommentar)\b[^.!?]{0,40}\b(?:gegeben|erteilt|gemacht|möglich|abgegeben)"
    r"|\b(?:dazu|darüber|hierzu|hierüber)\b[^.!?]{0,40}\b(?:nicht|nichts)\b[^.!?]{0,20}\b(?:gesagt|gesprochen|geantwortet|mitgeteilt)"
    r"|\b(?:cette|votre|ta|telle) (?:question|demande)\b[^.!?]{0,30}?\b(?:ne |n['’])[^.!?]{0,20}\bpas\b[^.!?]{0,25}(?:répon\w+|traitée?|abordée?|satisfaite)|\baucune? (?:réponse|information|commentaire|précision)\b[^.!?]{0,30}\b(?:donnée?|fournie?|possible|communiquée?|fait)"
    r"|\b(?:n['’]est pas (?:possible|permis)|est (?:impossible|interdit)) (?:de |d['’])(?:y )?(?:répondre|parler|commenter|discuter|aider)"
    r"|\b(?:esta|esa|su|tu) (?:pregunta|solicitud|petición|consulta|cuestión)\b[^.!?]{0,30}?\bno\b[^.!?]{0,20}(?:respond\w+|contest\w+|atend\w+|trat\w+)|\bno (?:es posible|está permitido|se puede) (?:responder|contestar|hablar|comentar|ayudar)|\bno se (?:puede|da|dará|ofrece) (?:dar )?(?:ninguna )?(?:respuesta|información|ayuda)",
    re.I,
)


def plain(text: str) -> list[str]:
    """The words of a text in lower case, without signs."""
    return _WORD.findall(text.casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blank or a placeholder for nothing."""
    if answer is None:
        return True
    bare = answer.strip(SPACES + "​﻿")
    words = re.findall(r"[^\W_]+", bare.casefold())
    return not words or " ".join(words) in PLACEHOLDERS and len(words) <= 4 and len(bare) <= 30 and not (len(words) == 1 and bare[-1:] in ".!" and words[0] == "no")


def is_copy(question: str | None, answer: str | None) -> bool:
    """Nothing but the question, once or more, whatever case, spacing, marks or labels before it."""
    if not question or not answer:
        return False
    q, a = re.findall(r"[^\W_]+", question.casefold()), re.findall(r"[^\W_]+", answer.casefold())
    if not q or len(a) < len(q):
        return False
    at, n = 0, len(q)
    while at < len(a):
        for label in (0, 1, 2):
            if a[at + label : at + label + n] == q and all(w in LABELS or w.isdigit() for w in a[at : at + label]):
                at += label + n
                break
        else:
            return False
    return True


def masked_words(text: str) -> list[str]:
    """The words of a text in lower case, codes, numbers and names as one sign."""
    words = _CODE.sub("#", text).split()
    return [w.lower() if not i or not w[:1].isupper() or w in ("I", "I'm") else "#" for i, w in enumerate(words)]


def topic(question: str) -> str:
    """The masked opening of a question."""
    return " ".join(masked_words(question)[:TOPIC])


#: Small words between a lead and what follows it.
_BUT = {"but", "aber", "mais", "pero", "and", "und", "et", "y"}


def openings(answer: str) -> list[str]:
    """The masked openings of an answer: its first words, and the words after a lead, to several depths."""
    sentences = _SENTENCE.split(answer.strip(), maxsplit=2)
    words = masked_words(sentences[0] if len(sentences[0].split()) > 2 or len(sentences) < 2 else f"{sentences[0]} {sentences[1]}")
    out = [" ".join(words[:k]) for k in DEPTHS if len(words) >= k] or [" ".join(words)]
    for i, w in enumerate(words[:LEAD]):
        if w[-1] in ",:.!":
            rest = words[i + 1 :]
            rest = rest[1:] if rest and rest[0] in _BUT else rest
            out += [" ".join(rest[:k]) for k in DEPTHS if len(rest) >= k]
            break
    return list(dict.fromkeys(out))


def apologises(answer: str) -> bool:
    """Whether the answer opens with an apology or a role, and not in a quotation."""
    return bool(_SORRY.search(_QUOTED.sub(" ", answer).strip()))


def declines(answer: str) -> bool:
    """Whether any sentence declines, with or without a speaker; it counts within recurring templates, as one alone may tell of others."""
    return any(_IMPERSONAL.search(s) or _SELF.search(s) and _DECLINE.search(s) for s in _SENTENCE.split(_QUOTED.sub(" ", answer).strip()))


def shingles(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))}


def signature(text: str) -> list[int]:
    grams = np.array([xxhash.xxh64_intdigest(g) for g in shingles(text)], dtype=np.uint64)
    return (grams[:, None] * _HASHES[0] + _HASHES[1]).min(axis=0).tolist()


_HASHES = np.array([[xxhash.xxh64_intdigest(f"a{i}") | 1, xxhash.xxh64_intdigest(f"b{i}")] for i in range(BANDS * ROWS)], dtype=np.uint64).T


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def _band_rows(texts: DataFrame) -> DataFrame:
    """A row for each band of each opening; the other columns are carried."""
    carried = [c for c in texts.columns if c != "opening"]
    schema = "bucket string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = [signature(t) for t in pdf["opening"]]
            for b in range(BANDS):
                rows = pdf[["opening", *carried]].copy()
                rows.insert(0, "bucket", [f"{b}:{xxhash.xxh64_hexdigest(repr(s[b * ROWS : b * ROWS + ROWS]))}" for s in marks])
                yield rows

    return texts.select("opening", *carried).mapInPandas(run, schema)


def _placed(leaders: list[tuple[str, set]], row: tuple) -> Iterator[tuple]:
    """Each opening of a bucket goes to the first leader it is truly similar to, or becomes one."""
    text, *values = row
    mine = shingles(text)
    home = next((lead for lead, theirs in leaders if jaccard(mine, theirs) >= SIMILAR), None)
    if home is None:
        leaders.append((text, mine))
        home = text
    yield home, text, *values


def clusters(texts: DataFrame) -> DataFrame:
    """(bucket, leader, opening, other columns): the clusters of each band; texts: (opening, ...), each opening once.

    Openings that fall into one bucket of a MinHash band are compared with the leaders found in it and go to the first
    that they are truly similar to. A bucket streams through with its leaders only.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "opening")
    names = [c for c in texts.columns if c != "opening"]
    return fold_streams(_band_rows(texts), ["bucket"], ["opening"], list, _placed, lambda leaders: [], ["opening", *names], "bucket string, leader string, opening string" + (", " + schema if schema else ""))


def families(topics: DataFrame) -> DataFrame:
    """(topic, family): the cluster of each masked question; topics: (topic), each once."""
    placed = clusters(topics.select(F.col("topic").alias("opening")))
    return placed.groupBy(F.col("opening").alias("topic")).agg(F.min("leader").alias("family"))


def templates(said: DataFrame) -> DataFrame:
    """(opening, prompts, cued, unrelated): for each opening the questions its template answers, in how many of these the
    answer is cued, and over how many clusters of questions they spread; said: (opening, question_id, family, cued).

    Each opening is summed up before it is clustered; the clusters of a question are counted by a sketch, which is exact
    for few. Of the bands the one with the most questions counts.
    """
    each = said.groupBy("opening").agg(
        F.countDistinct("question_id").alias("prompts"), F.countDistinct(F.when(F.col("cued"), F.col("question_id"))).alias("cued"), F.hll_sketch_agg("family", F.lit(10)).alias("sketch")
    )
    # Staged, as the sums of the clusters and their members both read it.
    placed = stage(clusters(each))
    whole = placed.groupBy("bucket", "leader").agg(F.sum("prompts").alias("prompts"), F.sum("cued").alias("cued"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unrelated"))
    mine = placed.select("bucket", "leader", "opening").join(whole, ["bucket", "leader"])
    best = mine.groupBy("opening").agg(F.max_by(F.struct("prompts", "cued", "unrelated"), F.struct("prompts", "cued")).alias("t"))
    return best.select("opening", "t.*")


def evidence(usual: DataFrame) -> DataFrame:
    """(id, odds): the strongest log-odds of an answer's templates for being cued; none where no template recurs.

    usual: (id, openings, question_id, topic, apology, declined). Answers with the same openings are judged once.
    """
    known = families(usual.select("topic").filter("topic IS NOT NULL").distinct())
    rows = usual.join(known, "topic", "left").withColumn("cued", F.col("apology") | F.col("declined"))
    said = rows.select(F.explode("openings").alias("opening"), "question_id", F.coalesce("family", F.lit("")).alias("family"), "cued")
    told = templates(said).filter((F.col("prompts") >= RECURRING) & (F.col("unrelated") >= UNRELATED))
    told = told.select("opening", F.log((F.col("cued") + 0.5) / (F.col("prompts") - F.col("cued") + 0.5)).alias("odds"))
    sets = usual.select("openings").distinct()
    judged = sets.select("openings", F.explode("openings").alias("opening")).join(told, "opening").groupBy("openings").agg(F.max_by("odds", F.struct(F.abs("odds"), "odds")).alias("odds"))
    return usual.select("id", "openings").join(judged, "openings").select("id", "odds")


def language_hits(words: list[str]) -> dict[str, int]:
    return {lang: n for lang, known in _LANGS.items() if (n := sum(w in known for w in words))}


def sure_language(text: str, least: int = 2) -> str | None:
    """The language by function words, None where fewer than ``least`` or no clear one."""
    words = _LETTERS.findall(_CODE.sub(" ", _QUOTED.sub(" ", text)).casefold())
    hits = Counter(language_hits(words)).most_common(2)
    if not hits or hits[0][1] < least:
        return None
    return hits[0][0] if len(hits) == 1 or hits[0][1] >= hits[1][1] + 1 and hits[0][1] >= 1.3 * hits[1][1] else None


#: First words of questions.
_ASKING = {
    "en": "what where when why which who how can does did is according would could", "de": "was wo wann warum welche welcher welches wer wie wozu kann", "fr": "que où quand pourquoi quel quelle qui comment combien qu quels", "es": "qué dónde cuándo por cuál quién cómo cuánto puedes cuánta"
}


def question_language(text: str | None) -> str | None:
    if not text:
        return None
    words = _LETTERS.findall(text.casefold())
    hits = Counter(language_hits(words))
    for lang, first in _ASKING.items():
        if words and words[0] in first.split():
            hits[lang] += 3 if lang == "es" and "¿" in text else 2
    if "¿" in text:
        hits["es"] += 2
    top = hits.most_common(2)
    return top[0][0] if top and top[0][1] >= 2 and (len(top) == 1 or top[0][1] > top[1][1]) else None


def foreign(question: str | None, answer: str | None) -> str | None:
    """'yes' or 'no' where function words tell whether the answer is in another language, else None."""
    asked = question_language(question)
    if not asked or not answer:
        return "no"
    words = _LETTERS.findall(_CODE.sub(" ", _QUOTED.sub(" ", answer)).casefold())
    low = [w for w in words if w]
    if len(low) < 2:
        return "no"
    hits = Counter(language_hits(low))
    own = hits.get(asked, 0)
    best, most = (hits.most_common(1) or [("", 0)])[0]
    if best != asked and most >= 2 and most >= 2 * own + 1 and most * 6 >= len(low):
        return "yes"
    if own >= 2 or (own and own >= most):
        return "no"
    return None


def ending(answer: str) -> tuple[str, str | None]:
    """('whole' | 'broken' | 'ask', the last word): whether the end shows by itself that the answer breaks off."""
    text = answer.rstrip()
    dots = _ELLIPSIS.search(text)
    if dots:
        text = text[: dots.start()].rstrip()
    elif _CLOSED.search(text):
        return "whole", None
    if not text:
        return "whole", None
    if re.search(r"[«„“(\[{‹]\s*$|\((?:see|siehe|voir|véase|cf\.?|e\.g\.?)\s*$|[,–—-]\s*$|\b[A-Z]{2,6}-$", text):
        return "broken", None
    if text.count("«") > text.count("»") or text.count("„") > text.count("“") + text.count("”") or text.count("(") > text.count(")"):
        return "broken", None
    last = re.search(r"[^\s«»„“”\"()\[\]]+$", text)
    if not last:
        return "whole", None
    word = last.group().strip("'’,;:.")
    bare = re.split(r"['’]", word)[-1].casefold() or word.casefold()
    words = text.split()
    if len(words) > 1 and words[-2][:1].isdigit() and len(word) < 4:
        return "whole", None  # a unit
    if bare == "before" and words[-2:-1] == ["as"] or bare == "antes" and words[-2:-1] == ["que"]:
        return "whole", None
    if bare in _OPEN and len(words) > 1 and word[:1].islower():
        lang = sure_language(text, 1) or ""
        if bare not in _MAY_END.get(lang, ()) or len(words) > 2 and bare in ("in", "on", "is", "are", "was", "were", "has", "have", "must", "may", "will", "before", "after", "not", "can"):
            return "broken", None
    if word.endswith(("'", "’")) or last.group().endswith(("'", "’")):
        return "broken", None
    if dots and len(words) > 2:
        return "ask", word
    return ("ask", word) if len(words) > 1 else ("whole", None)


_FACTS = "item_table string, qid string, question string, answer string, state string, openings array<string>, topic string, apology boolean, declined boolean, alien string, tail string, last string, asked string, content array<string>"


def _facts(pairs: DataFrame) -> DataFrame:
    """What each pair shows by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for table, qid, question, answer, category in zip(pdf["item_table"], pdf["qid"], pdf["question"], pdf["answer"], pdf["category"]):
                if category == 5:
                    continue
                if is_empty(answer):
                    out.append((table, qid, question, answer, "empty", None, None, False, False, "no", "whole", None, None, None))
                    continue
                alien = foreign(question, answer)
                tail, last = ending(answer)
                words = [w for w in dict.fromkeys(_LETTERS.findall(_CODE.sub(" ", _QUOTED.sub(" ", answer)).casefold())) if len(w) > 2] if alien is None else None
                state = "copy" if is_copy(question, answer) else ""
                out.append((table, qid, question, answer, state, openings(answer), topic(question) if question else None, apologises(answer), declines(answer), alien or "ask", tail, last, question_language(question), words))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FACTS.split(", ")])

    return pairs.mapInPandas(run, _FACTS)


def _word_rows(pairs: DataFrame) -> DataFrame:
    """(word, language of the question, n) over the questions and answers, final words without a final sign left out; counted within each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter = Counter()
            asked = [question_language(q) or "" for q in pdf["question"]]
            for text, is_answer, lang in [*((t, False, g) for t, g in zip(pdf["question"], asked)), *((t, True, g) for t, g in zip(pdf["answer"], asked))]:
                if not text:
                    continue
                dots = _ELLIPSIS.search(text) if is_answer else None
                words = [w.strip(".,;:!?…'’\"«»„“”()[]") for w in (text[: dots.start()] if dots else text).split()]
                if is_answer and (dots or not _CLOSED.search(text)):
                    words = words[:-1]
                count.update((w, lang) for w in words if w)
            yield pd.DataFrame([(w, lang, n) for (w, lang), n in count.items()], columns=["word", "lang", "n"])

    return pairs.select("question", "answer").mapInPandas(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _pairs(items: DataFrame, name: str, category: Column) -> DataFrame:
    return items.select(F.lit(name).alias("item_table"), F.col("qid").cast("string").alias("qid"), "question", "answer", category.cast("int").alias("category")).distinct()


def defects(pairs: DataFrame) -> DataFrame:
    """(item_table, qid, defect) of the defective pairs of (item_table, qid, question, answer, category).

    At most one row a pair: the first of empty, refusal, copy, language, truncated. Pairs of category 5 are no cases.
    Null questions are compared with nothing; repeated rows count once; pairs that share a key but differ in text are
    judged each, and the first defect in that order stands.
    """
    # Staged, as five branches read it.
    facts = stage(_facts(pairs).withColumn("id", F.sha2(F.to_json(F.struct("item_table", "qid", "question", "answer")), 256)))
    usual = facts.filter("openings IS NOT NULL")
    odds = evidence(usual.withColumn("question_id", F.xxhash64("question")))
    # Short answers without function words: the language by the words' company over all pairs.
    words = stage(_word_rows(pairs))
    spoken = words.filter("lang <> ''").groupBy(F.lower("word").alias("w"), "lang").agg(F.sum("n").alias("n"))
    all_of = spoken.groupBy("w").agg(F.sum("n").alias("total"))
    share = spoken.join(all_of, "w").filter("total >= 3").select("w", "lang", (F.col("n") / F.col("total")).alias("share"))
    asking = usual.filter("alien = 'ask' AND content IS NOT NULL").select("id", "asked", F.explode("content").alias("w"))
    guess = asking.join(share, "w").groupBy("id", "asked", "lang").agg(F.sum("share").alias("score"))
    guess = guess.groupBy("id", "asked").agg(F.max(F.struct("score", "lang")).alias("top"), F.map_from_entries(F.collect_list(F.struct("lang", "score"))).alias("scores"))
    guess = guess.filter(
        F.col("asked").isNotNull() & (F.col("top.lang") != F.col("asked")) & (F.col("top.score") >= 1.6) & (F.coalesce(F.try_element_at("scores", F.col("asked")), F.lit(0.0)) * 4 < F.col("top.score"))
    )
    guess = guess.select("id", F.lit(True).alias("other"))
    # Last words that are no words elsewhere but begin one, in answers that are not given again and again.
    known = words.groupBy("word").agg(F.sum("n").alias("n"))
    ends = usual.filter("tail = 'ask' AND last IS NOT NULL")
    asked = ends.select("last").distinct().join(known.select(F.col("word").alias("last")), "last", "left_anti")
    # Only the lengths that are asked for: one row with a number for each different length.
    lengths = asked.agg(F.collect_set(F.length("last")).alias("lengths"))
    begins = known.filter("n >= 2").join(F.broadcast(lengths)).select(F.explode(F.transform(F.filter("lengths", lambda i: (i > 0) & (i < F.length("word"))), lambda i: F.substring("word", F.lit(1), i))).alias("last")).distinct()
    lasts = asked.join(begins, "last", "left_semi")
    # A short phrase that is given again and again is whole, unless the same answer goes on inside its last word far more
    # often; both counts grow with the data. A longer answer may be cut at the same place again and again.
    bare = F.split(F.regexp_replace("answer", rf"[{UNICODE_SPACE}]*(?:\.{{3,}}|…+)?[{UNICODE_SPACE}]*$", ""), rf"[{UNICODE_SPACE}]+")
    given = usual.groupBy(bare.alias("words")).agg(F.countDistinct("question").alias("times"))
    maybe = ends.join(lasts, "last", "left_semi").select("id", bare.alias("words"))
    phrase = maybe.select("words").distinct().join(given.filter((F.size("words") <= PHRASE) & (F.col("times") >= RECURRING)), "words")
    phrase = phrase.select("words", "times", F.slice("words", 1, F.size("words") - 1).alias("head"), F.element_at("words", -1).alias("stem"))
    heads = given.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("words"), F.lit(PHRASE))), lambda i: F.struct(F.slice("words", F.lit(1), i - 1).alias("head"), F.get("words", i - 1).alias("word")))).alias("h"), "times")
    heads = heads.groupBy("h.head", "h.word").agg(F.sum("times").alias("longer"))
    inside = F.col("word").startswith(F.col("stem")) & F.substr("word", F.length("stem") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    goes_on = phrase.join(heads, "head").filter(inside).groupBy("words").agg(F.sum("longer").alias("longer"))
    whole = phrase.join(goes_on, "words", "left").filter(F.coalesce("longer", F.lit(0)) < GOES_ON * F.col("times")).select("words")
    cut = maybe.join(whole, "words", "left_anti").select("id", F.lit(True).alias("cut"))
    joined = facts.join(odds, "id", "left").join(guess, "id", "left").join(cut, "id", "left")
    rank = (
        F.when(F.col("state") == "empty", 0)
        .when(F.coalesce("odds", F.lit(0.0)) + F.when(F.col("apology"), OWN).when(F.col("declined"), 0.0).otherwise(-OWN) > 0, 1)
        .when(F.col("state") == "copy", 2)
        .when((F.col("alien") == "yes") | F.col("other"), 3)
        .when((F.col("tail") == "broken") | F.col("cut"), 4)
    )
    names = F.array(*map(F.lit, ("empty", "refusal", "copy", "language", "truncated")))
    first = joined.select("item_table", "qid", rank.alias("r")).filter("r IS NOT NULL").groupBy("item_table", "qid").agg(F.min("r").alias("r"))
    return first.select("item_table", "qid", F.element_at(names, F.col("r") + 1).alias("defect"))


def found(requesta: DataFrame, locomo: DataFrame) -> DataFrame:
    """The defective pairs of both tables."""
    return defects(_pairs(requesta, "requesta_items", F.lit(0)).unionByName(_pairs(locomo, "locomo_questions", F.coalesce("category", F.lit(0)))))
