import random

from sedimenta.llm import pairs as p4

SCHEMA = "item_table string, qid string, question string, answer string, category int"


def test_direct_checks():
    assert all(map(p4.is_empty, (None, "", " \n", "—", "?", "...", "N/A", "null", "<empty>", "[no answer]", "TBD", "​")))
    assert not any(map(p4.is_empty, ("No.", "Nein.", "2022", "None of the modules.", "x")))
    q = "What did Ann buy?"
    assert all(p4.is_copy(q, a) for a in (q, q.upper(), "  What  did Ann buy\n", "Q: " + q, f"{q} {q}", '"What did Ann buy"?'))
    assert not any(p4.is_copy(q, a) for a in (None, "", q + " A boat.", "Ann", "What did Bob buy?"))
    assert not p4.is_copy(None, "x") and not p4.is_copy("?", "?")


def test_leads_and_ends():
    assert all(map(p4.apologises, ("I'm sorry, but I cannot help with that.", "Leider darf ich darüber nicht sprechen.", "Désolée, je préfère m'abstenir sur ce point.", "Lo siento, no puedo ayudar con eso.")))
    assert not any(map(p4.apologises, ("It cannot be changed by the operator.", 'The service answers: "I\'m sorry, I cannot help."', "Sorry screens are shown until it is back.", "Das Gerät lehnt ab und meldet: „Leider nicht möglich“.")))
    # The words after a lead are openings, too, so that templates meet with and without it.
    assert set(p4.openings("I cannot answer this question.")) & set(p4.openings("Sorry, but I cannot answer this question."))
    assert p4.openings("") == [""] and p4.openings("Paris") == ["paris"]
    for a in ("It was tested with", "We moved it to the «", "For this reason the pump of (see", "It closed in March and…", "We kept the UC-", "Das Gerät lehnt die", "en moins de la"):
        assert p4.ending(a)[0] == "broken", a
    for a in ("It was tested.", "at the harbour", "with the same priority as before", "in 812 s", "2022", "a «b» c."):
        assert p4.ending(a)[0] != "broken", a


def test_languages():
    assert p4.question_language("¿Qué compró Ann?") == "es" and p4.question_language("Where does it keep the pump?") == "en"
    assert p4.foreign("What happens if the pump fails?", "Il modulo registra ogni misura prima della revisione.") == "yes"
    assert p4.foreign("What happens if the pump fails?", "The label reads « la passerelle de la maison ».") == "no"
    assert p4.foreign("Where is it?", "Ardantcore") == "no"


def pairs():
    rows = [("t", f"c{i}", f"What happens if the {w} fails?", f"If the {w} fails, the {v} stores the {w} at once.", 0) for i, (w, v) in enumerate((a, b) for a in ("pump", "valve", "lamp", "sensor") for b in ("server", "module", "register"))]
    rows += [("t", f"l{i}", f"Was passiert, wenn der {w} ausfällt?", f"Der {w} wird nicht ersetzt, und die Anzeige ist aus.", 0) for i, w in enumerate(("Sensor", "Motor", "Server", "Regler"))]
    rows += [
        ("t", "empty", "What is it?", None, 1), ("t", "five", "What is it?", None, 5), ("t", "refusal", "What is the pump for?", "Sorry, I cannot answer this question.", 2),
        ("t", "copy", "What is the lamp for?", "what is the lamp for", 2), ("t", "language", "What is the lamp for?", "Der Motor wird nicht ersetzt, und die Anzeige ist aus.", 2),
        ("t", "cut", "What is the lamp for?", "If the pump fails, the server stores the regis", 2), ("t", "open", "What is the lamp for?", "The lamp is part of the", 2), ("t", "short", "When?", "two weeks before", 2),
        ("t", "empty", "What is it?", None, 1), ("u", None, None, "fine", 1), ("u", "long", "What is the lamp for?", "The lamp is on. " * 20_000, 1),
    ]
    return rows


def test_defects(spark):
    got = {(r.item_table, r.qid): r.defect for r in p4.defects(spark.createDataFrame(pairs(), SCHEMA)).collect()}
    assert got == {("t", "empty"): "empty", ("t", "refusal"): "refusal", ("t", "copy"): "copy", ("t", "language"): "language", ("t", "cut"): "truncated", ("t", "open"): "truncated", ("t", "short"): "truncated"}
    assert p4.defects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_join_similar_openings(spark):
    base = "i would rather leave this one unanswered, let me know if you have another # about it"
    rows = [(base, 1, "a", True), (base, 2, "b", False), (base.replace("another #", "another one #"), 3, "b", False), ("something else altogether, about pumps", 1, "a", False)]
    got = {r.opening: (r.prompts, r.cued, r.unrelated) for r in p4.templates(spark.createDataFrame(rows, "opening string, question_id long, family string, cued boolean")).collect()}
    assert got[rows[0][0]] == got[rows[2][0]] == (3, 1, 2) and got[rows[3][0]] == (1, 0, 1)


def test_bands_find_what_brute_force_finds(spark):
    """Recall of the verified clusters against all pairs of similar openings."""
    rng = random.Random(7)
    words = "the pump lamp valve cannot share details about this one with you here now please ask again later".split()
    texts = set()
    for _ in range(60):
        base = [rng.choice(words) for _ in range(8)]
        texts |= {" ".join(base), " ".join([*base[:-1], rng.choice(words)]), " ".join([*base, rng.choice(words)])}
    texts = sorted(texts)
    grams = {t: p4.shingles(t) for t in texts}
    true = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if p4.jaccard(grams[a], grams[b]) >= p4.SIMILAR}
    met = {}
    for r in p4._band_rows(spark.createDataFrame([(t,) for t in texts], "opening string")).collect():
        met.setdefault(r.bucket, []).append(r.opening)
    pairs_met = {tuple(sorted((a, b))) for group in met.values() for i, a in enumerate(group) for b in group[i + 1 :]}
    assert len(true) > 50 and len(true & pairs_met) >= 0.9 * len(true)


def test_company_decides(spark):
    asked = ("Where does Calygate keep the pump?", "What happens if the lamp fails?", "How long may the backup take?", "Why was the register moved?", "Which component reads the meter?", "According to the plan, who signs?")
    core = "that matter is one for the other desk of this house"
    rows = [("t", f"a{i}", q, f"Sorry, {core}.", 0) for i, q in enumerate(asked[:4])]
    # No list holds this wording: the apologies of its company tell.
    rows += [("t", f"b{i}", q, f"{core.capitalize()}.", 0) for i, q in enumerate(asked[4:])]
    # An apology in a template of plain facts is none.
    rows += [("t", f"c{i}", q, f"Unfortunately the pump of line {i} is out of order.", 0) for i, q in enumerate(asked)]
    rows += [("t", f"d{i}", q + " Tell me.", f"The pump of line {i} is out of order.", 0) for i, q in enumerate(asked)]
    got = {r.qid for r in p4.defects(spark.createDataFrame(rows, SCHEMA)).filter("defect = 'refusal'").collect()}
    assert {f"a{i}" for i in range(4)} | {"b0", "b1"} <= got and not any(q.startswith("d") for q in got)


def test_uncued_templates_are_refusals_by_their_reach(spark):
    # No word of the first sentences is a cue, so only reach across unrelated questions and the declining check can tell.
    asked = ("Where does Calygate keep the pump?", "What happens if the lamp fails?", "How long may the backup take?", "Why was the register moved?")
    said = ("This question must not be answered here.", "Dazu darf an dieser Stelle nichts gesagt werden.", "That is a delicate matter. I cannot help with it.")
    rows = [("t", f"r{k}-{i}", q, a, 0) for k, a in enumerate(said) for i, q in enumerate(asked)]
    rows += [("t", f"n{i}", q, "It cannot be changed by the operator.", 0) for i, q in enumerate(asked)]
    rows += [("t", "once", asked[0], "No answer to it can be given by the valve.", 0), ("t", "named1", "What did Ann buy?", "No help was offered in the shop.", 0), ("t", "named2", "What did Bob buy?", "No help was offered in the shop.", 0), ("t", "named3", "What did Eve buy?", "No help was offered in the shop.", 0)]
    assert not any(p4.apologises(a) for _, _, _, a, _ in rows)
    got = {r.qid for r in p4.defects(spark.createDataFrame(rows, SCHEMA)).filter("defect = 'refusal'").collect()}
    assert got == {f"r{k}-{i}" for k in range(3) for i in range(4)}


def test_short_answers_cut_again_and_again(spark):
    rows = [("t", f"w{i}", f"What did Ann buy on day {i}?", "a telescope with a wooden tripod", 1) for i in range(24)]
    rows += [("t", f"c{i}", f"What did Bob buy on day {i}?", "a telescope with a wooden tr", 1) for i in range(4)]
    rows += [("t", f"d{i}", f"What did Eve buy on day {i}?", "a telescope with a wooden tripo...", 1) for i in range(4)]
    rows += [("t", f"k{i}", f"Where is the tripod of Ada on day {i}?", "The tripod is in the hall.", 1) for i in range(2)]
    # A whole phrase that a few others go on from stays whole.
    rows += [("t", f"p{i}", f"Where was Ann on day {i}?", "at the lakeside bar", 1) for i in range(6)]
    rows += [("t", f"q{i}", f"Where was Bob on day {i}?", "at the lakeside barn with a friend", 1) for i in range(6)]
    got = {r.qid for r in p4.defects(spark.createDataFrame(rows, SCHEMA)).filter("defect = 'truncated'").collect()}
    assert got == {f"{k}{i}" for k in "cd" for i in range(4)}
