import itertools
import random

from sedimenta.llm import pii

GIVEN = ["Grace", "Mark", "Hugo", "Ivy", "Grant", "Rose", "Jürgen", "Nora"]


def test_shapes():
    # Without any counts the shapes decide.
    found = lambda t: [(k, a, b, t[a:b], v) for k, a, b, v, _ in pii.candidates(t)[0]]
    say = lambda t: [(k, t[a:b]) for k, a, b in sorted(pii.document_spans([], sorted(found(t), key=lambda c: c[1:3]), frozenset()), key=lambda x: x[1])]
    assert say("write to <a.b+c@x-y.example>, or a_b [at] mail[.]x dot test") == [("email", "a.b+c@x-y.example"), ("email", "a_b [at] mail[.]x dot test")]
    assert say("mailto:A.B@X.TEST and h.h at post . x . example") == [("email", "A.B@X.TEST"), ("email", "h.h at post . x . example")]
    assert say("The decorator @retry hides it. Meet at noon. Write to the channel (at) the desk.") == []
    assert [k for k, _ in say("call +44 (0)1632 960-491 or 01632 960 191, (0034) 910 00 58 86, 030/12345678, 600-000-463, 1 894 5550141")] == ["phone"] * 6
    assert [k for k, _ in say("SSN 000-95-7103; national ID QQ 12 34 56 C; passport X07650189; Steuer-ID 00 542 476 964; DNI 00.007.242-M; NIE X-0000825-T")] == ["id_number"] * 6
    assert say("ISBN 000-0-00-555012-3. Ticket 900123456 is a copy of 900123457. Version 10.4.2.118 of 2025-03-14. Lot 33-199-00. Order 030-7.") == []
    assert [t for k, t in say("to 47 larkmoor st, Krebsgrundweg 52a, 99086 Neuhalden, 12 bis, rue des Orvanches, Calle San Ilvario 62, C/ Mirambela, 77")] == ["47 larkmoor st", "Krebsgrundweg 52a", "12 bis, rue des Orvanches", "Calle San Ilvario 62", "C/ Mirambela, 77"]
    assert say("Contact: Ann (279.555.0174) or ((373) 555-0103), Bob (+1-718-555-0113)") == [("phone", "279.555.0174"), ("phone", "(373) 555-0103"), ("phone", "+1-718-555-0113")]
    assert say("reach Jo Lostorade at will.dris [ät] mail . olmenta . test or by phone") == [("email", "will.dris [ät] mail . olmenta . test")]
    assert say("Street lighting comes from layer 7. Voir la section 12, allée centrale du plan. Abschnitt 14a Straße und Verkehr.") == []
    assert pii.candidates("") == ([], [], "") and say("x" * 100_000) == []


def test_message_passing_is_exact_on_chains():
    rng = random.Random(2)
    for _ in range(30):
        n, width = rng.randrange(1, 6), 3
        unary = [[rng.random() * 4 for _ in range(width)] for _ in range(n)]
        step = [[rng.random() * 4 - 2 for _ in range(width)] for _ in range(width)]
        score = lambda x: sum(u[i] for u, i in zip(unary, x)) + sum(step[a][b] for a, b in zip(x, x[1:]))
        best = max(itertools.product(range(width), repeat=n), key=score)
        assert tuple(pii.best_labels(unary, [(i, i + 1, step) for i in range(n - 1)])) == best


def texts():
    surnames = ["Ulverby", "Quenstmann", "Morwenvar", "Skarnill", "Haldois"]
    rows = [("t", f"n{i}", f"I spoke with {g} {s} about the pump.") for i, (g, s) in enumerate(itertools.product(GIVEN, surnames))]
    rows += [("t", f"z{i}", f"Ask Zebedee {s} about the pump.") for i, s in enumerate(surnames)]
    rows += [("t", f"b{i}", "Grant Access and Mark Complete are two buttons. Every access is complete.") for i in range(20)]
    rows += [
        ("t", "rev", "The list has Ulverby, Grace and others"), ("t", "ini", "G. Ulverby wrote it"), ("t", "van", "My name is Rose van Haldois."), ("t", "lone", "Grace and the server"), ("t", "caps", "Ask HUGO SKARNILL now"),
        ("t", "mail", "write grace.ulverby@x.example"), ("t", "null", None), ("t", "blank", " "), ("t", "caps", "Ask HUGO SKARNILL now"), (None, None, "Dr. Nora Quenstmann"), ("t", "done", "[NAME] called"),
    ]
    return rows


def test_names(spark):
    frame = spark.createDataFrame([(*r, "clash") for r in texts()], "src_table string, record_id string, text string, pii_type string")
    names = spark.createDataFrame([("en", g) for g in GIVEN] + [("en", None)], "lang string, given_name string")
    got = {}
    for r in pii.mentions(frame, names).collect():
        got.setdefault((r.src_table, r.record_id), []).append((r.pii_type, r.start_char))
    for s, i, t in texts():
        if i and i[0] in "nz" and i[1:].isdigit():
            assert got.get((s, i)) == [("name", 13 if i[0] == "n" else 4)], t
    assert got["t", "rev"] == [("name", 13)] and got["t", "ini"] == [("name", 0)] and got["t", "van"] == [("name", 11)] and got["t", "caps"] == [("name", 4)]
    assert got["t", "mail"] == [("email", 6)] and got[None, None] == [("name", 4)]
    assert not any(k in got for k in [("t", "lone"), ("t", "null"), ("t", "blank"), ("t", "done"), *(("t", f"b{i}") for i in range(20))])
    clean = {r.record_id: r.text for r in pii.redacted(frame, names).collect()}
    assert clean["van"] == "My name is [NAME]." and clean["mail"] == "write [EMAIL]" and clean["blank"] == " " and "null" not in clean
    assert pii.mentions(frame.limit(0), names.limit(0)).count() == 0


def test_every_spelt_at_is_looked_at():
    for at in ("@", " (at) ", " [ät] ", " {at} ", " < at > ", " (arroba) ", " (arobase) "):
        text = f"nom{at}exemple (point) fr"
        assert [text[a:b] for a, b, v in pii.email_candidates(text) if v > 0] == [text], at


def test_fields_of_mixed_widths_are_exact_on_trees():
    rng = random.Random(5)
    for _ in range(20):
        widths = [rng.randrange(2, 5) for _ in range(5)]
        unary = [[rng.random() * 4 for _ in range(w)] for w in widths]
        edges = [(rng.randrange(i), i) for i in range(1, 5)]
        table = [(i, j, [[rng.random() * 4 - 2 for _ in range(widths[j])] for _ in range(widths[i])]) for i, j in edges]
        score = lambda x: sum(u[i] for u, i in zip(unary, x)) + sum(p[x[i]][x[j]] for i, j, p in table)
        best = max(itertools.product(*map(range, widths)), key=score)
        got = pii.best_labels(unary, sorted(table, key=lambda e: e[:2]), 6)
        assert abs(score(got) - score(best)) < 1e-9


def test_words_around_decide_what_shapes_leave_open(spark):
    rows = [("t", f"p{i}", f"Please call Ann on +44 1632 96{i:04}.") for i in range(12)] + [("t", f"d{i}", f"The spare pump has item code {i}{i}7{i}.") for i in range(12)]
    rows += [("t", "phone", "Please call Bob on 01632960123."), ("t", "code", "The pump has item code 01632960124."), ("t", "again", "The pump has item code 01632960125. Please call Eve on 01632960125 at once.")]
    got = {(r.record_id, r.start_char) for r in pii.mentions(spark.createDataFrame(rows, "src_table string, record_id string, text string"), spark.createDataFrame([], "lang string, given_name string")).filter("pii_type = 'phone'").collect()}
    assert ("phone", 19) in got and not any(r == "code" for r, _ in got) and ("again", 55) in got


def test_similar_words():
    assert pii.similar("ulverby", "ulverby") and pii.similar("ulverby", "ulvreby") is False and pii.similar("ulverby", "ulvery") and pii.similar("ulvery", "ulverby") and pii.similar("ulverby", "ulverbi")
    assert not pii.similar("mark", "marc") and not pii.similar("quenst", "quensts1")
