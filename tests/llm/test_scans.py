import itertools
import random

from sedimenta.llm import scans as p3

BOX = lambda y: [70.0, float(y), 530.0, y + 20.0]
SCHEMA = "doc_id string, seq int, page int, text string, bbox array<double>, block_type string, media binary, media_name string, furniture boolean, noise string"
WORDS = "the machine was moved before winter and every report describes a small problem with the section of the register".split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_gives_every_word_in_reach():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abce") for _ in range(rng.randrange(2, 7))) for _ in range(300)})
    trie = p3.Trie([(w, 9) for w in words])
    for q in ("abca", "cc", "bbbbb", "eacab"):
        near = trie.near(q, 2, True)
        assert {w for w in words if edits(q, w) <= 2} <= set(near)
        assert all(edits(q, w) <= 4 for w in near)
    only = p3.Trie([("modern", 9), ("modem", 9), ("clad", 9), ("while", 9)])
    assert set(only.near("modem", 1, False)) == {"modem", "modern"} and "while" in only.near("wliile", 1, False) and only.near("wbile", 1, False) == {}


def test_lines():
    assert all(map(p3.is_page_number, ("12", "- 7 -", "p. 4", "[118]", "xii", "3/14", "l46/146", "Seite 9", "p. S")))
    assert not any(map(p3.is_page_number, ("", "NOTE", "s.", "ms.", "12 valves", "The end", "kPa.")))
    assert p3.fold("The modcrn Handb0ok | [12]") == p3.fold("THE MODERN HANDBOOK")
    assert p3.break_at("it is a pro-", "cedure for all") == ("pro", "cedure") and p3.break_at("the pre-", "and post") is None and p3.break_at("they cannot –", "delete") is None and p3.break_at("NFR-", "4719 of it") is None


def scanned():
    rows, seq = [], itertools.count(1)
    say = lambda p, text, y, kind="paragraph", f=False: rows.append(("d", next(seq), p, text, BOX(y), kind, None, None, f, "clash"))
    body = " ".join(WORDS)
    say(1, "Old Handbook", 90, "heading")
    for p in range(1, 5):
        if p > 1:
            say(p, "Old Handbook" if p != 3 else "Old Handb0ok", 20, f=p == 2)
        for k in range(6):
            say(p, body.replace(" every", "\nevery") + ".", 130 + 80 * k)
        if p == 1:
            say(p, "the rnachine was moved bef0re winter and every sec-\ntion of a pro-", 610)
        if p == 2:
            rows[-6] = (*rows[-6][:3], "blem was moved. The reg1ster, the pre-\nand the thc section", *rows[-6][4:])
        say(p, "2 every rnachine", 700)
        say(p, f"- {p} -", 760)
    rows.append(rows[5])
    rows += [(None, 1, 1, "x", None, None, None, None, None, None), ("e", 1, None, None, None, "paragraph", None, None, None, None), ("e", 2, None, "the machine", None, "paragraph", None, None, None, None)]
    return rows


def test_noises(spark):
    frame = spark.createDataFrame(scanned(), SCHEMA)
    got = {tuple(r) for r in p3.found(frame).collect()}
    kinds = {}
    for _, _, noise, repaired in got:
        kinds.setdefault(noise, []).append(repaired)
    assert len(kinds["running_head"]) == 3 and len(kinds["page_number"]) == 4
    assert sorted(kinds["hyphen_break"]) == ["problem", "section"]
    assert sorted(kinds["misread"]) == ["before", "machine", "register", "the"]
    text = "\n".join(r.text for r in p3.paragraphs(frame).collect() if r.doc_id == "d")
    assert "the machine was moved before winter and every section of a problem was moved. The register, the pre- and the the section" in text
    assert "Handb" not in text and "- 1 -" not in text
    assert p3.found(frame.limit(0)).count() == 0 and p3.paragraphs(frame.limit(0)).count() == 0


def test_borders_of_buckets_leave_no_trace(spark, monkeypatch):
    rows, seq = [], itertools.count(1)
    say = lambda p, text, y=130, kind="paragraph": rows.append(("d", next(seq), p, text, BOX(y), kind, None, None, False, None))
    body = " ".join(WORDS)
    for p in range(14):
        if p in (4, 5, 6):
            say(p, f"- {p} -", 760)  # no body text on the pages behind a break
            continue
        say(p, ("blem was moved. " if p == 7 else "gister " if p == 8 else "") + body + (" and the pro-" if p == 3 else " and a re-" if p == 7 else " and then" if p == 11 else "."))
    rows[-2] = (*rows[-2][:3], body + " of it", *rows[-2][4:])
    frame = spark.createDataFrame(rows, SCHEMA)
    results = []
    for pages in (4, 1000):
        monkeypatch.setattr(p3, "PAGES", pages)
        noise = sorted(tuple(r) for r in p3.found(frame).collect())
        results.append((noise, [r.text for r in p3.paragraphs(frame).orderBy("first_seq").collect()]))
    assert results[0] == results[1]
    assert [r[3] for r in results[0][0] if r[2] == "hyphen_break"] == ["problem", "register"]
    text = " ".join(results[0][1])
    assert "and the problem was moved. the machine" in text and "and a register the machine" in text and len(results[0][1]) < 9


def test_text_at_the_foot_is_kept(spark):
    """Body text low on a page, an open short line at its end and a note are no furniture."""
    rows, seq = [], itertools.count(1)
    body = " ".join(WORDS) + "."
    for p in range(1, 4):
        for text, y in (("Old Handbook", 20), (body, 130), ("Every section describes the register", 700), ("7 A note on the machine.", 720), ("and a short end", 745), (f"{p}", 760)):
            if text[0] != "7" or p == 2:
                rows.append(("d", next(seq), p, text, BOX(y), "paragraph", None, None, False, None))
    rows[-7] = (*rows[-7][:3], "7 A note on the machine.", BOX(750), *rows[-7][5:])
    got = p3.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    text = "\n".join(r.text for r in got)
    assert text.count("Every section describes the register") == 3 and text.count("and a short end") >= 2 and "7 A note on the machine." in text
    assert "Old Handbook" not in text and not any(r.text.strip().isdigit() for r in got)


def test_roman_numbers_are_strict():
    assert p3.fold("Dic Kalibrierung") == p3.fold("Die Kalibrierung") and p3.fold("xiv Die Kalibrierung") == p3.fold("Die Kalibrierung") and p3.fold("Pclantlon Report") == p3.fold("Pelantlon Report")


def test_every_word_is_looked_up(spark):
    """Unlisted edits in words of letters, words of two letters, rare right words and notes are repaired; real words stay."""
    rows, seq = [], itertools.count(1)
    say = lambda p, text, y=130: rows.append(("d", next(seq), p, text, BOX(y), "paragraph", None, None, False, None))
    body = " ".join(WORDS)
    for p in range(1, 13):
        say(p, f"{body}. The sample is cold.")
        if p < 3:
            say(p, "So the simple plan works.")
    say(13, body.replace("machine", "mochine").replace("winter", "wimter") + ". The sample ls cold.")
    say(14, "Nobody saw the gasket.")
    say(14, "They took the ga5ket.")
    say(14, "7 The mach1ne was mo-\nved before wintcr.", 900)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.seq, r.noise, r.repaired) for r in p3.found(frame).collect()) == [(15, "misread", "is"), (15, "misread", "machine"), (15, "misread", "winter"), (17, "misread", "gasket")]
    text = "\n".join(r.text for r in p3.paragraphs(frame).collect())
    assert "7 The machine was moved before winter." in text and "The sample is cold" in text and "simple plan" in text
    long = "x" * 45 + "c"
    assert [c for c, *_ in p3.offers(long, 1, p3.Trie([("x" * 45 + "e", 9)]), True)] == ["x" * 45 + "e"]
