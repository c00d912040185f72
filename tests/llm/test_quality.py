import numpy as np
import pytest

from sedimenta.llm import quality as p8

WORDS = [("en", w) for w in "the of and to a in is that it for was on with as be by at this have from or not are".split()] + [("de", w) for w in "der die das und ist nicht wird ein eine mit".split()]
PROSE = "The valve is part of the pump and it was tested with care. It is not possible to change the unit at this point, as the system was moved to the lab."


@pytest.fixture(scope="module")
def classes():
    common = {}
    for lang, w in WORDS:
        common[w] = common.get(w, 0) | (1 << (lang == "en"))
    return p8.WordClasses(common)


def test_kinds(classes):
    fitted = p8.fit([], classes)
    kind = lambda t: p8.kinds_of([t], classes, fitted)[0]
    assert kind(PROSE) == "prose"
    assert kind("\n".join(f"{i}. {s}." for i, s in enumerate(PROSE.rstrip(".").split(". "), 1))) == "prose"
    assert kind("The valve is part of the pump and it was\ntested with care in this lab, as the unit\nwas moved to it.") == "prose"
    assert kind("- valve\n- pump\n- the red unit\n- lab\n- system") == "list"
    assert kind("1.1 The valve ........ 3\n1.2 The pump ....... 5\n2 Lab .... 9") == "list"
    assert kind("a | 3.5 | kPa\nb | 4.5 | kPa\nc | 6.5 | MB") == "table"
    assert kind("REQ-1,valve,3.2\nREQ-2,,4.1\nREQ-3,pump,9.9") == "table"
    assert kind("41.1 22.3 9.0\n13.2 55.1 7.7\n1.0 2.0 3.0") == "table"
    assert kind(f"{PROSE}\na\tb\n") == "prose"
    for junk in (None, "", " \n", "x", "404", "?????", "=====\n-----\n#####", "Click here\n" * 9, "rnvkfakn wtzfwicrggl srpliwl hluqcrmw olfhesj twvy yacgrc msbms cpyqjdk ddvan jkjgq duepg lek zozn", "dd76d927 be681754 9b669c9a d1f392bc c13b8d89", '<div class="a"><span>&nbsp;</span></div>' * 5, "·43{)t82~*a,7s5d!\"*17.\\es4\\i·; \"02=8b8□*'}*0{'(900(e,!~l2a}"):
        assert kind(junk) == "junk", junk


def test_divergence():
    a, b = np.zeros((1, p8.WIDTH)), np.zeros((2, p8.WIDTH))
    a[0, 0] = b[0, 1] = b[1, 0] = 1.0
    # One part is opposed (one bit times its weight), the others are alike.
    assert p8.distances(a, b).tolist() == [[1.0, 0.0]]


def test_profiles_carry_the_result(classes):
    """Without the divergences nothing is left: every text falls to one profile."""
    texts = [PROSE, "- valve\n- pump\n- lamp\n- lab", "a | 3.5 | kPa\nb | 4.5 | kPa\nc | 6.5 | MB"]
    profiles = p8.fit(texts * 5, classes)
    assert p8.kinds_of(texts, classes, profiles) == ["prose", "list", "table"]
    flat = p8.Profiles(profiles.keys, np.zeros_like(profiles.matrix))
    assert len(set(p8.kinds_of(texts, classes, flat))) == 1


def test_any_number_of_languages(spark):
    words = spark.createDataFrame([(f"l{i:02}", w) for i in range(12) for w in (f"der{i}", "und")], "lang string, word string")
    common = p8.common_words(words)
    assert len(common) == 13 and common["der11"] == 1 << 11 and common["und"] == (1 << 12) - 1


def test_tables_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "- pump\n- valve\n- the lamp", None), (4, "word " * 200_000, "y"), (3, "- pump\n- valve\n- the lamp", None)], "doc_id long, text string, kind string")
    words = spark.createDataFrame([*WORDS, (None, "x"), ("en", None)], "lang string, word string")
    got = {(r.doc_id, r.kind) for r in p8.found(docs, words).collect()}
    assert (2, "junk") in got and (3, "list") in got and (4, "junk") in got and 1 not in {i for i, _ in got}
    assert p8.found(docs.limit(0), words).count() == 0
    rows = {r.doc_id: r for r in p8.stats(docs, words).collect()}
    assert rows[1].n_words == len(PROSE.split()) and rows[1].ended_lines == 1.0 and rows[2].n_words == 0 and rows[2].common_share == 0.0
    assert p8.stats(docs, words.limit(0)).filter("doc_id = 1").first().common_share == 0.0


def test_dashes_in_lists_are_no_damage(classes):
    text = "\n".join(f"Product{c} – SRS-{i}40" for i, c in enumerate("abcdefgh"))
    assert p8.kinds_of([text], classes, p8.fit([text] * 9, classes)) == ["list"]


def test_profiles_come_from_all_texts(spark, monkeypatch):
    """Large tables are fitted on every different text, as fit() does, whatever repeats or is null."""
    rng = np.random.default_rng(3)
    words = [w for _, w in WORDS] + ["pump", "lamp", "SRS-440", "3.5", "Valve"]
    texts = [" ".join(rng.choice(words, rng.integers(2, 30))) + "." * int(i % 3 == 0) for i in range(9_000)]
    seen, made = [], p8.profiles_of
    monkeypatch.setattr(p8, "profiles_of", lambda *a: seen.append(made(*a)) or seen[-1])
    rows = [*enumerate(texts), *enumerate(texts[:500], 20_000), (30_000, None)]
    table = spark.createDataFrame(WORDS, "lang string, word string")
    p8.kinds(spark.createDataFrame(rows, "doc_id long, text string"), table).count()
    got = seen[-1]
    want = p8.fit(sorted(set(texts)), p8.WordClasses(p8.common_words(table)))
    assert got.keys == want.keys and np.allclose(got.matrix, want.matrix, rtol=0, atol=1e-9)
