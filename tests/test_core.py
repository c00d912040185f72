import io
import json
import random
import zipfile

import pytest

from sedimenta.frames import bucketed_prefix, fold_streams
from sedimenta.functions import text as T
from sedimenta.operators import answers, chain, history, relational, retrieval, structure
from sedimenta.sources import corpora, office, sinks
from sedimenta.streaming import limits
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.n_tokens(lit("a b  c\n"))) == 3 and one(spark, T.normalized(lit(" Groß \t B "))) == "gross b"
    assert one(spark, T.terms(lit("The F-16, v1.2 & x_y"))) == ["the", "f-16", "v1.2", "x_y"]
    assert [one(spark, T.language_label(lit(t))) for t in ("hello there", "été là-bas", "한국어입니다", "これは日本語", "漢字漢字漢字", "ภาษาไทย", "12")] == ["en", "vi", "ko", "ja", "zh", "th", None]
    assert one(spark, T.clause_label(lit(" 1.2.3. Scope"))) == "1.2.3" and one(spark, T.clause_label(lit("1 Scope"))) is None
    assert one(spark, T.clean_answer(lit("Yes [cite:1][cite:2].<!--used:s1,s2-->"))) == "Yes ."
    assert one(spark, T.cited(lit("a[cite:2]b[cite:1]c[cite:2]"))) == [2, 1] and one(spark, T.used_ids(lit("x<!--used:s3, s7,q-->"))) == ["s3", "s7"]
    assert [one(spark, T.memory_key(lit(k))) for k in ("Profession", "other:team", "My Hobby!", "--")] == ["occupation", "other:team", "other:my-hobby", ""]
    assert one(spark, T.title_from(lit("a " * 40))).endswith("…") and one(spark, T.title_from(lit(" \n"))) == "New chat"
    assert one(spark, T.replace_value(lit("at 5 \n kPa now"), "5 kPa", "6 kPa")) == "at 6 kPa now"
    assert one(spark, T.label_of(lit('so {"label": "Good"}'), ["good", "bad"])) == "good" and one(spark, T.label_of(lit("it is bad"), ["good", "bad"])) == "bad" and one(spark, T.label_of(lit("good or bad"), ["good", "bad"])) is None
    assert one(spark, T.route_kind(lit("a/b.DOCX"))) == "docx" and one(spark, T.route_kind(lit("x.exe"))) is None
    assert one(spark, T.context_percent(lit(5), lit(200))) == 2 and one(spark, T.content_id("doc_", lit("a"), lit("b"))).startswith("doc_")
    assert one(spark, corpora.strip_turn_markers(lit("|user|: a\n\n|agent|: b"))) == "a\nb"


def test_answers(spark):
    s = spark.createDataFrame([("a b c d", "c d"), ("x", "y"), ("same thing", "same thing"), ("", "x")], "p string, r string")
    got = [tuple(r) for r in s.select(answers.f1(F.col("p"), F.col("r")), answers.bleu1(F.col("p"), F.col("r"))).collect()]
    assert got[0][0] == pytest.approx(0.8) and got[1][0] == 0 and got[2] == (1.0, 1.0) and got[3] == (0.0, 0.0)  # the article goes
    half = spark.createDataFrame([("one two", "one two three four")], "p string, r string").select(answers.bleu1(F.col("p"), F.col("r"))).first()[0]
    assert half == pytest.approx(0.367879, abs=1e-6)
    cat = spark.createDataFrame([("red, blue", "blue, green", 1), ("paris", "paris; maybe", 3), ("x", "x", 5)], "p string, r string, c int").select(answers.category_f1(F.col("p"), F.col("r"), F.col("c"))).collect()
    assert [r[0] for r in cat] == [0.5, 1.0, None]


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, block_id string, block_order int, type string, text string, section_path array<string>, parent_block_id string, media_ref string, language string, extra int")


def test_prefix_sums_with_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 5000, 7)]), i, rng.randrange(9)) for i in range(500)]
    df = bucketed_prefix(spark.createDataFrame(rows, "k string, o int, i int, v int"), ["k"], F.floor(F.col("o") / 100), [F.col("o").asc_nulls_first(), F.col("i")], {"rank": F.lit(1).cast("long"), "sum": F.col("v")})
    got = {r.i: (r["rank"], r["sum"]) for r in df.collect()}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == [(n, sum(x[3] for x in mine[:n])) for n in range(len(mine))]


def test_markdown_anchors_point_at_the_text(spark):
    rows = [("d", f"b{i}", i * 3, kind, text, ["A"], None, "m.png" if kind == "figure" else None, "en", 0) for i, (kind, text) in enumerate([("heading", "Title"), ("paragraph", "One é two"), ("list", "item"), ("paragraph", " "), ("figure", "pic"), ("caption", "cap"), ("code", "x = 1")])]
    df = blocks(spark, rows)
    parts = [r for r in structure.markdown_parts(df).orderBy("block_order").collect()]
    text = "".join(r.prefix + r.text + r.suffix for r in parts)
    got = structure.markdown_anchors(df).collect()
    assert {r.block_id: text[r.start : r.end] for r in got} == {r[1]: r[4] for r in rows if r[3] != "heading" and r[4].strip()}


def test_windows_units_and_sections(spark):
    rows = [("d", "b0", 0, "paragraph", "w " * 300, [], None, None, "en", 0), ("d", "b1", 1, "paragraph", "w " * 300, [], None, None, "de", 0), ("e", "c0", 0, "paragraph", None, [], None, None, None, 0)]
    got = sorted((r.chunk, r.n_words, r.first_block) for r in structure.fixed_windows(blocks(spark, rows)).collect())
    assert got == [(0, 256, "b0"), (1, 256, "b0"), (2, 88, "b1")]
    clause = [("k", f"k{i}", i, "paragraph", t, [], None, None, None, 0) for i, t in enumerate(["1.1 One thing here", "more of it", "1.2 Two thing", "1.10 Ten things"])]
    heads = [("h", "h0", 0, "heading", "Title", [], None, None, None, 0), ("h", "h1", 1, "paragraph", "x", [], None, None, None, 0)]
    units = {r.doc_id: (r.unit, r.matches) for r in structure.natural_units(blocks(spark, clause + heads + rows)).collect()}
    assert units == {"k": ("clause", 3), "h": ("heading", 1), "d": ("none", 0), "e": ("none", 0)}
    assert {r.block_id: r.section for r in structure.clause_sections(blocks(spark, clause)).collect()} == {"k0": "1.1 One thing here", "k1": "1.1 One thing here", "k2": "1.2 Two thing", "k3": "1.10 Ten things"}
    for f in (structure.natural_units, structure.clause_sections, structure.markdown_anchors, structure.fixed_windows, structure.section_groups, structure.leaf_chunks, structure.chunk_tree):
        assert f(blocks(spark, [])).count() == 0


def test_leaves_and_tree(spark):
    rows = [("d", f"b{i}", i, kind, text, path, None, None, "en", 0) for i, (kind, text, path) in enumerate([("heading", "A", ["A"]), ("paragraph", "one " * 200, ["A"]), ("paragraph", "two " * 100, ["A"]), ("table", "x | y", ["A"]), ("paragraph", "tail " * 5, ["A"]), ("paragraph", "long. " * 700, ["B"]), ("paragraph", None, ["B"])])]
    leaves = structure.leaf_chunks(blocks(spark, rows)).orderBy("leaf").collect()
    assert [(r.kind, r.n_tokens) for r in leaves] == [("prose", 200), ("prose", 100), ("table", 3), ("prose", 5), ("part", 512), ("part", 188)]
    tree = structure.chunk_tree(blocks(spark, rows)).collect()
    assert sorted((r.level, r.n_children) for r in tree if r.level != "leaf") == [("document", 2), ("section", 2), ("section", 4)]
    groups = spark.createDataFrame([("a", 0, 22), ("a", 1, 22), ("b", 0, 101), ("b", 1, 101), ("b", 2, 20)], "doc string, g long, n long")
    packed = lambda most: [r.request for r in chain.packed_requests(groups, "doc", "g", "n", most).orderBy("doc", "g").collect()]
    assert packed(50) == [0, 0, 0, 1, 2] and packed(30) == [0, 1, 0, 1, 2] and packed(150) == [0, 0, 0, 1, 1]


def test_leaves_of_long_documents_know_no_border(spark):
    # The packs and the table lie over block 4,096, where runs used to end.
    rows = [(d, f"{d}{i}", i, "list", "item", ["A"], None, None, "en", 0) for d in "de" for i in range(4094)]
    rows += [("d", f"d{4094 + i}", 4094 + i, "paragraph", "word " * 60, ["A"], None, None, "en", 0) for i in range(4)]
    rows += [("e", "e4094", 4094, "table", "x | y", ["A"], None, None, "en", 0), ("e", "e4095", 4095, "table_cell", "x", ["A"], "e4094", None, "en", 0)]
    rows += [("e", "e4096", 4096, "table_row", "x | y", ["A"], "e4094", None, "en", 0), ("e", "e4097", 4097, "table_cell", "in x", ["A"], "e4095", None, "en", 0)]
    leaves = structure.leaf_chunks(blocks(spark, rows)).filter("kind <> 'list'").collect()
    assert sorted((r.kind, r.n_tokens, list(r.block_ids)) for r in leaves) == [("prose", 240, [f"d{4094 + i}" for i in range(4)]), ("table_cell", 2, ["e4097"]), ("table_row", 3, ["e4096"])]
    top = structure.chunk_tree(blocks(spark, rows)).filter("level = 'section'").collect()
    assert {r.doc_id: r.n_children for r in top} == {"d": 4095, "e": 4096}



def loop_window(rows, floor, cap, budget):
    first, middle, kept, spent = rows[0], rows[1:], [], len(rows[0][1])
    for position, text in reversed(middle):
        if len(kept) >= floor and (len(kept) >= cap or spent + len(text) > budget):
            break
        kept.append(position)
        spent += len(text)
    if not middle:
        return {first[0]}, 0
    edge = min(kept) - 1 if kept else middle[-1][0]
    return {first[0], *kept}, edge if edge > first[0] else 0


def test_history_windows_against_the_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(40):
        talk = [(p, "x" * rng.randrange(0, 60)) for p in range(1, rng.randrange(2, 15))]
        rows += [(f"m{t}-{p}", f"t{t}", "user", c or None, p, "clash") for p, c in talk]
        want[f"t{t}"] = loop_window(talk, 2, 5, 120)
    df = spark.createDataFrame(rows + rows[:7], "message_id string, thread_id string, role string, content string, position int, line string")
    got = {}
    for r in history.history_window(df, 2, 5, 120).collect():
        got.setdefault(r.thread_id, (set(), r.boundary))[0].add(r.position)
    assert got == want
    twenty = spark.createDataFrame([(f"m{p}", "t", "user", "x" * 10, p) for p in range(1, 21)], "message_id string, thread_id string, role string, content string, position int")
    kept = history.history_window(twenty, 6, 10, 10_000).collect()
    assert {r.position for r in kept} == {1, *range(11, 21)} and {r.boundary for r in kept} == {10}
    assert history.history_window(df.limit(0), 2, 5, 120).count() == history.retry_groups(df.limit(0)).count() == 0
    assert [r.tries for r in history.retry_groups(spark.createDataFrame([(str(p), "t", "user", c, p) for p, c in ((1, "a"), (3, "a"), (5, "b"), (7, "a"))], "message_id string, thread_id string, role string, content string, position int")).collect()] == [2]


def test_summary_items():
    items = history.parse_items("[s1|u:2|f:1] one\n[s2|u:0|f:3] two")
    assert history.parse_items(history.render_items(items)) == items and history.parse_items("plain words")[0]["id"] == "s1" and history.parse_items(None) == []
    book = history.Ledger(items)
    assert book.fold([{"op": "ADD", "text": " ONE "}, {"op": "ADD", "text": "three"}, {"op": "DROP", "id": "s9"}, {"op": "UPDATE", "id": "s2", "text": "2"}], 2) == 1
    assert [(i["id"], i["used"], i["folds"]) for i in book.items()] == [("s1", 2, 2), ("s3", 0, 0)]
    assert book.fold([{"op": "DROP", "id": "s1"}, {"op": "ADD", "text": "four"}], 9) == 0 and [i["id"] for i in book.items()] == ["s3", "s4"] and book.fold([], 0) == 2


def test_streamed_folds(spark):
    df = spark.createDataFrame([("a", 2, 1.5), ("a", 1, None), ("b", 1, 2.0), (None, 1, 1.0)], "k string, o int, v double")
    out = fold_streams(df, ["k"], ["o"], lambda: [0.0], lambda s, r: s.__setitem__(0, s[0] + (r[1] or 0)) or [], lambda s: [(s[0],)], ["o", "v"], "k string, total double").collect()
    assert {r.k: r.total for r in out} == {"a": 1.5, "b": 2.0, None: 1.0}


def test_dense_search_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], "clash") for i in range(300)]
    rows.append((300, list(rows[7][1]), "copy"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in retrieval.dense_search(df.filter("vec_id % 100 = 0"), "vec_id", "embedding", df, "vec_id", "embedding", 5, skip_self=True).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for q in (0, 100, 200, 300):
        best = sorted((i for i, _, _ in rows if i != q), key=lambda i: (-round(cos(rows[q][1], rows[i][1]), 5), i))[:5]
        assert {k for _, k in got[q]} == set(best)
    with pytest.raises(Exception, match="wrong size"):
        retrieval.check_vectors(df, "embedding", 4).count()
    assert retrieval.check_vectors(df, "embedding", 5).count() == 301


def test_merging_along_the_tree(spark):
    tree = {"p": (None, ["a", "b", "c"], "one two three four five six"), "a": ("p", [], "one two"), "b": ("p", [], "three four"), "c": ("p", [], "five six")}
    rows = lambda t: spark.createDataFrame([(i, p, "leaf" if not k else "section", k, x) for i, (p, k, x) in t.items()], "chunk_id string, parent_id string, level string, child_ids array<string>, source_text string")

    def merged(ranked, t, budget):
        out = retrieval.auto_merge(spark.createDataFrame([(1, c, n) for n, c in enumerate(ranked)], "query int, chunk_id string, rank int"), rows(t), budget)
        return [(r.chunk_id, r.n_leaves, r.merges) for r in out.orderBy("place").collect()]

    assert merged(["a", "b"], tree, 100) == [("p", 3, 1)] and merged(["a", "b"], tree, 3) == [("a", 1, 0), ("b", 1, 0)] and merged(["a"], tree, 0) == []
    assert merged(["a"], {"p": (None, ["a"], "one two"), "a": ("p", [], "one two")}, 9) == [("p", 1, 0)]
    # Up two levels; leaves below a chosen chunk are covered by it, and n_leaves counts leaves, not sections.
    deep = {"d": (None, ["p", "q"], "one two three four five six seven"), "q": ("d", ["e"], "seven"), "e": ("q", [], "seven")} | {k: (("d" if k == "p" else v[0]), *v[1:]) for k, v in tree.items()}
    assert merged(["a", "b", "e", "c"], deep, 100) == [("d", 4, 2)]
    assert {(r.root_id, r.leaf_id, r.path) for r in retrieval.descendant_leaves(rows(deep)).filter("root_id = 'd'").collect()} == {("d", "a", "0000000000"), ("d", "b", "0000000001"), ("d", "c", "0000000002"), ("d", "e", "0000100000")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "lost"), ("y", None)], "chunk_id string, parent_id string")
    assert {r.depth for r in retrieval.ancestors(chain).filter("chunk_id = 'a'").collect()} == {1, 2, 3, 4} and retrieval.ancestors(chain.limit(0)).count() == 0
    assert abs(sum(x * x for x in retrieval.hash_embedding("some words here")) - 1) < 1e-9 and not any(retrieval.hash_embedding(""))
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query int, source int, key string, rank int")
    assert [r.key for r in retrieval.fill_pool(lists, "query", "source", "key", "rank", 3).orderBy("place").collect()] == ["a", "c", "b"]
    assert [r.key for r in retrieval.fuse(lists, "query", "key", 2).orderBy("rank").collect()] == ["b", "a"]


def test_metrics(spark):
    r = spark.createDataFrame([(1, "x", i, i == 3) for i in (1, 2, 3, 4)] + [(2, "y", 1, False)], "query int, key string, rank int, relevant boolean")
    assert {x["query"]: (x.hit, x.mrr) for x in retrieval.hit_and_mrr(r, "query", "relevant").collect()} == {1: (1, 0.333333), 2: (0, 0.0)}
    judged = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "c", 2), (3, "z", 1)], "query int, key string, grade int")
    ranked = spark.createDataFrame([(1, "a", 1), (2, "q", 1), (2, "c", 2)], "query int, key string, rank int")
    got = {x["query"]: (x.recall, x.ndcg) for x in retrieval.recall_and_ndcg(judged, ranked, "query", "key").collect()}
    assert got[1] == (1.0, 1.0) and got[3] == (0.0, 0.0) and got[2][0] == 1.0 and got[2][1] == pytest.approx(0.63093, abs=1e-5)


def test_rate_limits(spark, tmp_path):
    times, passed = [], []
    for t in (0, 1, 2, 10, 11, 12):
        times, ok, _ = limits.admit(times, t, [(2, 10)])
        passed.append(ok)
    assert passed == [True, True, False, True, True, False]
    assert limits.admit([], 0, [(1, 5)], cost=2) == ([], False, 5.0) and limits.admit([1, 2, 3], 4, [(9, 3), (3, 10)]) == ([1, 2, 3], False, 7) and limits.admit([1, 2], 4, [(2, 3), (9, 10)], 2)[1:] == (False, 1)
    rows = [(i, f"u{i % 2}", f"2025-01-01 00:00:{i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, u string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r.key: r.allowed for r in limits.replay(df, "u", "ts", "id", [(3, 8.0)]).collect()}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.limited(stream, "u", "ts", "id", [(3, 8.0)]).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {int(r.key): r.allowed for r in spark.table("limited").collect()} == batch
    assert limits.without_markers("a<!--used:s1-->b<!-- note -->c<!--us") == "ab<!-- note -->c"


def test_relational(spark):
    log = spark.createDataFrame([(1, "p", " A@x ", "add", "viewer", 1), (2, "p", "a@X", "add", "editor", 2), (3, "p", "b@x", "add", "viewer", 3), (4, "p", "b@x", "remove", None, 4)], "seq int, project_id string, email string, op string, role string, created_at int")
    m = relational.members(log)
    assert [tuple(r) for r in m.collect()] == [("p", "a@x", "editor", 1)]
    projects = spark.createDataFrame([("p", "u1"), ("q", "u2")], "project_id string, owner_user_id string")
    callers = spark.createDataFrame([("u1", "z@x"), ("u2", "a@x")], "caller string, email string")
    roles = {(r.project_id, r.caller): r.role for r in relational.effective_role(projects, m, callers).collect()}
    assert roles == {("p", "u1"): "owner", ("q", "u2"): "owner", ("p", "u2"): "editor"}
    assert one(spark, relational.at_least(F.lit("editor"), "viewer")) and not one(spark, relational.at_least(F.lit(None).cast("string"), "viewer"))
    assert {(r.project_id, r.shared) for r in relational.listed_projects(projects, m, "u2", "a@x").collect()} == {("q", False), ("p", True)}
    moved, left = relational.transfer(projects, m, spark.createDataFrame([("p", "u2", "a@x", "z@x", 9)], "project_id string, new_owner string, new_email string, old_email string, at int"))
    assert {r.owner_user_id for r in moved.collect()} == {"u2"} and [(r.email, r.role) for r in left.collect()] == [("z@x", "editor")]
    shares = spark.createDataFrame([(1, "t", "share", "s1", None, 4), (2, "t", "revoke", None, None, None), (3, "t", "share", "s2", None, 5), (4, "t", "invite", None, None, None), (5, "t", "refresh", None, None, 8)], "seq int, thread_id string, op string, share_id string, access string, through int")
    assert [tuple(r) for r in relational.share_state(shares).collect()] == [("t", "s2", "invite", 8)]
    s = spark.createDataFrame([("s1", "link"), ("s2", "invite"), ("s3", "invite")], "share_id string, access string")
    who = spark.createDataFrame([("s2", "A@x")], "share_id string, email string")
    assert {r.share_id for r in relational.readable_shares(s, who, "a@x").collect()} == {"s1", "s2"}
    files = spark.createDataFrame([("f1", "d1"), ("f2", "d1"), ("f3", "d2")], "file_id string, doc_id string")
    kept, lost = relational.purge(files, files.filter("file_id <> 'f2'"))
    assert [r.file_id for r in kept.collect()] == ["f2"] and [r.doc_id for r in lost.collect()] == ["d2"]
    p = relational.profile(spark.createDataFrame([(1, "u", "Ann", "A@x"), (2, "u", None, " "), (3, "u", " Bob ", None)], "seq int, owner_user_id string, display_name string, email string")).first()
    assert p.display_name == "Bob" and p.email is None
    lg = relational.logins(spark.createDataFrame([("u", 1, "a@x", False), ("u", 2, None, True), ("u", 3, None, False)], "uid string, at int, email string, clear_email boolean")).first()
    assert tuple(lg) == ("u", 1, 3, None)
    live = spark.createDataFrame([("o", "k", "Some  Value")], "owner_user_id string, key string, value string")
    new = spark.createDataFrame([(1, "o", "k", "some value"), (2, "o", "k", "Other"), (3, "o", "k", "OTHER")], "seq int, owner_user_id string, key string, value string")
    assert [r.seq for r in relational.new_memories(new, live).collect()] == [2]
    props = spark.createDataFrame([("a",), ("b",), ("c",)], "proposal_id string")
    acts = spark.createDataFrame([(1, "a", "confirm"), (2, "a", "dismiss"), (3, "b", "dismiss")], "seq int, proposal_id string, action string")
    still, made = relational.proposals_settled(props, acts)
    assert [r[0] for r in still.collect()] == ["c"] and [r[0] for r in made.collect()] == ["a"]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="{}"/></Relationships>'


def test_office_files(spark):
    para = lambda t, style="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    docx = zipped({"word/document.xml": f"<w:document {W}><w:body>{para('Top', 'Heading1')}{para('Text')}{para('Sub', 'Heading2')}{para('More')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>"})
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Qty</t></is></c></row><row r="2"><c r="A2"><v>3.0</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>'
    xlsx = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format("worksheets/sheet1.xml"), "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {S}><si><t>Item</t></si></sst>"})
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    pptx = zipped({"ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": REL.format("slides/slide1.xml"), "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('Hello', 'title')}<p:grpSp>{shape('inside')}</p:grpSp></p:spTree></p:cSld></p:sld>"})
    bomb = zipped({"word/document.xml": "<x/>"})
    files = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.docx", b"nothing"), ("e.txt", b"x"), ("f.docx", None), ("g.docx", bomb)], "path string, content binary")
    got = {}
    for r in office.parse(files).orderBy("path", "block_order").collect():
        got.setdefault(r.path, []).append((r.type, r.text))
    assert got["a.docx"] == [("heading", "Top"), ("paragraph", "Text"), ("heading", "Sub"), ("paragraph", "More"), ("table", "a | b"), ("table_row", "a | b"), ("table_cell", "a"), ("table_cell", "b")]
    assert got["b.xlsx"] == [("table", "| Item | Qty |"), ("table_row", "| 3 | TRUE |")]
    assert got["c.pptx"] == [("slide", "Hello"), ("paragraph", "inside")]
    assert office.workbook_facts(xlsx) == {"sheets": 1, "cells": 4, "formulas": 0, "stored": 0, "pictures": 0}
    wide = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format("worksheets/sheet1.xml"), "xl/media/a.png": "x", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1"><f>1+1</f><v>2</v></c><c r="B1"><f>A1</f></c><c r="C1"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:XFD1048576"/></mergeCells></worksheet>'})
    assert office.workbook_facts(wide) == {"sheets": 1, "cells": 3, "formulas": 2, "stored": 1, "pictures": 1} and [r[1] for r in office.xlsx_blocks(wide)] == ["| 2 |"]
    assert all(got[p][0][0] == "error" for p in ("d.docx", "e.txt", "f.docx", "g.docx"))


def test_corpora_and_sinks(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"_id": "1", "title": "t", "text": "hello"}\n{"_id": "2", "text": " "}\n')
    assert [r.passage_id for r in corpora.read_passages(spark, str(tmp_path / "p.jsonl")).collect()] == ["1"]
    (tmp_path / "p.zip").write_bytes(zipped({"p.jsonl": '{"_id": "1", "title": "t", "text": "hello"}\n'}))
    assert [tuple(r) for r in corpora.read_zipped_passages(spark, str(tmp_path / "p.zip")).collect()] == [("1", "t", "hello")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\nq\ta\t0\nq\tb\t2\n")
    assert [tuple(r) for r in corpora.read_judgements(spark, str(tmp_path / "q.tsv")).collect()] == [("q", "b", 2)]
    talk = [{"sample_id": "s", "conversation": {"speaker_a": "A", "session_2": [{"speaker": "A", "dia_id": "D2:1", "text": "hi", "blip_caption": "a cat"}], "session_2_date_time": "x"}, "qa": [{"question": "q", "answer": 5, "category": 2, "evidence": ["D2:1"]}]}]
    (tmp_path / "t.json").write_text(json.dumps(talk))
    messages, questions = corpora.read_conversations(spark, str(tmp_path / "t.json"))
    assert [tuple(r) for r in messages.collect()] == [("s", 2, 0, "A", "D2:1", "hi [shares a cat]")] and questions.first().category == 2
    assert corpora.plain_text("<p>a&amp;b</p><script>x</script><div>c  d</div>") == "a&b\nc d" and corpora.plain_text(None) == ""
    assert corpora.page_blocks('{"block_type": "Document", "children": [{"block_type": "Text", "html": "<p>x</p>", "bbox": [3, 4, 1, 2]}]}') == [(1, "text", "x", [1, 2, 3, 4])]
    path = str(tmp_path / "table")
    sinks.write_new(spark.createDataFrame([(i, f"d{i % 4}", "old") for i in range(40)], "id int, doc string, v string"), path, "id", 8)
    sinks.upsert(spark.createDataFrame([(3, "d3", "new"), (99, "d9", "new")], "id int, doc string, v string"), path, "id")
    rows = {r.id: r.v for r in sinks.read(spark, path).collect()}
    assert len(rows) == 41 and rows[3] == rows[99] == "new" and rows[4] == "old"
    sinks.delete(spark.createDataFrame([(i,) for i in range(30)], "id int"), path, "id")
    assert {r.id for r in sinks.read(spark, path).collect()} == {*range(30, 40), 99}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
