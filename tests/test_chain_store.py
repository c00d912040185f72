"""Small cases of the chain, the stores, prompts and converted documents: nulls, ties, repeats, empty tables, clashing names."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import answers, chain, convert, prompts, retrieval, store, structure
from sedimenta.sources import stores
from sedimenta.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_parsers(spark):
    lit = F.lit
    assert one(spark, prompts.facts(lit('[" one ", "", "two words", "three"]'), 2, 3)) == ["one", "two"] and one(spark, prompts.facts(lit("no list"), 2, 3)) is None
    got = one(spark, prompts.operations(lit('[{"op": "ADD", "text": " a "}, {"op": "BAD", "text": "b"}, {"op": "DROP"}, 7, {"op": "ADD", "text": "c"}]'), ["ADD", "DROP"], "op", "text", 5, 9))
    assert [tuple(x) for x in got] == [("ADD", "a"), ("ADD", "c")]
    r = one(spark, prompts.rewrite(lit('{"query": " better ", "candidates": ["a", " ", "b", "c", "d"]}'), lit("q")))
    assert r.query == "better" and r.candidates == ["a", "b", "c"]
    assert one(spark, prompts.rewrite(lit("broken {"), lit("q"))).query == "q" and one(spark, prompts.rewrite(lit(None).cast("string"), lit("q"))).candidates == []
    frames = one(spark, prompts.sse_frames(lit('event: a\ndata: {"n":1}\n\ndata: 2\n\nevent: ping\n\n')))
    assert [tuple(f) for f in frames] == [("a", '{"n":1}'), ("message", "2")]
    assert one(spark, prompts.prompt_items(lit("[s1|u:2|f:1] one\n[s2|u:0|f:3] two"))) == "[s1] one\n[s2] two"
    assert one(spark, prompts.usable_tokens(lit(100), lit(200))) == 0 and one(spark, prompts.chars_per_token(lit(100), lit(2), lit(True))) == 8.0 and one(spark, prompts.chars_per_token(lit(100), lit(0), lit(True))) == 4.0
    assert [prompts.ip_bucket(a) for a in ("1.2.3.4", "2001:db8::1", "::ffff:1.2.3.4", "no", None)] == ["1.2.3.4", "2001:db8::/64", "1.2.3.4", "no", None]
    assert prompts.term_hash("a") == prompts.term_hash("a") != prompts.term_hash("b") and prompts.term_hash(None) is None
    assert [one(spark, prompts.tool_status(lit(k), lit(v), lit(s))) for k, v, s in (("name", "x", "user"), ("--", "x", "user"), ("name", " ", "user"), ("name", "x" * 2001, "user"), ("name", "x", None))] == ["ok", "invalid_key", "empty_value", "too_long", "unknown_scope"]
    assert one(spark, prompts.memory_line(lit("k"), lit("v"), lit(""), lit(False))) == "- k: v" and one(spark, prompts.memory_line(lit("k"), lit("v"), lit("saved 3 days ago"), lit(True))) == "- k: v (saved 3 days ago; overrides a wider memory)"
    assert one(spark, T.terms(lit("東京 tower"))) == ["東京", "tower", "東", "京", "東京"] and one(spark, T.terms(lit("plain"))) == ["plain"] and one(spark, T.terms(lit(None).cast("string"))) is None
    assert convert.read_env("# note\nA=1\nexport B = 'x y'\n\nC\nA=2") == {"A": "2", "B": "x y"}


def test_memory_sections(spark):
    rows = [("u", "fact", "- b", 0), ("u", "preference", "- p", 1), ("u", "fact", "- a", 2), ("u", "fact", "- c", 3), ("v", "fact", "- z", 0)]
    got = {r.owner_user_id: r.section for r in prompts.memory_sections(frame(spark, rows, "owner_user_id string, type string, line string, place int"), 3).collect()}
    assert got == {"u": "Facts\n- a\n- b\n\nPreferences\n- p\n\n1 more are not shown", "v": "Facts\n- z"}


def test_chain_steps(spark):
    chunks = frame(spark, [("a", "d1", "o1", "p1", "leaf", True, ["b1", "b2"]), ("b", "d1", "o1", "p1", "leaf", True, ["b1"]), ("s", "d1", "o1", "p1", "section", False, ["b1"]), ("c", "d2", "o2", None, "leaf", True, None)], "chunk_id string, doc_id string, owner_user_id string, project_id string, level string, citable boolean, source_block_ids array<string>")
    assert {r.chunk_id for r in chain.tenant(chunks, "o1", "p1").collect()} == {"a", "b", "s"} and chain.tenant(chunks, "o2", "p1").count() == 0 and chain.tenant(chunks, None, None).count() == 4
    assert {r.chunk_id for r in chain.without_documents(chunks, frame(spark, [("d1", 1), ("d1", 2)], "doc_id string, level int")).collect()} == {"c"}
    assert {r.chunk_id for r in chain.fetched(chunks, frame(spark, [("a", "o1"), ("c", "o1"), ("x", "o1")], "chunk_id string, owner_user_id string"), ["owner_user_id"]).collect()} == {"a"}
    assert {tuple(r) for r in chain.holding_blocks(chunks, frame(spark, [("b1",), ("b9",)], "block_id string"), 1).collect()} == {("b1", "a")}
    files = frame(spark, [("p", "d1", "completed", None), ("p", "d1", "completed", 5), ("p", "d2", "completed", 5), ("p", "d3", "failed", None), (None, "d4", None, None)], "project_id string, doc_id string, status string, trashed_at int")
    assert {r.project_id: (r.active, r.trashed) for r in chain.searchable(files).collect()} == {"p": (["d1"], ["d2"]), None: ([], [])}
    below = frame(spark, [("s", "a", "0"), ("s", "b", "1"), ("a", "a", ""), ("t", "z", "0")], "root_id string, leaf_id string, path string")
    hits = frame(spark, [(1, "b", 1, 5.0), (1, "a", 2, 4.0)], "query int, chunk_id string, rank int, score double")
    chosen = frame(spark, [(1, "s"), (1, "t"), (1, "s")], "query int, chunk_id string")
    scored = chain.merged_scores(chosen, hits, below)
    assert {tuple(r) for r in scored.collect()} == {(1, "s", 5.0, 1), (1, "t", 0.0, 3)}
    assert [r.leaf_id for r in chain.evidence(scored, below).orderBy("place").collect()] == ["a", "b", "z"]
    pool = frame(spark, [(1, "x", 1), (1, "y", 2), (1, "n", 3)], "query int, key string, place int")
    ranked = chain.rerank(pool, frame(spark, [(1, "red lamp")], "query int, question string"), frame(spark, [("x", "a lamp"), ("y", "the red lamp"), ("n", None)], "key string, text string"), 9)
    assert [(r.key, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("y", 1), ("x", 2), ("n", 3)]
    assert one(spark, chain.index_text(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit(3), F.lit(2)), F.lit("x"))) == "T / A / B / page 2-3\nx" and one(spark, chain.index_text(F.lit(None).cast("string"), F.array().cast("array<string>"), F.array().cast("array<int>"), F.lit("x"))) == "x"
    sample = frame(spark, [(i, i) for i in range(50)], "id int, __x int")
    assert {r.id for r in chain.seeded_sample(sample, "id", 9, 3).collect()} == {r.id for r in chain.seeded_sample(sample.orderBy(F.desc("id")).repartition(5), "id", 9, 3).collect()} and chain.seeded_sample(sample.limit(0), "id", 9, 3).count() == 0
    both = chain.sampled_corpus(sample, sample.filter("id < 3"), "id", 4, 1)
    assert both.count() == 7 and both.filter("id < 3").count() == 3
    stored = frame(spark, [(1, [1.0, 0.0])], "id int, v array<double>")
    got = {r.id: (r.embedding, r.stored) for r in chain.with_fallback(frame(spark, [(1, "a"), (2, "b"), (3, None)], "id int, t string"), stored, "id", "v", "t", 8).collect()}
    assert got[1] == ([1.0, 0.0], True) and len(got[2][0]) == 8 and got[3] == ([0.0] * 8, False)


def test_stores(spark):
    log = frame(spark, [("f", "insert", "a", 1), ("f", "trash", None, 2), ("f", "restore", None, 3), ("f", "rename", "b", 4), ("g", "insert", "x", 1), ("g", "delete", None, 2), ("h", "insert", "y", 1), ("h", "delete", None, 2), ("h", "insert", "z", 3), ("h", "trash", None, 4), ("n", "trash", None, 1)], "file_id string, op string, name string, seq int")
    assert {tuple(r) for r in store.file_states(log).collect()} == {("f", "b", False, 1), ("h", "z", True, 2)} and store.file_states(log.limit(0)).count() == 0
    assert [one(spark, store.delete_policy(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((False, True, False), (True, True, False), (False, False, False), (False, True, True), (None, None, None))] == ["trash", "purge", "purge", "purge", "purge"]
    t = frame(spark, [("t", "create", None, 1), ("t", "append", None, 2), ("t", "summary", "s1", 3), ("t", "summary", None, 5), ("u", "create", None, 4), ("u", "rename", "x", 9)], "thread_id string, op string, value string, seq int")
    states = store.thread_states(t)
    assert {tuple(r) for r in states.collect()} == {("t", 1, 2, None, None), ("u", 0, 4, None, None)}
    assert {r.thread_id: r["order"] for r in store.recency_order(states).collect()} == {"t": 1, "u": 2}
    m = frame(spark, [(f"m{p}", "t", "User ", "x" * 10, p) for p in range(1, 9)] + [("m0", "t", "user", "again", 3), ("q", "t", "user", None, None)], "message_id string, thread_id string, role string, content string, position int")
    assert {r.position for r in store.conversation_window(m, 3).collect()} == {1, 6, 7, 8} and store.conversation_window(m.limit(0), 3).count() == 0
    assert [tuple(r) for r in store.compaction(m, 3, 1_000, 2).collect()] == [("t", 2, 6)] and [tuple(r) for r in store.compaction(m, 9, 20, 2).collect()] == [("t", 2, 4)]
    plan = store.preflight(m, 2, 9, 60, 0.5).collect()
    assert {r.replanned for r in plan} == {True} and {r.position for r in plan} == {1, 7, 8}
    assert store.position_range(m, 5, 2, 9).count() == 0
    invites = frame(spark, [("s", " A@x", "invite", 1), ("s", "b@x", "invite", 2), ("s", "a@X", "remove", 3), ("s", "a@x", "invite", 4), ("s", "b@x", "remove", 5)], "share_id string, email string, op string, seq int")
    assert [tuple(r) for r in store.recipients(invites).collect()] == [("s", ["a@x"])]
    users = frame(spark, [("e@x", "u1", 5), ("E@x", "u2", None), ("e@x", "u3", 5), ("f@x", "u4", None), (None, "u5", 1)], "email string, user string, at int").withColumn("at", F.timestamp_seconds("at"))
    assert {tuple(r) for r in store.latest_user(users, "email", "user", "at").collect()} == {("e@x", "u1"), ("f@x", "u4")}
    c = frame(spark, [("c1", "o", "thread", "t", 1), ("c2", "o", "thread", "t", 2), ("c3", "o", "user", "", 1)], "candidate string, owner_user_id string, scope string, target string, seq long")
    held = frame(spark, [("o", "thread", "t", 1)], "owner_user_id string, scope string, target string, n long")
    assert {tuple(r) for r in store.write_or_propose(c, held, {"thread": 2, "project": 2, "user": 2}).collect()} == {("c1", True), ("c2", False), ("c3", True)}


def test_converted_documents(spark):
    pic = base64.b64encode(b"12345").decode()
    payload = json.dumps({"children": [{"page": 0, "children": [{"block_type": "SectionHeader", "html": "<h1>A</h1>", "bbox": [9, 2, 1, 4]}, {"block_type": "Picture", "bbox": [0, 0, 1, 1], "images": {"bad": "?", "p.png": pic}}, {"block_type": "Text", "html": "<p>no box</p>"}]}, {"page": 1, "block_type": "PageFooter", "text": "7", "bbox": [0, 0, 1, 1]}]})
    got = convert.converted_blocks(frame(spark, [("d", payload), ("e", "broken"), ("f", None)], "doc_id string, payload string")).collect()
    assert [(r.page, r.block_type, r.text, r.bbox, r.media_bytes, r.furniture) for r in got] == [(1, "heading", "A", [1, 2, 9, 4], None, False), (1, "figure", "", [0, 0, 1, 1], 5, False), (2, "paragraph", "7", [0, 0, 1, 1], None, True)]
    rows = [("d", 1, p, "Logo", "figure", False) for p in (1, 2, 3)] + [("d", 10 * p + 1, p, f"T{p}", "heading", False) for p in (1, 2)] + [("d", 12, 1, "body", "paragraph", None), ("d", 13, 1, "foot", "paragraph", True), ("d", 14, 1, None, "figure", False), ("d", 30, 3, "last", "paragraph", False)]
    deck = frame(spark, [(d, s + p if k == "figure" else s, p, t, k, f, "x") for d, s, p, t, k, f in rows], "doc_id string, seq int, page int, text string, block_type string, furniture boolean, section string")
    assert [(r.page, r.place, r.type, r.text) for r in convert.slide_blocks(deck.drop("section")).orderBy("page", "place").collect()] == [(1, 0, "slide", "T1"), (1, 1, "paragraph", "body"), (2, 0, "slide", "T2"), (3, 0, "slide", "Slide 3"), (3, 1, "paragraph", "last")]
    blocks = [("d", f"b{i}", i, k, t, ["S"], p, None, "en") for i, (k, t, p) in enumerate([("heading", "Top", None), ("table", "| a |", None), ("table_row", "| 1 |", "b1"), ("table_row", "| 2 |", "b1"), ("paragraph", "end", None), ("paragraph", None, None)])]
    b = frame(spark, blocks, "doc_id string, block_id string, block_order int, type string, text string, section_path array<string>, parent_block_id string, media_ref string, language string")
    assert "".join(r.text for r in convert.markdown(b, 2).orderBy("part").collect()) == "# Top\n\n| 1 |\n| 2 |\n\nend\n\n" and convert.markdown(b.limit(0)).count() == 0
    assert {r.doc_id for r in convert.too_long(b, 5).collect()} == {"d"} and convert.too_long(b, 6).count() == 0
    order = convert.reading_order(frame(spark, [("d", 1, 2, 0.0, 0.0), ("d", 2, 1, 5.0, 9.0), ("d", 3, 1, 9.0, 1.0), ("d", 4, 1, 1.0, None)], "doc_id string, seq int, page int, x double, y double"), F.col("x"), F.col("y"))
    assert [r.seq for r in order.orderBy("block_order").collect()] == [4, 3, 2, 1]


def test_breaks_and_limits_with_several_rules(spark):
    v = frame(spark, [("a", i, [1.0, 0.0] if i != 5 else [0.0, 1.0]) for i in range(9)] + [("b", 1, [1.0, 1.0])], "label string, vec_id int, embedding array<double>")
    got = {(r.label, r.vec_id): r.piece for r in structure.semantic_breaks(v, "label", "vec_id", "embedding", 0.7).collect()}
    assert [got["a", i] for i in range(9)] == [0] * 5 + [1] + [2] * 3 and got["b", 1] == 0
    times, out = [], []
    for t in (0, 1, 2, 11, 12):
        times, ok, wait = limits.admit(times, t, [(2, 10), (3, 100)])
        out.append((ok, wait))
    assert out == [(True, 0.0), (True, 0.0), (False, 8), (True, 0.0), (False, 88)]


def test_stems_and_marks(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "formalize": "formal", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "rate": "rate", "sky": "sky", "42": "42", "größe": "größe"}
    assert {w: answers.stem(w) for w in known} == known
    rows = frame(spark, [(1, "The pumps failed", "a pump fails"), (2, None, "x"), (3, "", "")], "id int, p string, r string")
    assert {r.id: r.f1 for r in answers.stemmed_f1(rows, "id", "p", "r").collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    text = "a<!--used:s1-->b<!-- note -->c<d <!-- used:s2"
    for n in (1, 2, 3, 50):
        f = limits.MarkerFilter()
        assert "".join(f.feed(text[i : i + n]) for i in range(0, len(text), n)) + f.close() == "ab<!-- note -->c<d "


def test_objects_and_sidecars(spark, tmp_path):
    shelf = stores.ObjectStore(spark, f"file://{tmp_path}/objects")
    shelf.put("a/b.bin", b"\x00\xff")
    assert shelf.get("a/b.bin") == b"\x00\xff" and shelf.get("a/none") is None and shelf.delete("a") and shelf.get("a/b.bin") is None
    with pytest.raises(ValueError):
        shelf.put("../x", b"")
    assert stores.sidecar(shelf, "d") is None
    for version in ("1", "2"):
        stores.put_sidecar(shelf, "d", version, f"# v{version}", {"b": (0, 3)}, [{"id": "b"}])
    assert stores.sidecar(shelf, "d") == ("# v2", {"b": [0, 3]}, [{"id": "b"}])
    assert stores.check_profile(shelf, "index", {"model": "hash", "dimensions": 8}) == stores.check_profile(shelf, "index", {"dimensions": 8, "model": "hash"})
    with pytest.raises(ValueError):
        stores.check_profile(shelf, "index", {"model": "hash", "dimensions": 9})


def test_merging_against_a_plain_walk(spark):
    """Random trees of three levels: running sums give what looking everything up again gives."""
    rng = random.Random(11)
    for _ in range(60):
        tree = {"d": (None, [])}
        for s in range(rng.randrange(1, 4)):
            tree[f"s{s}"] = ("d", [])
            tree["d"][1].append(f"s{s}")
            for k in range(rng.randrange(1, 5)):
                tree[f"l{s}{k}"] = (f"s{s}", [])
                tree[f"s{s}"][1].append(f"l{s}{k}")
        text = {n: "w " * rng.randrange(1, 12) for n in tree if n[0] == "l"}
        for n in sorted(tree, reverse=True):
            text.setdefault(n, "".join(text.get(c, "") for c in tree[n][1]) + "x " * rng.randrange(0, 4))
        for n in ("d",):
            text[n] = "".join(text[c] for c in tree[n][1])
        chars, tokens = {n: len(t) for n, t in text.items()}, {n: len(t.split()) for n, t in text.items()}
        ranked = rng.sample([n for n in tree if n[0] == "l"], k=len([n for n in tree if n[0] == "l"]))
        budget = rng.choice([5, 20, 60])
        chosen, merges = [], 0
        under = lambda n, top: n == top or n is not None and tree[n][0] is not None and under(tree[n][0], top)
        for leaf in ranked:
            if not any(under(leaf, c) for c in chosen):
                node = leaf if len(tree[tree[leaf][0]][1]) > 1 else tree[leaf][0]
                chosen.append(node)
                while (up := tree[node][0]) is not None:
                    kin, spent = [c for c in chosen if tree[c][0] == up], sum(tokens[c] for c in chosen)
                    if len(kin) < 2 or sum(chars[c] for c in kin) < chars[up] / 3 * (1 + spent / budget) - 1e-9 or tokens[up] - sum(tokens[c] for c in kin) > budget - spent:
                        break
                    chosen, merges, node = [c for c in chosen if c not in kin] + [up], merges + 1, up
            if sum(tokens[c] for c in chosen) >= budget:
                break
        state = retrieval.Siblings({n: (p, len(k), chars[n], tokens[n]) for n, (p, k) in tree.items()}, budget)
        for leaf in ranked:
            state.offer(leaf)
            if state.spent >= budget:
                break
        assert (list(state.chosen), state.merges, state.spent) == (chosen, merges, sum(tokens[c] for c in chosen))
