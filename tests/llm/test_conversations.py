import datetime as dt
import json
import random

from sedimenta.llm import conversations as p5

SCHEMA = "message_id string, thread_id string, role string, content string, citations string, created_at timestamp, position int, conv_id string"


def brute(rows):
    """Defects by looking at all rows of each thread."""
    threads = {}
    for _, thread, role, content, _, _, position, _ in rows:
        role = role.strip().lower() if role is not None else None
        threads.setdefault(thread, set()).add((position, role, content))
    out = {}
    for thread, said in threads.items():
        blank = lambda c: c is None or not c.replace("​", "").strip()
        if all(blank(c) for _, _, c in said):
            out[thread] = "empty"
            continue
        positions = [p for p, _, _ in said]
        if None in positions or sorted(positions) != list(range(1, len(said) + 1)):
            out[thread] = "broken"
            continue
        turns = [(r, blank(c)) for _, r, c in sorted(said, key=lambda x: x[0])]
        roles = [r for r, _ in turns]
        if set(roles) - {"user", "assistant"} or roles[0] != "user" or any(a == b == "assistant" for a, b in zip(roles, roles[1:])) or any(r == "user" and b for r, b in turns):
            out[thread] = "broken"
        elif any(r == "user" and turns[i + 1 : i + 2] != [("assistant", False)] for i, (r, _) in enumerate(turns)):
            out[thread] = "missing_reply"
    return out


def rows_of(seed, threads=150):
    rng = random.Random(seed)
    rows = []
    for t in range(threads):
        n = rng.choice([1, 2, 2, 3, 4, 4, 6, 12])
        for i in range(1, n + 1):
            role = "user" if i % 2 else "assistant"
            text = f"text {i}"
            x = rng.random()
            if x < 0.04:
                role = rng.choice([" User ", "ASSISTANT", None, "bot", ""])
            elif x < 0.1:
                text = rng.choice([None, "", " ​ ", "\n"])
            position = None if rng.random() < 0.01 else i + (rng.random() < 0.03)
            row = (f"m{t}-{i}", f"t{t}" if t else None, role, text, None, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rng.randrange(99)), position, "clash")
            rows += [row] * (2 if rng.random() < 0.1 else 1)
    rows.append(("z", "t-long", "user", "x " * 200_000, None, None, 1, None))
    return rows


def test_threads_against_brute_force(spark, monkeypatch):
    rows = rows_of(3)
    got = p5.conversation_defects(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.conv_id: r.defect for r in got if r.defect} == brute(rows)
    assert len(got) == len({r[1] for r in rows})


def test_blocks_are_stitched(spark):
    long = [(str(i), "t", "user" if i % 2 else "assistant", "x", None, None, i, None) for i in range(1, 2 * p5.BLOCK + 3)]
    gone = [r for r in long if r[6] != p5.BLOCK + 1]
    twice = [(*r[:2], "assistant" if r[6] == p5.BLOCK + 1 else r[2], *r[3:]) for r in long]
    silent = [(*r[:3], None if r[6] == p5.BLOCK else "x", *r[4:]) for r in long]
    for rows in (long, gone, twice, silent):
        got = p5.conversation_defects(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [r.defect for r in got] == [brute(rows).get("t")]


def test_turns_and_empty_table(spark):
    rows = rows_of(4)
    bad = brute(rows)
    turns = p5.conversations(spark.createDataFrame(rows, SCHEMA)).filter("conv_id IS NOT NULL").collect()
    assert {r.conv_id for r in turns} == {r[1] for r in rows if r[1]} - set(bad)
    assert p5.conversation_defects(spark.createDataFrame([], SCHEMA)).count() == 0
    assert p5.report_defects(spark.createDataFrame([], "report_id string, conversation string")).count() == 0


def test_kahn_orders_by_time_and_leaves_cycles():
    order, left = p5.kahn_order(["a", "b", "c", "d", "e"], {"b": ["a"], "c": ["a"], "d": ["e"], "e": ["d"]}, {"a": 5, "b": 9, "c": 7})
    assert order == ["a", "c", "b"] and set(left) == {"d", "e"}
    assert p5.kahn_order(["x"], {"x": ["gone"]}, {}) == ([], ["x"])


def test_reports():
    say = lambda *turns: json.dumps([{"role": r, "content": c} for r, c in turns])
    assert [p5.report_defect(x) for x in (None, " ​", "null", "[]", say(("user", ""), ("assistant", None)))] == ["empty"] * 5
    assert [p5.report_defect(x) for x in ("{", "[1, {\"role\": \"user\", \"content\": \"x\"}]", "{}", say(("assistant", "x")), say(("user", "x"), ("assistant", "y"), ("assistant", "z")), say(("user", " "), ("assistant", "y")), say(("user", "x"), ("tool", "y")))] == ["broken"] * 7
    assert [p5.report_defect(x) for x in (say(("user", "x")), say(("user", "x"), ("assistant", "​")), say(("user", "x"), ("user", "y"), ("assistant", "z")))] == ["missing_reply"] * 3
    assert p5.report_defect(say((" User", "x"), ("ASSISTANT ", "y"))) is None


def test_turns_of_both_tables(spark, tmp_path):
    from sedimenta.llm.queries import p5_turns

    say = lambda *turns: json.dumps([{"role": r, "content": c} for r, c in turns])
    whole = say((" User", "a"), ("ASSISTANT", "b"), ("user", "c"), ("assistant", "d"))
    reports = [("r1", whole), ("r1", whole), ("r2", say(("user", "a"))), ("r3", "{"), ("r4", None), ("t1", say(("user", "x"), ("assistant", "y")))]
    messages = [("m1", "t1", "user", "a", None, None, 1, None), ("m2", "t1", "assistant", "b", None, None, 2, None), ("m3", "t2", "user", "a", None, None, 1, None)]
    spark.createDataFrame(messages, SCHEMA).write.parquet(f"{tmp_path}/thread_messages.parquet")
    spark.createDataFrame(reports, "report_id string, conversation string").write.parquet(f"{tmp_path}/message_reports.parquet")
    got = sorted((r.src_table, r.conv_id, r.turn, r.role, r.content) for r in p5_turns(spark, str(tmp_path)).collect())
    threads = [("thread_messages", "t1", 0, "user", "a"), ("thread_messages", "t1", 1, "assistant", "b")]
    assert got == sorted([("message_reports", "r1", i, ("user", "assistant")[i % 2], "abcd"[i]) for i in range(4)] + [("message_reports", "t1", 0, "user", "x"), ("message_reports", "t1", 1, "assistant", "y")] + threads)
