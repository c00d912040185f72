import math
import random

import pytest

from sedimenta.llm import mixing as p7
from sedimenta.llm import packing as p6
from sedimenta.llm import tokens


def test_plan_holds_everything_and_wastes_little():
    rng = random.Random(3)
    for lengths in ((64,), (16, 32, 64), (64, 100)):
        histogram = {}
        for _ in range(5000):
            s = min(max(lengths), max(1, int(rng.expovariate(1 / 14))))
            histogram[s] = histogram.get(s, 0) + 1
        plan = p6.plan(histogram, lengths)
        packed = {}
        for length, times, pattern in plan:
            used = sum(s * k for s, k in pattern.items())
            assert used <= length and length == min(x for x in lengths if x >= used)
            for s, k in pattern.items():
                packed[s] = packed.get(s, 0) + times * k
        assert packed == histogram
        room = sum(length * times for length, times, _ in plan)
        assert sum(s * n for s, n in histogram.items()) >= 0.98 * room
    assert p6.plan({}) == [] and p6.plan({2048: 3}) == [(2048, 3, {2048: 1})]


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 1, 5, 30, 63, 64, 65, 200, rng.randrange(1, 64)]), "clash") for i in range(700)]
    got = p6.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, part string"), lengths=(16, 64)).collect()
    whole, fill = {}, {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        key = r.container_id
        fill.setdefault(key, [0, r.container_length])[0] += r.n_tokens
        assert r.n_tokens <= r.container_length == fill[key][1] and r.start_token == 64 * r.part
    assert whole == {i: n or 0 for i, n, _ in rows}
    assert all(used <= length for used, length in fill.values())
    cut = {r.doc_id for r in got if r.part}
    assert cut == {i for i, n, _ in rows if n and n > 64}
    assert p6.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert [tuple(r)[1:] for r in p6.pack(spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")).collect()] == [(0, 0, 0, 0, 256)]


def documents(spark, rng):
    rows = []
    for source, n in (("big", 400), ("Small ", 60), ("tiny", 12), (None, 20), ("other", 30)):
        for _ in range(n):
            rows.append((len(rows), "word " * rng.randrange(1, 60) + str(len(rows)), source, "clash"))
    rows += [(1000 + i, rows[460][1], "tiny", "clash") for i in range(5)]  # copies under other ids
    rows += [(2000, None, "big", "x"), (2001, "", "big", "x"), (2002, "word " * 30_000, "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def test_mix(spark):
    docs = documents(spark, random.Random(5))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, shares = p7.mixed(docs, targets)
    rows = {r.source: r for r in shares.collect()}
    assert set(rows) == {"big", "small", "tiny", "absent"} and rows["absent"].tokens == 0
    for s, want in (("big", 0.5 / 0.9), ("small", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(rows[s].reached_share - want) < 0.02, s
    texts = {r.doc_id: r.text for r in docs.collect()}
    used = {}
    for r in selection.collect():
        used[texts[r.doc_id]] = used.get(texts[r.doc_id], 0) + r.copies
        assert 1 <= r.copies <= rows[r.source].max_repeats
    assert max(used.values()) <= 3
    for a, b in ((docs.limit(0), targets), (docs, targets.limit(0))):
        none, report = p7.mixed(a, b)
        assert none.count() == 0 and all(r.tokens == 0 for r in report.collect())


def test_newton_keeps_shares_and_lengths_under_caps(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    sizes = [("a", rng.randrange(200, 900)) for _ in range(90)] + [("b", rng.randrange(10, 300)) for _ in range(120)] + [("c", 50)] * 10
    counts = spark.createDataFrame(sizes, "source string, n_tokens long").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("times")).withColumn("z", p7.length_of(5.0, 1.0))
    have = {s: float(sum(n for x, n in sizes if x == s)) for s in "abc"}
    caps = {"a": 1, "b": 3, "c": 2}
    goal = {"a": 0.6 * have["a"], "b": 1.2 * have["b"], "c": 2.0 * have["c"]}

    def reached(turn, tilt):
        rate = p7.rate_of(turn, tilt, caps)[0]
        t = F.col("n_tokens") * F.col("times")
        rows = {r.source: (r.m, r.mz, r.most) for r in counts.groupBy("source").agg(F.sum(t * rate).alias("m"), F.sum(t * rate * F.col("z")).alias("mz"), F.max(rate).alias("most")).collect()}
        return rows, sum(rows[s][1] for s in "ab") / sum(rows[s][0] for s in "ab")

    pool = counts.filter("source <> 'c'").agg((F.sum(F.col("n_tokens") * F.col("times") * F.col("z")) / F.sum(F.col("n_tokens") * F.col("times"))).alias("m")).first().m
    turn, tilt = p7.solve(counts, goal, caps, have)
    rows, mean = reached(turn, tilt)
    assert all(abs(rows[s][0] / goal[s] - 1) < 1e-6 and rows[s][2] <= caps[s] + 1e-9 for s in "abc")
    # The lengths of the pool are kept; a division by source would not keep them.
    assert abs(mean - pool) < 1e-6 and tilt["a"] != 0 and tilt["c"] == 0
    assert abs(reached({s: math.log(goal[s] / have[s]) for s in "abc"}, dict.fromkeys("abc", 0.0))[1] - pool) > 0.05


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "Hello world, this is it."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame, "text", [frame["doc_id"]]).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(tokens.tokenizer().encode_ordinary("Hello world, this is it."))
    assert tokens.tokenizer().decode(tokens.tokenizer().encode_ordinary("größer – weiter")) == "größer – weiter"


@pytest.mark.parametrize("bad", [{"a": 1}])
def test_fill_prefers_what_fits_best(bad):
    assert p6.fill(10, 6, {6: 1, 3: 5, 4: 1}, [3, 4, 6]) == {6: 1, 4: 1}
