"""Problem 7: sources mixed to target shares of the tokens.

Method: entropy balancing. The rates of the texts are those nearest to an even rate, in relative entropy over tokens, that
give every source its share and keep the lengths of the texts as they are in the pool: without that, a mix takes over the
lengths of the sources it prefers. They tilt exponentially: rate = exp(multiplier of the source + multiplier of the length
times the text's length), no higher than the source's repeats. The multipliers solve a convex dual by Newton steps; each
step is one distributed sum over the counts of (source, size), of which a few numbers for each source come back. Rates are
rounded into whole copies systematically, in the order of size, so that the tokens of a source come out to within a text,
and then moved until the shares are met.

A unit is a distinct text: all documents with it share its copies.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import UNICODE_SPACE, bucketed_rank, stage
from .tokens import RANKS, token_counts

#: Most sources with a target; the table of them is fixed.
MOST_SOURCES = 1_000
STEPS, CLOSE = 30, 1e-9
#: A source that is to give all but this share of what its cap allows is used up; lengths count to this many spreads.
SLACK, WIDEST = 1e-6, 3.0
#: Ranks within a source and size are taken in this many parts.
PARTS = 256
#: Rounds in which the rates are moved for the rounding, and how near to its goal a source is near enough.
ROUNDS, NEAR = 8, 2e-4


def plain_source(column: str):
    """A source as it is spelt in the targets: lower case, outer blanks off, blanks and hyphens inside as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), rf"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")), rf"[{UNICODE_SPACE}\-]+", "_")


def units(documents: DataFrame, targets: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(text_hash, doc_id, source, n_tokens): each distinct text of a source with a target, with its least doc_id.

    A text that several sources have counts for the first of them by name. Texts without tokens are left out.
    """
    wanted = targets.filter("source IS NOT NULL").select(plain_source("source").alias("source")).distinct()
    carried = [F.col("doc_id"), plain_source("source").alias("source"), F.sha2("text", 256).alias("text_hash")]
    sized = token_counts(documents.filter("text IS NOT NULL"), "text", carried, ranks)
    return sized.join(wanted, "source", "left_semi").filter("n_tokens > 0").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def length_of(middle: float, spread: float) -> Column:
    """The length of a text for balancing: its standardised logarithm, between -WIDEST and WIDEST."""
    z = (F.log(F.col("n_tokens")) - F.lit(middle)) / F.lit(spread)
    return F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), z))


def rate_of(turn: dict[str, float], tilt: dict[str, float], caps: dict[str, int]) -> tuple[Column, Column]:
    """(rate, whether it is below the cap) of a row with source and z."""
    by = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("source")]
    free = F.exp(F.least(F.lit(50.0), by(turn) + by(tilt) * F.col("z")))
    return F.least(by(caps), free), free <= by(caps)


def solve(counts: DataFrame, goal: dict[str, float], caps: dict[str, int], have: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """(multiplier of each source, tilt by length of each source) by Newton steps on the dual.

    counts: (source, n_tokens, times, z). Constraints: the tokens of each source, and over the sources that are not used
    up, the mean length of the pool. A source that its cap uses up has no choice left and keeps its cap. Where a cap binds,
    the rate stays at it and leaves the curvature. Where the length cannot be kept, sources alone are balanced.
    """
    names = sorted(goal)
    open_ones = [s for s in names if goal[s] < caps[s] * have[s] * (1 - SLACK)]
    for balanced in (True, False):
        turn = {s: math.log(max(1e-12, min(float(caps[s]), goal[s] / have[s]))) for s in names}
        mu, aim = 0.0, None
        for _ in range(STEPS):
            tilt = {s: mu if s in open_ones else 0.0 for s in names}
            rate, bent = rate_of(turn, tilt, caps)
            mass, z = F.col("n_tokens") * F.col("times"), F.col("z")
            some = mass * F.when(bent, rate).otherwise(0.0)
            sums = {r.source: r for r in counts.groupBy("source").agg(F.sum(mass * z).alias("pool"), F.sum(mass * rate).alias("m"), F.sum(mass * rate * z).alias("mz"), F.sum(some).alias("b"), F.sum(some * z).alias("bz"), F.sum(some * z * z).alias("bzz")).collect()}
            if aim is None:
                whole = sum(have[s] for s in open_ones)
                aim = sum(goal[s] for s in open_ones) * sum(sums[s].pool for s in open_ones) / whole if whole else 0.0
            gap = {s: sums[s].m - goal[s] for s in open_ones}
            off = sum(sums[s].mz for s in open_ones) - aim if balanced else 0.0
            size = sum(goal.values())
            if max([abs(v) for v in gap.values()] + [abs(off)], default=0.0) <= CLOSE * size:
                return turn, tilt
            n = len(open_ones)
            hessian = np.zeros((n + 1, n + 1))
            for i, s in enumerate(open_ones):
                hessian[i, i], hessian[i, n], hessian[n, i] = sums[s].b, sums[s].bz, sums[s].bz
            hessian[n, n] = sum(sums[s].bzz for s in open_ones)
            if not balanced:
                hessian[n, :n] = hessian[:n, n] = 0.0
                hessian[n, n] = 1.0
            step = np.linalg.lstsq(hessian + 1e-12 * max(1.0, np.trace(hessian)) * np.eye(n + 1), np.array([*(gap[s] for s in open_ones), off]), rcond=None)[0]
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            turn = {s: turn[s] - float(step[open_ones.index(s)]) if s in open_ones else turn[s] for s in names}
            mu -= float(step[n])
    return turn, {s: 0.0 for s in names}


def rounded(counts: DataFrame, turn: dict[str, float], tilt: dict[str, float], caps: dict[str, int]) -> DataFrame:
    """Adds rate and before: the sum of the rates of all smaller texts of the source. One row for each source and size."""
    w = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rated = counts.withColumn("rate", rate_of(turn, tilt, caps)[0])
    return rated.withColumn("before", F.coalesce(F.sum(F.col("times") * F.col("rate")).over(w), F.lit(0.0)))


def upto(k: Column) -> Column:
    """Whole copies of the texts of a source up to the k-th of a size: the rates summed up and rounded."""
    return F.floor(F.col("before") + k * F.col("rate") + 0.5 + 1e-9)


def settle(counts: DataFrame, turn: dict[str, float], tilt: dict[str, float], caps: dict[str, int], goal: dict[str, float]) -> dict[str, float]:
    """The multipliers moved a little so that the tokens after rounding meet the goals; one sum over the counts a round."""
    best = {s: (math.inf, t) for s, t in turn.items()}
    for _ in range(ROUNDS):
        copies = upto(F.col("times")) - upto(F.lit(0))
        got = {r.source: float(r.n) for r in rounded(counts, turn, tilt, caps).groupBy("source").agg(F.sum(F.col("n_tokens") * copies).alias("n")).collect()}
        for s in turn:
            off = got.get(s, 0.0) / goal[s] - 1
            best[s] = min(best[s], (abs(off), turn[s]))
            turn[s] -= math.log(max(0.5, min(2.0, 1 + off)))
        if all(off <= NEAR for off, _ in best.values()):
            break
    return {s: t for s, (_, t) in best.items()}


def mixed(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): (doc_id, source, n_tokens, copies) of the texts used, and the shares reached by source.

    total: tokens of the selection; by default the most that the caps allow, so that the scarcest source is used up.
    Sources with a target but without texts cannot contribute: they are reported with 0, and the shares of the others
    hold among each other. Null and unknown sources are not used. Targets that repeat a source add up, the least repeats hold.
    """
    spark = documents.sparkSession
    rows = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(plain_source("source").alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    share, cap = {r.source: float(r.share) for r in rows}, {r.source: int(r.cap) for r in rows}
    # Staged, as its counts and the selection read it.
    unit = stage(units(documents, targets, ranks).filter(F.col("source").isin(list(share)) if share else F.lit(False)))
    sizes = unit.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    middle = sizes.agg(F.sum(F.col("n_tokens") * F.col("times")).alias("n"), F.sum(F.col("n_tokens") * F.col("times") * F.log("n_tokens")).alias("a"), F.sum(F.col("n_tokens") * F.col("times") * F.log("n_tokens") * F.log("n_tokens")).alias("b")).first()
    mean = middle.a / middle.n if middle.n else 0.0
    spread = max(1e-6, math.sqrt(max(0.0, middle.b / middle.n - mean * mean))) if middle.n else 1.0
    # One row for each source and size: all that the Newton steps and the rounding need.
    counts = stage(sizes.withColumn("z", length_of(mean, spread)))
    have = {r.source: int(r.n) for r in counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("n")).collect()}
    there = {s: share[s] for s in share if have.get(s)}
    whole = sum(there.values())
    there = {s: v / whole for s, v in there.items()}
    picked = counts.select("source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0.0).alias("before"))
    if there:
        most = min(cap[s] * have[s] / v for s, v in there.items())
        size = float(min(most, total) if total else most)
        aims, caps = {s: v * size for s, v in there.items()}, {s: cap[s] for s in there}
        turn, tilt = solve(counts, aims, caps, {s: float(have[s]) for s in there})
        picked = rounded(counts, settle(counts, turn, tilt, caps, aims), tilt, caps).select("source", "n_tokens", "rate", "before")
    ranked = bucketed_rank(unit, ["source", "n_tokens"], F.pmod(F.xxhash64("text_hash"), F.lit(PARTS)), [F.col("text_hash")], "rank")
    selection = ranked.join(picked, ["source", "n_tokens"]).withColumn("copies", (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    goal = spark.createDataFrame([(s, share[s], cap[s], have.get(s, 0)) for s in share], "source string, target_share double, max_repeats int, available_tokens long")
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("texts"))
    all_of = used.agg(F.sum("tokens").alias("all_tokens"))
    report = (
        goal.join(used, "source", "left")
        .join(F.broadcast(all_of))
        .select(
            "source",
            "target_share",
            "max_repeats",
            "available_tokens",
            F.coalesce("texts", F.lit(0)).alias("texts"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        )
    )
    return selection, report
