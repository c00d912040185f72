"""Problem 6: items packed into containers of a fixed capacity.

Method: variable-capacity best-fit. Only the histogram of the sizes goes to the driver, which has at most one row for
each size up to the capacity. Patterns of containers are made from it: the largest size left opens a container of the
permitted length at the least cost, counted as the share that best-fit filling would leave unused; the pattern repeats
as often as its sizes last; at last each container is downsized to the smallest permitted length that holds its contents.
The rows get their containers by their rank within their size, so no group of rows is ever gathered.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import bucketed_rank, stage
from .tokens import RANKS, token_counts

CAPACITY = 2_048
#: Lengths that a container may have; the largest is the capacity.
LENGTHS = (256, 512, 1_024, 2_048)
#: Ranks within a size are taken in this many parts.
PARTS = 256


def fill(length: int, first: int, left: dict[int, int], sizes: list[int]) -> dict[int, int]:
    """A best-fit pattern: ``first``, then again and again the largest size left that fits. sizes: sorted keys of left."""
    pattern = {first: 1}
    room = length - first
    while room and sizes:
        at = bisect.bisect_right(sizes, room) - 1
        while at >= 0 and left[sizes[at]] <= pattern.get(sizes[at], 0):
            at -= 1
        if at < 0:
            break
        s = sizes[at]
        take = min(room // s, left[s] - pattern.get(s, 0))
        pattern[s] = pattern.get(s, 0) + take
        room -= take * s
    return pattern


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, dict[int, int]]]:
    """[(length, times, pattern)] that packs a histogram of sizes from 1 to the largest length.

    Each round uses up at least one size or all but the last few of one, so the rounds are bounded by the sizes.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        first = sizes[-1]
        best = None
        for length in lengths:
            if length >= first:
                pattern = fill(length, first, left, sizes)
                used = sum(s * k for s, k in pattern.items())
                cost = ((length - used) / length, -length)
                if best is None or cost < best[0]:
                    best = (cost, used, pattern)
        _, used, pattern = best
        times = min(left[s] // k for s, k in pattern.items())
        out.append((min(x for x in lengths if x >= used), times, pattern))
        for s, k in pattern.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
    return out


def plan_rows(patterns: list[tuple[int, int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, items of the size in each container, first container, length)."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for length, times, pattern in patterns:
        for s, k in sorted(pattern.items()):
            low = taken.get(s, 0)
            taken[s] = low + times * k
            rows.append((s, low, low + times * k, k, container, length))
        container += times
    return rows


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(key, part, start_token, n_tokens, container_id, container_length): every item in a container.

    An item above the capacity is cut into full containers and a rest, parts counting from 0; no other item is cut.
    Items of size 0 or null take no room and go to container 0. Rows that repeat a key are items of their own.
    """
    spark = sized.sparkSession
    capacity = max(lengths)
    lengths = tuple(sorted(set(lengths)))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    items = sized.select(F.col(key), n.alias("n")).withColumn("parts", F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int"))
    items = items.select(key, "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    items = items.select(F.col(key), "part", (F.col("part").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("n_tokens"))
    # One row for each size up to the capacity: bounded by the capacity.
    histogram = {r.n_tokens: r.times for r in items.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("times")).collect()}
    rows = plan_rows(plan(histogram, lengths))
    planned = spark.createDataFrame(rows, "size int, low long, high long, each int, first_container long, container_length int")
    ranked = bucketed_rank(items.filter("n_tokens > 0"), ["n_tokens"], F.pmod(F.xxhash64(F.col(key), "part"), F.lit(PARTS)), [F.col(key), F.col("part")], "rank")
    # The plan has at most as many rows as patterns times sizes in a pattern, whatever the number of items.
    inside = (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(planned), inside).select(
        key, "part", "start_token", "n_tokens", (F.col("first_container") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("container_id"), "container_length"
    )
    empty = items.filter("n_tokens = 0").select(key, "part", "start_token", "n_tokens", F.lit(0).cast("long").alias("container_id"), F.lit(rows[0][5] if rows else lengths[0]).cast("int").alias("container_length"))
    return placed.unionByName(empty)


def containers(documents: DataFrame, ranks: str = RANKS, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """pack() of documents by their text, sized in tokens of a public tokenizer."""
    # Staged, as the histogram and the ranks read it and tokenizing costs the most.
    return pack(stage(token_counts(documents, "text", [F.col("doc_id")], ranks)), lengths=lengths)


def fills(packed: DataFrame) -> DataFrame:
    """(container_length, containers, tokens, fill): how full the containers are, by length."""
    each = packed.groupBy("container_id", "container_length").agg(F.sum("n_tokens").alias("tokens"))
    return each.groupBy("container_length").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("container_length"), 6).alias("fill"))
