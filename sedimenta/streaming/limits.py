"""A sliding-window rate limiter: stateful on a stream, and as a replay over a table.

Refused calls are not charged, so a count over a range of time would be too high: the state is the times of the calls
that were let through, which the limit of the longest window bounds. A limiter has one or more rules (calls, seconds);
a call passes when it fits all of them, and is then charged to all of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..frames import fold_streams

Rules = Sequence[tuple[int, float]]


def admit(times: list[float], now: float, rules: Rules, cost: int = 1) -> tuple[list[float], bool, float]:
    """(times kept, whether the call passes, seconds to wait). times: sorted, a call of cost n stands n times.

    For each rule the calls of its window are what a binary search leaves; the wait is the longest over the rules, and
    a whole window where the cost alone is above a rule.
    """
    kept = times[bisect_right(times, now - max(w for _, w in rules)) :]
    waits = [0.0]
    for most, window in rules:
        inside = kept[bisect_right(kept, now - window) :]
        over = len(inside) + cost - most
        if over > 0:
            waits.append(float(window) if over > len(inside) else inside[over - 1] + window - now)
    passes = len(waits) == 1
    return (kept + [now] * cost if passes else kept), passes, max(waits)


def replay(events: DataFrame, bucket: str, at: str, key: str, rules: Rules, cost: str | None = None) -> DataFrame:
    """(bucket, key, allowed, wait) of every event in the order of time, ties by key; any number of events streams through."""
    price = F.col(cost).cast("int") if cost else F.lit(1)
    rows = events.filter(F.col(at).isNotNull()).select(F.col(bucket).alias("bucket"), F.col(key).alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.coalesce(price, F.lit(1)).alias("cost"))

    def step(state: list, row: tuple) -> list[tuple]:
        t, k, n = row
        state[0], passes, wait = admit(state[0], t, rules, int(n))
        return [(k, passes, round(wait, 6))]

    kinds = dict(rows.dtypes)
    return fold_streams(rows, ["bucket"], ["t", "key"], lambda: [[]], step, lambda state: [], ["t", "key", "cost"], f"bucket {kinds['bucket']}, key {kinds['key']}, allowed boolean, wait double")


def limited(events: DataFrame, bucket: str, at: str, key: str, rules: Rules) -> DataFrame:
    """The same on a stream: (bucket, key, allowed, wait); a bucket without calls for the longest window is forgotten.

    Calls are charged in the order of time within each Arrow batch of a micro-batch; the state of a bucket is bounded by
    the rules.
    """
    rows = events.select(F.col(bucket).cast("string").alias("bucket"), F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    longest = max(w for _, w in rules)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for calls in batches:
            out = []
            for t, k in sorted(zip(calls["t"], calls["key"])):
                times, passes, wait = admit(times, t, rules)
                out.append((group[0], k, passes, wait))
            yield pd.DataFrame(out, columns=["bucket", "key", "allowed", "wait"])
        state.update((times,))
        state.setTimeoutDuration(int(longest * 1_000))

    return rows.groupBy("bucket").applyInPandasWithState(run, "bucket string, key string, allowed boolean, wait double", "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def active_users(events: DataFrame, at: str, user: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, end, users): approximate distinct users in sliding windows of event time, with a watermark for late rows."""
    w = F.window(F.col(at), window, "1 day")
    return events.withWatermark(at, late).groupBy(w).agg(F.approx_count_distinct(user).alias("users")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "users")


def without_markers(text: str) -> str:
    """A finished answer as the stream filter leaves it: used-marks cut out, other comments kept, an open mark's tail dropped."""
    import re

    text = re.sub(r"<!--\s*used:[^>]*?-->", "", text)
    open_mark = text.rfind("<!--")
    return text[:open_mark] if open_mark >= 0 and "-->" not in text[open_mark:] else text


class MarkerFilter:
    """Lets an answer through as it comes, but for its used-marks; what may be the begin of one is held back.

    ``feed`` gives what is safe to show, ``close`` the rest: an open mark is dropped, anything else comes out.
    """

    OPEN, CLOSE, KIND = "<!--", "-->", "used:"

    def __init__(self) -> None:
        self.held = ""

    def feed(self, piece: str) -> str:
        self.held += piece
        shown = []
        while self.held:
            at = self.held.find(self.OPEN)
            if at < 0:
                keep = next((n for n in range(len(self.OPEN) - 1, 0, -1) if self.held.endswith(self.OPEN[:n])), 0)
                shown.append(self.held[: len(self.held) - keep])
                self.held = self.held[len(self.held) - keep :]
                break
            shown.append(self.held[:at])
            self.held = self.held[at:]
            end = self.held.find(self.CLOSE)
            if end < 0:
                break
            mark, self.held = self.held[: end + len(self.CLOSE)], self.held[end + len(self.CLOSE) :]
            if not mark[len(self.OPEN) :].lstrip().startswith(self.KIND):
                shown.append(mark)
        return "".join(shown)

    def close(self) -> str:
        rest, self.held = self.held, ""
        return "" if rest.startswith(self.OPEN) else rest
