"""Problem 5: conversations rebuilt from message rows.

Method: the reply graph of a conversation is sorted topologically by Kahn's algorithm, ties going to the earlier
timestamp; nodes left over show cycles, gaps and missing parents; then roles and completeness are checked.

A conversation may hold a third of all rows, so its graph is cut into blocks of positions. Each block is sorted on its
own and leaves one summary row; the summaries are stitched in block order. Rows that repeat a position are folded before
that, so a block never holds more nodes than it has positions.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import SPACES, UNICODE_SPACE, in_groups

#: Positions in a block of the reply graph.
BLOCK = 4096
#: What counts as nothing in a message: white space and zero-width spaces.
BLANK = rf"^[{UNICODE_SPACE}\u200b]*$"
SPEAKERS = ("user", "assistant")
SUMMARY = (
    "conv_id string, block long, nodes long, placed long, low long, high long, repeated boolean, strange boolean, full boolean, "
    "hollow boolean, twice boolean, alone boolean, first_role string, first_blank boolean, last_role string, last_blank boolean"
)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def plain_role(role: Column) -> Column:
    return F.lower(F.regexp_replace(role, rf"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", ""))


def kahn_order(nodes: list, parents: dict, when: dict) -> tuple[list, list]:
    """(the nodes in an order in which each follows its parents, the nodes left over).

    parents: node -> list of nodes it replies to; a parent that is not among the nodes never comes, so its replies and
    theirs are left over, like the nodes of a cycle. when: node -> sort key; ties go to the node itself.
    """
    waiting = {n: len(set(parents.get(n, ()))) for n in nodes}
    replies: dict = {}
    for n in waiting:
        for p in set(parents.get(n, ())):
            replies.setdefault(p, []).append(n)
    ready = [(when.get(n), n) for n, count in waiting.items() if not count]
    heapq.heapify(ready)
    order = []
    while ready:
        _, n = heapq.heappop(ready)
        order.append(n)
        for r in replies.get(n, ()):
            waiting[r] -= 1
            if not waiting[r]:
                heapq.heappush(ready, (when.get(r), r))
    done = set(order)
    return order, [n for n in waiting if n not in done]


def _summary(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """One block of one conversation; rows: (position, copies, role, blank, when in microseconds)."""
    conv, block = key
    at = {int(p): (r, b) for p, _, r, b, _ in rows if p is not None}
    when = {int(p): t for p, _, _, _, t in rows if p is not None}
    # The first position of a block hangs on the block before it, which the stitching checks.
    order, left = kahn_order(list(at), {p: [p - 1] for p in at if (p - 1) % BLOCK}, when)
    said = [at[p] for p in order]
    pairs = list(zip(said, said[1:]))
    yield (
        conv,
        block,
        sum(int(c) for _, c, _, _, _ in rows),
        len(order),
        min(at, default=None),
        max(at, default=None),
        any(c > 1 or p is None for p, c, _, _, _ in rows) or bool(left),
        any(r not in SPEAKERS for _, _, r, _, _ in rows),
        any(not b for _, _, _, b, _ in rows),
        any(r == "user" and b for _, _, r, b, _ in rows),
        any(a[0] == "assistant" == b[0] for a, b in pairs),
        any(a[0] == "user" and not (b[0] == "assistant" and not b[1]) for a, b in pairs),
        *(said[0] if said else (None, None)),
        *(said[-1] if said else (None, None)),
    )


def message_nodes(messages: DataFrame, conv: str, position: str, role: str, content: str, when: str) -> DataFrame:
    """One row for each (conversation, position): how many different messages claim it, and one of them.

    Rows equal in conversation, position, role and content are one message; contents are compared by SHA-256.
    """
    m = messages.select(
        F.col(conv).cast("string").alias("conv_id"),
        F.col(position).cast("long").alias("position"),
        plain_role(F.col(role)).alias("role"),
        is_blank(F.col(content)).alias("blank"),
        F.sha2(F.col(content), 256).alias("text_hash"),
        F.unix_micros(F.col(when).cast("timestamp")).alias("t"),
    )
    once = m.groupBy("conv_id", "position", "role", "text_hash").agg(F.min("blank").alias("blank"), F.min("t").alias("t"))
    roles = F.collect_set(F.coalesce("role", F.lit("")))
    # A set of roles is small: unknown ones are folded to one before.
    once = once.withColumn("role", F.when(F.col("role").isin(*SPEAKERS), F.col("role")).otherwise(F.lit("?")))
    return once.groupBy("conv_id", "position").agg(
        F.count(F.lit(1)).alias("copies"), F.element_at(F.sort_array(roles), 1).alias("role"), F.bool_and("blank").alias("blank"), F.min("t").alias("t")
    )


def block_summaries(messages: DataFrame, conv: str = "thread_id", position: str = "position", role: str = "role", content: str = "content", when: str = "created_at") -> DataFrame:
    """Sorts each block of positions and sums it up; positions below 1 and null ones form a block of their own."""
    nodes = message_nodes(messages, conv, position, role, content, when).withColumn(
        "block", F.when(F.col("position") >= 1, F.floor((F.col("position") - 1) / BLOCK)).otherwise(F.lit(-1)).cast("long")
    )
    # Positions below 1 may be many: only whether there are any matters.
    odd = nodes.filter("block = -1").groupBy("conv_id", "block").agg(F.min("position").alias("position"), (F.sum("copies") + 1).alias("copies"), F.min("role").alias("role"), F.bool_and("blank").alias("blank"), F.min("t").alias("t"))
    nodes = nodes.filter("block >= 0").unionByName(odd)
    return in_groups(nodes, ["conv_id", "block"], ["position"], _summary, ["position", "copies", "role", "blank", "t"], SUMMARY)


def conversation_defects(messages: DataFrame, conv: str = "thread_id", position: str = "position", role: str = "role", content: str = "content", when: str = "created_at") -> DataFrame:
    """(conv_id, turns, defect) for every conversation; defect is null where it is whole.

    Null and repeated rows, nulls in any column, blank texts and ties of the timestamps have defined results: equal rows
    count once, a null position or role breaks the conversation, a null content is blank. Rows with a null conversation
    id form one conversation with a null id. An empty table gives no rows. Other columns are not read.
    """
    blocks = block_summaries(messages, conv, position, role, content, when)
    return _stitched(blocks)


def _stitched(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("block")
    prev = F.lag(F.struct("block", "high", "last_role", "last_blank")).over(w)
    s = blocks.withColumn("prev", prev)
    joined = F.col("prev").isNotNull()
    s = s.withColumn("gap", F.when(joined, (F.col("prev.high") + 1) != F.col("low")).otherwise(F.col("low") != 1)).withColumn(
        "seam_twice", joined & (F.col("prev.last_role") == "assistant") & (F.col("first_role") == "assistant")
    ).withColumn("seam_alone", joined & (F.col("prev.last_role") == "user") & ~((F.col("first_role") == "assistant") & ~F.col("first_blank")))
    last = F.max_by(F.struct("last_role", "last_blank"), "block")
    a = s.groupBy("conv_id").agg(
        F.sum("nodes").alias("turns"),
        F.bool_or("full").alias("full"),
        F.bool_or(F.col("repeated") | F.coalesce("gap", F.lit(True)) | (F.col("block") < 0) | F.col("strange") | F.col("hollow") | F.col("twice") | F.coalesce("seam_twice", F.lit(False))).alias("broken"),
        F.min_by("first_role", "block").alias("first_role"),
        F.bool_or(F.col("alone") | F.coalesce("seam_alone", F.lit(False))).alias("alone"),
        last.alias("last"),
    )
    defect = (
        F.when(~F.col("full"), "empty")
        .when(F.col("broken") | ~F.col("first_role").eqNullSafe(F.lit("user")), "broken")
        .when(F.col("alone") | (F.col("last.last_role") == "user"), "missing_reply")
    )
    # An assistant's blank reply leaves its user alone also at the end, which "alone" holds.
    return a.select("conv_id", "turns", defect.alias("defect"))


def conversations(messages: DataFrame, conv: str = "thread_id", position: str = "position", role: str = "role", content: str = "content", when: str = "created_at") -> DataFrame:
    """(conv_id, turn, role, content): the whole conversations in order, turn from 0; the others are dropped."""
    good = conversation_defects(messages, conv, position, role, content, when).filter("defect IS NULL").select("conv_id")
    rows = (
        messages.select(F.col(conv).cast("string").alias("conv_id"), (F.col(position).cast("long") - 1).alias("turn"), plain_role(F.col(role)).alias("role"), F.col(content).alias("content"))
        .join(good, "conv_id", "left_semi")
        .distinct()
    )
    return rows


def _parsed(raw: str | None) -> tuple[list[tuple[str, object]] | None, bool]:
    """(turns or None where the text can't be read as a list, whether there is nothing at all)."""
    if raw is None or not raw.strip(SPACES + "\u200b"):
        return [], True
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None, False
    if value is None:
        return [], True
    if not isinstance(value, list):
        return None, False
    turns = []
    for x in value:
        role, text = (x.get("role"), x.get("content")) if isinstance(x, dict) else (None, None)
        turns.append((role.strip(SPACES).lower() if isinstance(role, str) else "", text if isinstance(text, str) or text is None else json.dumps(text)))
    return turns, not turns


def report_defect(raw: str | None) -> str | None:
    """The defect of one stored conversation; its list order is the reply order, so its graph is a chain."""
    turns, nothing = _parsed(raw)
    if nothing:
        return "empty"
    if turns is None:
        return "broken"
    blank = [t is None or not t.strip(SPACES + "\u200b") for _, t in turns]
    if all(blank):
        return "empty"
    order, left = kahn_order(list(range(len(turns))), {i: [i - 1] for i in range(1, len(turns))}, {})
    roles = [turns[i][0] for i in order]
    if left or roles[0] != "user" or any(r not in SPEAKERS for r in roles) or any(a == b == "assistant" for a, b in zip(roles, roles[1:])) or any(r == "user" and b for r, b in zip(roles, blank)):
        return "broken"
    if any(r == "user" and not (i + 1 < len(roles) and roles[i + 1] == "assistant" and not blank[i + 1]) for i, r in enumerate(roles)):
        return "missing_reply"
    return None


def report_defects(reports: DataFrame, key: str = "report_id", conversation: str = "conversation") -> DataFrame:
    """(conv_id, defect) for every stored JSON conversation; defect is null where it is whole."""
    c = reports.select(F.col(key).cast("string").alias("conv_id"), F.col(conversation).alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "defect": [report_defect(r) for r in pdf["raw"]]}, dtype=object)

    return c.mapInPandas(run, "conv_id string, defect string")


def report_turns(reports: DataFrame, key: str = "report_id", conversation: str = "conversation") -> DataFrame:
    """(conv_id, turn, role, content) of the whole stored conversations."""
    c = reports.select(F.col(key).cast("string").alias("conv_id"), F.col(conversation).alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, n, r, t) for i, raw in zip(pdf["conv_id"], pdf["raw"]) if report_defect(raw) is None for n, (r, t) in enumerate(_parsed(raw)[0])]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "content"])

    return c.mapInPandas(run, "conv_id string, turn long, role string, content string").distinct()


def found(messages: DataFrame, reports: DataFrame) -> DataFrame:
    """(src_table, conv_id, defect): the conversations that are empty, broken or lack a reply."""
    a = conversation_defects(messages).select(F.lit("thread_messages").alias("src_table"), "conv_id", "defect")
    b = report_defects(reports).select(F.lit("message_reports").alias("src_table"), "conv_id", "defect").distinct()
    return a.unionByName(b).filter("defect IS NOT NULL")


def turns(messages: DataFrame, reports: DataFrame) -> DataFrame:
    """(src_table, conv_id, turn, role, content): the whole conversations of both tables in order."""
    a = conversations(messages).select(F.lit("thread_messages").alias("src_table"), "conv_id", "turn", "role", "content")
    b = report_turns(reports).select(F.lit("message_reports").alias("src_table"), "conv_id", "turn", "role", "content")
    return a.unionByName(b)
