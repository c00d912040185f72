"""State kept in change logs: files, threads, shares, memories with their audit, proposals, users, and the lists shown of them.

A log is a table of operations in the order of a sequence column; a state is what it leaves, taken by aggregates over the
log (last or first of a kind of operation), so that no key is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import bucketed_rank, fold_streams
from ..functions import text as T
from . import history


def _last(value: str | Column, when: Column, seq: str = "seq") -> Column:
    return F.max_by(F.struct(F.col(value).alias("v") if isinstance(value, str) else value.alias("v")), F.when(when, F.col(seq)))["v"]


def _at(when: Column, seq: str = "seq") -> Column:
    return F.max(F.when(when, F.col(seq)))


def file_states(log: DataFrame) -> DataFrame:
    """(file_id, name, trashed, versions) of the files that are there; log: (file_id, op, name, seq).

    op: insert, rename, trash, restore, delete. Deleting ends a file; a later insert begins it anew, out of the trash.
    """
    op = F.col("op")
    a = log.groupBy("file_id").agg(
        _at(op == "insert").alias("i"), _at(op == "delete").alias("d"), _at(op == "trash").alias("t"), _at(op.isin("restore", "insert", "delete")).alias("r"), _last("name", op.isin("insert", "rename")).alias("name"), F.sum((op == "insert").cast("long")).alias("versions")
    )
    return a.filter(F.col("i").isNotNull() & (F.col("d").isNull() | (F.col("i") > F.col("d")))).select("file_id", "name", F.coalesce(F.col("t") > F.col("r"), F.lit(False)).alias("trashed"), "versions")


def delete_policy(permanent: Column, indexed: Column, trashed: Column) -> Column:
    """What deleting a document does: to the trash first, purged when asked for, already there, or never indexed."""
    return F.when(F.coalesce(permanent, F.lit(False)) | ~F.coalesce(indexed, F.lit(False)), "purge").when(F.coalesce(trashed, F.lit(False)), "purge").otherwise("trash")


def file_list(files: DataFrame, trashed: bool) -> DataFrame:
    """(project_id, doc_id, place): the active files of each project, or all of them, newest first."""
    kept = files if trashed else files.filter("trashed_at IS NULL")
    # Buckets of days, newest first.
    day = F.coalesce(-F.floor(F.unix_micros("created_at") / 86_400_000_000), F.lit(1 << 40))
    return bucketed_rank(kept, ["project_id"], day, [F.col("created_at").desc_nulls_last(), F.col("doc_id")], "place").select("project_id", "doc_id", "place")


def thread_states(log: DataFrame) -> DataFrame:
    """(thread_id, messages, recency, summary, prompt_tokens); log: (thread_id, op, value, seq).

    op: create, append, rename, summary, metrics. Only creating and appending move a thread up; a rename, a summary and
    the figures of a prompt leave its recency.
    """
    op = F.col("op")
    a = log.groupBy("thread_id").agg(F.sum((op == "append").cast("long")).alias("messages"), _at(op.isin("create", "append")).alias("moved"), _last("value", op == "summary").alias("summary"), _last("value", op == "metrics").alias("prompt_tokens"))
    return a.select("thread_id", "messages", F.col("moved").alias("recency"), "summary", "prompt_tokens")


def recency_order(states: DataFrame, span: int = 1_024) -> DataFrame:
    """Adds ``order``: the place by recency from 1, gap-free over all threads, by buckets of the sequence."""
    r = bucketed_rank(states.filter("recency IS NOT NULL").withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col("recency") / span), [F.col("recency"), F.col("thread_id")], "order")
    return r.withColumn("order", F.col("order") + 1).drop("__all")


def next_positions(turns: DataFrame) -> DataFrame:
    """(thread_id, messages, next_position)."""
    return turns.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), (F.max("position") + 1).alias("next_position"))


def position_range(turns: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """(thread_id, position) from ``low`` to ``high``, both included, the first ``most`` of them; an inverted range is empty."""
    w = Window.partitionBy("thread_id").orderBy("position")
    return turns.filter(F.col("position").between(low, high)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("thread_id", "position")


def conversation_window(messages: DataFrame, most: int) -> DataFrame:
    """(thread_id, position): the newest ``most`` messages, and the first one where it is cut off."""
    new = history.newest(messages, most).select("thread_id", "position")
    first = history.turns(messages).groupBy("thread_id").agg(F.min("position").alias("position"))
    return new.unionByName(first).distinct()


def preflight(messages: DataFrame, floor: int, cap: int, budget: int, refill: float) -> DataFrame:
    """(thread_id, position, boundary, replanned): the window; planned anew with a share of the budget where something must fold.

    Folding on every turn would be wasted: once a summary has to reach over messages, room for the next turns is made.
    """
    plan = history.history_window(messages, floor, cap, budget)
    must = plan.filter("boundary > 0").select("thread_id").distinct()
    again = history.history_window(messages.join(must, "thread_id", "left_semi"), floor, cap, int(budget * refill)).withColumn("replanned", F.lit(True))
    return plan.join(must, "thread_id", "left_anti").withColumn("replanned", F.lit(False)).unionByName(again)


def compaction(messages: DataFrame, most: int, chars: int, folds: int) -> DataFrame:
    """(thread_id, folds, through): how far at most ``folds`` folds reach, each of the next messages while both limits hold.

    A fold takes its first message always. A thread streams through; its state is the open fold.
    """
    rows = history.turns(messages).select("thread_id", "position", F.coalesce(F.length("content"), F.lit(0)).alias("size"))

    def step(state: list, row: tuple) -> list[tuple]:
        position, size = row
        done, count, used, through = state
        if count == 0 or count >= most or used + size > chars:
            done, count, used = done + 1, 0, 0
        if done <= folds:
            through = position
        state[:] = [done, count + 1, used + size, through]
        return []

    return fold_streams(rows, ["thread_id"], ["position"], lambda: [0, 0, 0, None], step, lambda s: [(min(s[0], folds), s[3])], ["position", "size"], "thread_id string, folds int, through int")


def credited(items: DataFrame, used: DataFrame) -> DataFrame:
    """(thread_id, item, used): summary items with the number of answers that named them added."""
    n = used.groupBy("thread_id", "item").agg(F.count(F.lit(1)).alias("__n"))
    return items.join(n, ["thread_id", "item"], "left").select("thread_id", "item", (F.col("used") + F.coalesce("__n", F.lit(0))).alias("used"))


def share_fork(messages: DataFrame, shares: DataFrame) -> DataFrame:
    """(share_id, position, new_position, role, content): what a share shows, numbered from 1, without project and citations.

    shares: (share_id, thread_id, through): messages up to ``through``.
    """
    rows = history.turns(messages).join(shares, "thread_id").filter(F.col("position") <= F.col("through"))
    r = bucketed_rank(rows, ["share_id"], F.floor(F.col("position") / 1_024), [F.col("position")], "n")
    return r.select("share_id", "position", (F.col("n") + 1).alias("new_position"), "role", "content")


def recipients(invites: DataFrame) -> DataFrame:
    """(share_id, emails): the invited addresses in the order of their first invitation, each once, less the removed ones.

    invites: (share_id, email, op, seq); a share has few recipients.
    """
    e = invites.withColumn("email", T.email(F.col("email"))).groupBy("share_id", "email").agg(F.min(F.when(F.col("op") == "invite", F.col("seq"))).alias("first"), F.max_by("op", "seq").alias("last"))
    kept = e.filter("last = 'invite'")
    return kept.groupBy("share_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "email"))), lambda x: x["email"]).alias("emails"))


def audit(memories: DataFrame) -> DataFrame:
    """(memory_id, seq, op, at): the life of each memory in order: created, updated, superseded, deleted."""
    when = lambda op, at, ok: F.when(ok, F.struct(F.lit(op).alias("op"), F.col(at).alias("at")))
    told = F.array_compact(
        F.array(
            when("created", "created_at", F.col("created_at").isNotNull()),
            when("updated", "updated_at", F.col("updated_at") > F.col("created_at")),
            when("superseded", "updated_at", F.col("superseded_by").isNotNull() & F.col("updated_at").isNotNull()),
            when("deleted", "deleted_at", F.col("deleted_at").isNotNull()),
        )
    )
    return memories.select("memory_id", F.posexplode(told).alias("p", "e")).select("memory_id", (F.col("p") + 1).alias("seq"), "e.op", "e.at")


def recalled(memories: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, memory_id): the live memories of the user, of the thread and of the project that a conversation sees.

    contexts: (context, owner_user_id, thread_id, project_id).
    """
    live = memories.filter("deleted_at IS NULL").select("memory_id", "owner_user_id", "scope", F.col("thread_id").alias("__t"), F.col("project_id").alias("__p")).distinct()
    j = live.join(contexts, "owner_user_id")
    seen = (F.col("scope") == "user") | ((F.col("scope") == "thread") & (F.col("__t") == F.col("thread_id"))) | ((F.col("scope") == "project") & (F.col("__p") == F.col("project_id")))
    return j.filter(seen).select("context", "memory_id").distinct()


def memory_page(memories: DataFrame, offset: int, limit: int) -> DataFrame:
    """(owner_user_id, memory_id, place): one page of each owner's live memories, last updated first. The limit is the feature."""
    live = memories.filter("deleted_at IS NULL").select("owner_user_id", "memory_id", "updated_at").distinct()
    r = bucketed_rank(live, ["owner_user_id"], F.coalesce(-F.floor(F.unix_micros("updated_at") / 86_400_000_000), F.lit(1 << 40)), [F.col("updated_at").desc_nulls_last(), F.col("memory_id")], "place")
    return r.filter((F.col("place") >= offset) & (F.col("place") < offset + limit)).select("owner_user_id", "memory_id", "place")


def write_or_propose(candidates: DataFrame, held: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(candidate, written): candidates in order are written while their scope has room; the rest become proposals.

    candidates: (candidate, owner_user_id, scope, target, seq); held: (owner_user_id, scope, target, n).
    """
    keys = ["owner_user_id", "scope", "target"]
    cap = F.when(F.col("scope") == "thread", caps["thread"]).when(F.col("scope") == "project", caps["project"]).otherwise(caps["user"])
    r = bucketed_rank(candidates, keys, F.floor(F.col("seq") / 86_400_000_000), [F.col("seq"), F.col("candidate")], "n0").join(held, keys, "left")
    return r.select("candidate", (F.col("n0") + F.coalesce("n", F.lit(0)) < cap).alias("written"))


def promoted(memories: DataFrame, threshold: int) -> DataFrame:
    """(owner_user_id, key, memory_id): for keys live in enough threads, the newest memory moves to the user's scope."""
    m = memories.filter("deleted_at IS NULL AND scope = 'thread' AND thread_id IS NOT NULL")
    a = m.groupBy("owner_user_id", "key").agg(F.countDistinct("thread_id").alias("n"), F.max_by("memory_id", F.struct("created_at", "memory_id")).alias("memory_id"))
    return a.filter(F.col("n") >= threshold).select("owner_user_id", "key", "memory_id")


def latest_user(rows: DataFrame, email: str, user: str, at: str) -> DataFrame:
    """(email, user): the user of an address who was there last; those never there come last, ties by id."""
    e = rows.filter(F.col(email).isNotNull()).groupBy(T.email(F.col(email)).alias("email"), F.col(user).alias("user")).agg(F.max(at).alias("at"))
    return e.groupBy("email").agg(F.min_by("user", F.struct(F.col("at").isNull(), -F.unix_micros("at"), F.col("user"))).alias("user"))


def shown(rows: DataFrame, name: str, part: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows whose name holds a text, in an order. The limit is the feature."""
    return rows.filter(F.contains(F.lower(F.col(name)), F.lit(part.lower()))).orderBy(*order).limit(most)


def administrators(users: DataFrame, configured: DataFrame, granted: DataFrame) -> DataFrame:
    """The users with a verified address that is configured or granted."""
    known = configured.select(T.email(F.col("email")).alias("email")).unionByName(granted.select(T.email(F.col("email")).alias("email"))).distinct()
    return users.filter("verified").withColumn("email", T.email(F.col("email"))).join(known, "email", "left_semi")


def claimed_usage(usage: DataFrame, mapping: DataFrame, amounts: list[str]) -> DataFrame:
    """Usage after accounts are claimed: rows of old owners are added to those of the new ones; mapping: (old, new)."""
    from .relational import reassign

    return reassign(usage, "owner_user_id", mapping).groupBy("owner_user_id").agg(*[F.sum(a).alias(a) for a in amounts])


def resolved(rows: DataFrame, catalog: DataFrame, column: str, default: str) -> DataFrame:
    """Adds the catalog's columns for a model id, those of the default where the id is null or unknown; the catalog has few rows."""
    known = catalog.select(F.col("model_id").alias("__id")).distinct().withColumn("__k", F.lit(True))
    j = rows.join(known, F.col(column) == F.col("__id"), "left").withColumn("model_id", F.when(F.col("__k"), F.col(column)).otherwise(F.lit(default))).drop("__id", "__k")
    return j.join(catalog, "model_id")
