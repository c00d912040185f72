"""Relational state: snapshots from change logs, membership, shares, files, administration, statistics.

A change log is a table of events in the order of a sequence column; a snapshot is what it leaves. Each transform takes
and gives tables, so that a batch of changes is one job. Keys and orders carry a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import bucketed_lag
from ..functions import text as T

ROLES = {"viewer": 1, "editor": 2, "owner": 3}
#: The legal steps of a file's status.
STEPS = [(None, "pending"), ("pending", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "processing"), ("completed", "processing")]
TRASH_DAYS = 7


def last_wins(log: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The last row of each key (upsert); ties of the order go to the greater tie column."""
    rank = F.struct(order, tie) if tie else F.struct(order)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def first_wins(log: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The first row of each key (idempotent grants, shares, resolutions)."""
    rank = F.struct(order, tie) if tie else F.struct(order)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put in place of those with their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows of the given keys; cascades are the same with the children's tables."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def reassign(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The table with owners moved by (old, new); owners that are not in the mapping stay. A mapping joins like any table."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("__new")).dropDuplicates([column])
    return table.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*table.columns)


def reparent(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Chunks with new parents (chunk_id, new_parent), without touching anything else."""
    m = moves.select("chunk_id", F.col("new_parent").alias("__p"), F.lit(True).alias("__m")).dropDuplicates(["chunk_id"])
    return table.join(m, "chunk_id", "left").withColumn("parent_id", F.when(F.col("__m"), F.col("__p")).otherwise(F.col("parent_id"))).select(*table.columns)


def profile(log: DataFrame) -> DataFrame:
    """(owner_user_id, display_name, email) from profile changes: null leaves as it is, blank clears."""
    said = lambda c: F.max_by(F.struct(F.nullif(F.trim(c), F.lit("")).alias("v")), F.when(F.col(c).isNotNull(), F.col("seq")))["v"]
    return log.groupBy("owner_user_id").agg(said("display_name").alias("display_name"), T.email(said("email")).alias("email"))


def logins(log: DataFrame) -> DataFrame:
    """(uid, first_login, last_login, email): the first login kept, the last moved, the last address unless cleared after."""
    cleared = F.max(F.when(F.col("clear_email"), F.col("at")))
    mail = F.max_by("email", F.when(F.col("email").isNotNull(), F.col("at")))
    mailed = F.max(F.when(F.col("email").isNotNull(), F.col("at")))
    a = log.groupBy("uid").agg(F.min("at").alias("first_login"), F.max("at").alias("last_login"), mail.alias("m"), mailed.alias("mt"), cleared.alias("ct"))
    return a.select("uid", "first_login", "last_login", F.when(F.col("ct").isNull() | (F.col("mt") >= F.col("ct")), F.col("m")).alias("email"))


def settings(users: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner_user_id, memory_enabled): stored settings with the default for users without any."""
    return users.select("owner_user_id").distinct().join(last_wins(stored, ["owner_user_id"], "seq"), "owner_user_id", "left").select("owner_user_id", F.coalesce("memory_enabled", F.lit(True)).alias("memory_enabled"))


def accumulate_usage(events: DataFrame, user: str, amounts: list[str]) -> DataFrame:
    """Sums of the amounts for each user; negative ones count as 0."""
    return events.groupBy(user).agg(*[F.sum(F.greatest(F.coalesce(a, F.lit(0)), F.lit(0))).alias(a) for a in amounts])


def members(log: DataFrame) -> DataFrame:
    """(project_id, email, role, created_at): the last role, the first date, removals applied; log: op add or remove."""
    last = F.max_by(F.struct("op", "role"), "seq")
    return log.withColumn("email", T.email(F.col("email"))).groupBy("project_id", "email").agg(last.alias("l"), F.min("created_at").alias("created_at")).filter("l.op = 'add'").select("project_id", "email", F.col("l.role").alias("role"), "created_at")


def effective_role(projects: DataFrame, member_rows: DataFrame, callers: DataFrame) -> DataFrame:
    """(project_id, caller, role): owner by user id, else the membership by address; null for none."""
    pairs = projects.select("project_id", "owner_user_id")
    own = callers.join(pairs, callers["caller"] == pairs["owner_user_id"]).select("project_id", "caller", F.lit("owner").alias("role"))
    held = callers.withColumn("email", T.email(F.col("email"))).join(member_rows.select("project_id", "email", "role"), "email").select("project_id", "caller", "role")
    return own.unionByName(held.join(own.select("project_id", "caller"), ["project_id", "caller"], "left_anti"))


def at_least(role: Column, needed: str) -> Column:
    rank = F.coalesce(F.create_map(*[x for r, n in ROLES.items() for x in (F.lit(r), F.lit(n))])[role], F.lit(0))
    return rank >= ROLES[needed]


def transfer(projects: DataFrame, member_rows: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, members) after ownership moves (project_id, new_owner, new_email, old_email, at): the old owner edits."""
    m = moves.dropDuplicates(["project_id"])
    owned = projects.join(m.select("project_id", "new_owner"), "project_id", "left").withColumn("owner_user_id", F.coalesce("new_owner", "owner_user_id")).select(*projects.columns)
    out = m.select("project_id", T.email(F.col("new_email")).alias("email")).unionByName(m.select("project_id", T.email(F.col("old_email")).alias("email")))
    kept = member_rows.join(out, ["project_id", "email"], "left_anti")
    return owned, kept.unionByName(m.select("project_id", T.email(F.col("old_email")).alias("email"), F.lit("editor").alias("role"), F.col("at").alias("created_at")).select(*kept.columns))


def listed_projects(projects: DataFrame, member_rows: DataFrame, user: str, address: str) -> DataFrame:
    """Projects that a user owns, and those shared with the address that are not their own."""
    own = projects.filter(F.col("owner_user_id") == user).withColumn("shared", F.lit(False))
    by = member_rows.filter(F.col("email") == T.email(F.lit(address))).select("project_id").distinct()
    return own.unionByName(projects.join(by, "project_id", "left_semi").filter(F.col("owner_user_id") != user).withColumn("shared", F.lit(True)))


def readable_shares(shares: DataFrame, recipients: DataFrame, address: str) -> DataFrame:
    """Shares that an address may read: open by link, or invited."""
    invited = recipients.filter(T.email(F.col("email")) == T.email(F.lit(address))).select("share_id").distinct().withColumn("__in", F.lit(True))
    return shares.join(invited, "share_id", "left").filter((F.col("access") == "link") | F.col("__in")).drop("__in")


def share_state(log: DataFrame) -> DataFrame:
    """(thread_id, share_id, access, through) from share events in order: share, refresh, access, invite, revoke.

    The first share since the last revocation gives the id; an invitation makes the share invite-only.
    """
    gone = log.filter("op = 'revoke'").groupBy("thread_id").agg(F.max("seq").alias("gone"))
    live = log.join(gone, "thread_id", "left").filter((F.col("seq") > F.col("gone")) | F.col("gone").isNull())
    access = F.when(F.col("op") == "invite", "invite").when(F.col("op").isin("access", "share"), F.coalesce("access", F.lit("link")))
    a = live.withColumn("__access", access).groupBy("thread_id").agg(
        F.min_by("share_id", F.when(F.col("op") == "share", F.col("seq"))).alias("share_id"),
        F.max_by("__access", F.when(F.col("__access").isNotNull(), F.col("seq"))).alias("access"),
        F.max_by("through", F.when(F.col("op").isin("share", "refresh"), F.col("seq"))).alias("through"),
    )
    return a.filter("share_id IS NOT NULL")


def status_steps(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The events with the status before and whether the step is legal; the first column of the order is a time."""
    legal = F.lit(False)
    for a, b in STEPS:
        legal = legal | ((F.col("before").isNull() if a is None else F.col("before").eqNullSafe(F.lit(a))) & (F.col(status) == b))
    return bucketed_lag(log, [key], F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / 86_400_000_000), order, status, "before").withColumn("legal", legal)


def upload_outcomes(uploads: DataFrame, files: DataFrame, now: Column, days: int = TRASH_DAYS) -> DataFrame:
    """(upload_id, outcome): duplicate, restored, purged_then_indexed or indexed, by the files of the project with its content.

    An active completed match wins, then one in the trash for at most ``days``, then an older one.
    """
    fresh = F.unix_micros(now) - F.unix_micros("trashed_at") <= days * 86_400_000_000
    state = F.when(F.col("trashed_at").isNull() & (F.col("status") == "completed"), 1).when(F.col("trashed_at").isNotNull() & fresh, 2).when(F.col("trashed_at").isNotNull(), 3).otherwise(4)
    best = files.withColumn("s", state).groupBy("project_id", "content_hash").agg(F.min("s").alias("s"))
    names = F.create_map(F.lit(1), F.lit("duplicate"), F.lit(2), F.lit("restored"), F.lit(3), F.lit("purged_then_indexed"), F.lit(4), F.lit("indexed"))
    return uploads.join(best, ["project_id", "content_hash"], "left").select("upload_id", names[F.coalesce("s", F.lit(4))].alias("outcome"))


def purge(files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files left, documents that lose their last file): the index of a document goes with its last reference only."""
    left = files.join(gone.select("file_id"), "file_id", "left_anti")
    docs = files.join(gone.select("file_id"), "file_id", "left_semi").select("doc_id").distinct()
    return left, docs.join(left.select("doc_id").distinct(), "doc_id", "left_anti")


def report_snapshot(messages: DataFrame, n: int) -> DataFrame:
    """(thread_id, conversation): the newest n messages of each thread as JSON, oldest first."""
    from .history import turns

    top = turns(messages).withColumn("rn", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("position")))).filter(F.col("rn") <= n)
    rows = top.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", F.coalesce("content", F.lit("")).alias("content")))).alias("m"))
    return rows.select("thread_id", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("conversation"))


def account_claim(tables: dict[str, tuple[DataFrame, str]], mapping: DataFrame) -> dict[str, DataFrame]:
    """Every table with the anonymous owners of the mapping (old, new) replaced."""
    return {name: reassign(df, column, mapping) for name, (df, column) in tables.items()}


def proposals_settled(proposals: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open proposals, confirmed ones): the first action on a proposal counts; confirming makes a memory, dismissing none."""
    first = first_wins(actions, ["proposal_id"], "seq")
    still = proposals.join(first, "proposal_id", "left_anti")
    made = proposals.join(first.filter("action = 'confirm'").select("proposal_id"), "proposal_id", "left_semi")
    return still, made


def new_memories(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates whose key and normalised value the owner does not hold yet; equal candidates count once."""
    have = live.select("owner_user_id", "key", T.normalized(F.col("value")).alias("n")).distinct()
    c = candidates.withColumn("n", T.normalized(F.col("value")))
    return first_wins(c.join(have, ["owner_user_id", "key", "n"], "left_anti"), ["owner_user_id", "key", "n"], "seq").drop("n")
