"""Queries on stored state, prompts and replies with their SQL. Logs that the test data lacks are read off its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import table
from ..functions import text as T
from ..operators import history, prompts, relational, store
from . import sqltext as S
from .queries import _LIVE, _TURNS, AS_OF, _as_of, query

# Events as logs: the user is the key, the kind of event the operation.
_FILE_OPS = {"signup": "insert", "view": "restore", "click": "trash", "purchase": "delete", "error": "rename"}
_THREAD_OPS = {"signup": "create", "view": "append", "click": "summary", "purchase": "metrics", "error": "rename"}


def _ops(spark, d, names: dict[str, str], key: str):
    op = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias(key), op.alias("op"), F.col("value").cast("string").alias("name"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))


@query(
    "file_states",
    """WITH a AS (SELECT user_id AS file_id, max(CASE WHEN event_type = 'signup' THEN event_id END) AS i, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS d, max(CASE WHEN event_type = 'click' THEN event_id END) AS t, max(CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN event_id END) AS r,
    arg_max(event_id, CASE WHEN event_type IN ('signup', 'error') THEN event_id END) AS named, count(CASE WHEN event_type = 'signup' THEN 1 END) AS versions FROM events GROUP BY 1) SELECT file_id, named, coalesce(t > r, false) AS trashed, versions::BIGINT AS versions FROM a WHERE i IS NOT NULL AND (d IS NULL OR i > d)""",
)
def file_states(spark, d):
    log = _ops(spark, d, _FILE_OPS, "file_id").withColumn("name", F.col("seq"))
    return store.file_states(log).withColumnRenamed("name", "named")


@query("delete_policies", "SELECT doc_id, CASE WHEN lang = 'es' OR source IS NULL THEN 'purge' WHEN n_chars < 500 THEN 'purge' ELSE 'trash' END AS action FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, n_chars FROM documents)")
def delete_policies(spark, d):
    return table(spark, d, "documents").select("doc_id", store.delete_policy(F.coalesce("lang", F.lit("")) == "es", F.col("source").isNotNull(), F.col("n_chars") < 500).alias("action"))


@query("file_list", "SELECT project_id, doc_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, doc_id) - 1 AS place FROM documents WHERE (lang IS NOT NULL OR created_at IS NULL) AND project_id IS NOT NULL")
def file_list(spark, d):
    f = table(spark, d, "documents").filter("project_id IS NOT NULL").select("project_id", "doc_id", "created_at", F.when(F.col("lang").isNull(), F.col("created_at")).alias("trashed_at"))
    return store.file_list(f, False).select("project_id", "doc_id", F.col("place").cast("long").alias("place"))


@query("upload_counts", f"WITH u AS (SELECT project_id, sha256(text) AS h, count(*) AS n FROM documents WHERE project_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT project_id, CASE WHEN k = 1 THEN 'indexed' ELSE 'duplicate' END AS outcome, sum(CASE WHEN k = 1 THEN 1 ELSE n - 1 END)::BIGINT AS n FROM u, (VALUES (1), (2)) v(k) WHERE k = 1 OR n > 1 GROUP BY 1, 2")
def upload_counts(spark, d):
    """Outcomes of a batch of uploads: the first of equal contents is indexed, the others are duplicates."""
    u = table(spark, d, "documents").filter("project_id IS NOT NULL AND text IS NOT NULL").groupBy("project_id", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    both = u.select("project_id", F.explode(F.array(F.struct(F.lit("indexed").alias("outcome"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - 1).alias("n")))).alias("o"))
    return both.filter("o.n > 0").groupBy("project_id", "o.outcome").agg(F.sum("o.n").alias("n"))


_STATES = """s AS (SELECT user_id AS thread_id, count(CASE WHEN event_type = 'view' THEN 1 END)::BIGINT AS messages, max(CASE WHEN event_type IN ('signup', 'view') THEN event_id END) AS recency, max(CASE WHEN event_type = 'click' THEN event_id END) AS summary, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS prompt_tokens FROM events GROUP BY 1)"""


def _thread_log(spark, d):
    return _ops(spark, d, _THREAD_OPS, "thread_id").withColumn("value", F.col("seq"))


@query("thread_states", f"WITH {_STATES} SELECT * FROM s")
def thread_states(spark, d):
    return store.thread_states(_thread_log(spark, d))


@query("thread_recency", f'WITH {_STATES} SELECT thread_id, row_number() OVER (ORDER BY recency, thread_id) AS "order" FROM s WHERE recency IS NOT NULL')
def thread_recency(spark, d):
    return store.recency_order(store.thread_states(_thread_log(spark, d))).select("thread_id", F.col("order").cast("long").alias("order"))


@query("recent_threads", f"WITH {_STATES} SELECT thread_id, recency FROM s ORDER BY recency DESC NULLS LAST, thread_id LIMIT 20")
def recent_threads(spark, d):
    """The twenty threads that moved last. The limit is the feature."""
    return store.thread_states(_thread_log(spark, d)).orderBy(F.col("recency").desc_nulls_last(), "thread_id").limit(20).select("thread_id", "recency")


@query("next_positions", f"WITH {_TURNS} SELECT thread_id, count(*)::BIGINT AS messages, (max(position) + 1)::BIGINT AS next_position FROM tt GROUP BY 1")
def next_positions(spark, d):
    return store.next_positions(history.turns(table(spark, d, "thread_messages"))).select("thread_id", "messages", F.col("next_position").cast("long").alias("next_position"))


@query("position_ranges", f"WITH {_TURNS} SELECT thread_id, position FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY position) AS n FROM tt WHERE position BETWEEN 3 AND 9) WHERE n <= 4")
def position_ranges(spark, d):
    return store.position_range(history.turns(table(spark, d, "thread_messages")), 3, 9, 4)


@query("conversation_windows", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt) SELECT thread_id, position FROM r WHERE rn <= 6 UNION SELECT thread_id, min(position) FROM tt GROUP BY 1")
def conversation_windows(spark, d):
    return store.conversation_window(table(spark, d, "thread_messages"), 6)


def _plan(name: str, budget: int, of: str) -> str:
    return f"""{name}o AS (SELECT thread_id, min(position) AS first, arg_min(size, position) AS spent, max(position) AS last FROM {of} GROUP BY 1), {name}m AS (SELECT t.*, spent, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM {of} t JOIN {name}o USING (thread_id) WHERE position > first),
    {name}c AS (SELECT *, spent + sum(size) OVER (PARTITION BY thread_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM {name}m), {name}k AS (SELECT thread_id, position FROM {name}c WHERE rn <= 2 OR (rn <= 6 AND cum <= {budget})), {name}x AS (SELECT thread_id, min(position) AS oldest FROM {name}k GROUP BY 1),
    {name}b AS (SELECT thread_id, first, CASE WHEN first = last THEN 0 ELSE coalesce(oldest - 1, last) END AS b FROM {name}o LEFT JOIN {name}x USING (thread_id)), {name}e AS (SELECT thread_id, first, CASE WHEN b > first THEN b ELSE 0 END::INTEGER AS boundary FROM {name}b),
    {name}p AS (SELECT thread_id, position, boundary FROM (SELECT * FROM {name}k UNION ALL SELECT thread_id, first FROM {name}o) JOIN {name}e USING (thread_id))"""


@query(
    "preflight_windows",
    f"WITH {_TURNS}, {_plan('a', 900, 'tt')}, must AS (SELECT DISTINCT thread_id FROM ap WHERE boundary > 0), t2 AS (SELECT * FROM tt SEMI JOIN must USING (thread_id)), {_plan('z', 630, 't2')} SELECT thread_id, position, boundary, false AS replanned FROM ap ANTI JOIN must USING (thread_id) UNION ALL SELECT thread_id, position, boundary, true FROM zp",
)
def preflight_windows(spark, d):
    return store.preflight(table(spark, d, "thread_messages"), 2, 6, 900, 0.7)


@query(
    "manual_compaction",
    f"""WITH RECURSIVE {_TURNS}, r AS (SELECT thread_id, position, size, row_number() OVER (PARTITION BY thread_id ORDER BY position) AS rn FROM tt),
    w AS (SELECT thread_id, 0::BIGINT AS rn, 0 AS folds, 0 AS n, 0::BIGINT AS used, NULL::INTEGER AS through FROM (SELECT DISTINCT thread_id FROM r)
    UNION ALL SELECT r.thread_id, r.rn, CASE WHEN o THEN folds + 1 ELSE folds END, CASE WHEN o THEN 1 ELSE n + 1 END, CASE WHEN o THEN size ELSE used + size END, CASE WHEN (CASE WHEN o THEN folds + 1 ELSE folds END) <= 3 THEN r.position ELSE through END
    FROM (SELECT r.*, w.folds, w.n, w.used, w.through, w.n = 0 OR w.n >= 3 OR w.used + r.size > 600 AS o FROM w JOIN r ON r.thread_id = w.thread_id AND r.rn = w.rn + 1) r)
    SELECT thread_id, least(max(folds), 3)::INTEGER AS folds, arg_max(through, rn)::INTEGER AS through FROM w WHERE rn > 0 GROUP BY 1""",
)
def manual_compaction(spark, d):
    return store.compaction(table(spark, d, "thread_messages"), 3, 600, 3)


@query("summary_credit", f"WITH u AS (SELECT thread_id, item, count(*) AS n FROM (SELECT thread_id, unnest(list_distinct(list_filter(list_transform(string_split(regexp_extract(content, {S.quoted(T.USED)}, 1), ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^s\\d+$')))) AS item FROM (SELECT DISTINCT thread_id, message_id, content FROM thread_messages WHERE content IS NOT NULL)) GROUP BY 1, 2), i AS (SELECT thread_id, item FROM (SELECT DISTINCT thread_id FROM thread_messages), (VALUES ('s1'), ('s2'), ('s3')) v(item)) SELECT thread_id, item, (2 + coalesce(n, 0))::BIGINT AS used FROM i LEFT JOIN u USING (thread_id, item)")
def summary_credit(spark, d):
    """Items s1 to s3 of every thread begin with two uses."""
    m = table(spark, d, "thread_messages")
    items = m.select("thread_id").distinct().select("thread_id", F.explode(F.array(*map(F.lit, ("s1", "s2", "s3")))).alias("item"), F.lit(2).cast("long").alias("used"))
    used = m.filter("content IS NOT NULL").select("thread_id", "message_id", "content").distinct().select("thread_id", F.explode(T.used_ids(F.col("content"))).alias("item"))
    return store.credited(items, used)


_SHARES = "sh AS (SELECT report_id AS share_id, any_value(thread_id) AS thread_id, max(message_position) AS through FROM message_reports WHERE message_position IS NOT NULL GROUP BY 1)"


def _shares(spark, d):
    return table(spark, d, "message_reports").filter("message_position IS NOT NULL").groupBy(F.col("report_id").alias("share_id")).agg(F.first("thread_id").alias("thread_id"), F.max("message_position").alias("through"))


@query("share_forks", f"WITH {_TURNS}, {_SHARES} SELECT share_id, position, row_number() OVER (PARTITION BY share_id ORDER BY position)::BIGINT AS new_position, role, md5(content) AS digest FROM sh JOIN tt USING (thread_id) WHERE position <= through")
def share_forks(spark, d):
    """Reports stand for shares: what one shows ends at its position."""
    return store.share_fork(table(spark, d, "thread_messages"), _shares(spark, d)).select("share_id", "position", F.col("new_position").cast("long").alias("new_position"), "role", F.md5("content").alias("digest"))


@query("share_recipients", f"WITH i AS (SELECT owner_user_id AS share_id, {S.folded(S.trimmed('resolved_by'))} AS email, CASE WHEN reason = 'other' THEN 'remove' ELSE 'invite' END AS op, min(created_at) AS seq, report_id FROM message_reports WHERE resolved_by IS NOT NULL GROUP BY 1, 2, 3, 5), e AS (SELECT share_id, email, min(CASE WHEN op = 'invite' THEN seq END) AS first, arg_max(op, struct_pack(s := seq, r := report_id)) AS last FROM i GROUP BY 1, 2) SELECT share_id, string_agg(email, ',' ORDER BY first, email) AS emails FROM e WHERE last = 'invite' GROUP BY 1")
def share_recipients(spark, d):
    r = table(spark, d, "message_reports").filter("resolved_by IS NOT NULL")
    invites = r.select(F.col("owner_user_id").alias("share_id"), F.col("resolved_by").alias("email"), F.when(F.col("reason") == "other", "remove").otherwise("invite").alias("op"), F.struct(F.col("created_at").alias("s"), F.col("report_id").alias("r")).alias("seq")).distinct()
    return store.recipients(invites).select("share_id", F.array_join("emails", ",").alias("emails"))


@query("user_messages", f"WITH {_TURNS}, o AS (SELECT DISTINCT thread_id, owner_user_id FROM message_reports) SELECT owner_user_id, count(*)::BIGINT AS n FROM tt JOIN o USING (thread_id) WHERE role = 'user' GROUP BY 1")
def user_messages(spark, d):
    o = table(spark, d, "message_reports").select("thread_id", "owner_user_id").distinct()
    return history.turns(table(spark, d, "thread_messages")).filter("role = 'user'").join(o, "thread_id").groupBy("owner_user_id").agg(F.count(F.lit(1)).alias("n"))


@query("memory_audit", "WITH m AS (SELECT DISTINCT memory_id, created_at, updated_at, superseded_by, deleted_at FROM memories), e AS (SELECT memory_id, 1 AS o, 'created' AS op, created_at AS t FROM m WHERE created_at IS NOT NULL UNION ALL SELECT memory_id, 2, 'updated', updated_at FROM m WHERE updated_at > created_at UNION ALL SELECT memory_id, 3, 'superseded', updated_at FROM m WHERE superseded_by IS NOT NULL AND updated_at IS NOT NULL UNION ALL SELECT memory_id, 4, 'deleted', deleted_at FROM m WHERE deleted_at IS NOT NULL) SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY o)::INTEGER AS seq, op, epoch_us(t) AS at_us FROM e")
def memory_audit(spark, d):
    m = table(spark, d, "memories").select("memory_id", "created_at", "updated_at", "superseded_by", "deleted_at").distinct()
    return store.audit(m).select("memory_id", "seq", "op", F.unix_micros("at").alias("at_us"))


@query("memory_recall", "WITH c AS (SELECT owner_user_id || '/' || thread_id AS context, owner_user_id, thread_id, min(project_id) AS project_id FROM (SELECT DISTINCT r.owner_user_id, r.thread_id, m.project_id FROM message_reports r LEFT JOIN memories m ON m.owner_user_id = r.owner_user_id) GROUP BY 1, 2, 3) SELECT DISTINCT context, memory_id FROM c JOIN memories m USING (owner_user_id) WHERE m.deleted_at IS NULL AND (m.scope = 'user' OR (m.scope = 'thread' AND m.thread_id = c.thread_id) OR (m.scope = 'project' AND m.project_id = c.project_id))")
def memory_recall(spark, d):
    """A context for each reported thread: its owner, and the owner's first project."""
    r = table(spark, d, "message_reports").select("owner_user_id", "thread_id").distinct()
    first = table(spark, d, "memories").groupBy("owner_user_id").agg(F.min("project_id").alias("project_id"))
    return store.recalled(table(spark, d, "memories"), r.join(first, "owner_user_id", "left").withColumn("context", F.concat_ws("/", "owner_user_id", "thread_id")))


@query("memory_page", "SELECT owner_user_id, memory_id, place FROM (SELECT owner_user_id, memory_id, row_number() OVER (PARTITION BY owner_user_id ORDER BY updated_at DESC NULLS LAST, memory_id) - 1 AS place FROM (SELECT DISTINCT owner_user_id, memory_id, updated_at FROM memories WHERE deleted_at IS NULL)) WHERE place BETWEEN 5 AND 14")
def memory_page(spark, d):
    """The page from place 5 to 14 of each owner."""
    return store.memory_page(table(spark, d, "memories"), 5, 10).select("owner_user_id", "memory_id", F.col("place").cast("long").alias("place"))


@query("memory_proposals", f"WITH {_LIVE}, h AS (SELECT owner_user_id, scope, target, count(*) AS n FROM live GROUP BY 1, 2, 3), c AS (SELECT memory_id AS candidate, owner_user_id, scope, coalesce(CASE WHEN scope = 'thread' THEN thread_id WHEN scope = 'project' THEN project_id ELSE '' END, '') AS target, epoch_us(created_at) AS seq FROM (SELECT DISTINCT memory_id, owner_user_id, scope, thread_id, project_id, created_at FROM memories WHERE deleted_at IS NOT NULL)) SELECT candidate, row_number() OVER (PARTITION BY owner_user_id, scope, target ORDER BY seq, candidate) - 1 + coalesce(n, 0) < CASE scope WHEN 'thread' THEN 2 WHEN 'project' THEN 6 ELSE 12 END AS written FROM c LEFT JOIN h USING (owner_user_id, scope, target)")
def memory_proposals(spark, d):
    """Deleted memories come as candidates again; scopes are full early."""
    m = table(spark, d, "memories")
    held = history.live_memories(m).groupBy("owner_user_id", "scope", "target").agg(F.count(F.lit(1)).alias("n"))
    again = m.filter("deleted_at IS NOT NULL").select(F.col("memory_id").alias("candidate"), "owner_user_id", "scope", F.coalesce(history.target(), F.lit("")).alias("target"), F.unix_micros("created_at").alias("seq")).distinct()
    return store.write_or_propose(again, held, {"thread": 2, "project": 6, "user": 12})


@query("memory_promotions", "WITH m AS (SELECT DISTINCT owner_user_id, key, thread_id, memory_id, created_at FROM memories WHERE deleted_at IS NULL AND scope = 'thread' AND thread_id IS NOT NULL) SELECT owner_user_id, key, arg_max(memory_id, struct_pack(a := created_at, b := memory_id)) AS memory_id FROM m GROUP BY 1, 2 HAVING count(DISTINCT thread_id) >= 2")
def memory_promotions(spark, d):
    return store.promoted(table(spark, d, "memories"), 2)


@query("latest_users", f"WITH e AS (SELECT {S.folded(S.trimmed('resolved_by'))} AS email, owner_user_id AS user, max(resolved_at) AS t FROM message_reports WHERE resolved_by IS NOT NULL GROUP BY 1, 2) SELECT email, user FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY t DESC NULLS LAST, user) AS n FROM e) WHERE n = 1")
def latest_users(spark, d):
    return store.latest_user(table(spark, d, "message_reports"), "resolved_by", "owner_user_id", "resolved_at")


@query("thread_list", f"WITH s AS (SELECT thread_id, max(created_at) AS t, count(*) AS n FROM thread_messages GROUP BY 1) SELECT thread_id, CASE WHEN r.thread_id IS NOT NULL THEN 'project' ELSE 'chat' END AS type FROM s LEFT JOIN (SELECT DISTINCT thread_id FROM memories WHERE thread_id IS NOT NULL) r USING (thread_id) WHERE t >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 90 DAY")
def thread_list(spark, d):
    """Threads active in the last 90 days; those that memories hang on stand for threads of projects."""
    s = table(spark, d, "thread_messages").groupBy("thread_id").agg(F.max("created_at").alias("t")).filter(F.col("t") >= _as_of() - F.expr("INTERVAL 90 DAYS"))
    r = table(spark, d, "memories").filter("thread_id IS NOT NULL").select("thread_id").distinct().withColumn("r", F.lit(True))
    return s.join(r, "thread_id", "left").select("thread_id", F.when(F.col("r"), "project").otherwise("chat").alias("type"))


@query("project_list", "SELECT project_id, count(*)::BIGINT AS n FROM documents WHERE contains(lower(project_id), '3') GROUP BY 1 ORDER BY max(created_at) DESC NULLS LAST, project_id LIMIT 10")
def project_list(spark, d):
    """Ten projects whose name holds a text, last updated first. The limit is the feature."""
    p = table(spark, d, "documents").filter("project_id IS NOT NULL").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("t"))
    return store.shown(p, "project_id", "3", [F.col("t").desc_nulls_last(), F.col("project_id")], 10).select("project_id", "n")


@query("library_list", "SELECT doc_id, 'upload' AS source FROM documents WHERE source IS NOT NULL AND contains(lower(coalesce(title, '')), 'req') UNION ALL SELECT doc_id, 'unknown' FROM documents WHERE source IS NULL AND contains(lower(coalesce(title, '')), 'req')")
def library_list(spark, d):
    f = table(spark, d, "documents").filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("req")))
    return f.filter("source IS NOT NULL").select("doc_id", F.lit("upload").alias("source")).unionByName(f.filter("source IS NULL").select("doc_id", F.lit("unknown").alias("source")))


@query("administrators", f"WITH u AS (SELECT owner_user_id, {S.folded(S.trimmed('resolved_by'))} AS email, bool_or(resolved_at IS NOT NULL) AS verified FROM message_reports WHERE resolved_by IS NOT NULL GROUP BY 1, 2) SELECT owner_user_id, email FROM u WHERE verified AND (email LIKE 'desk1@%' OR email LIKE 'desk2@%')")
def administrators(spark, d):
    r = table(spark, d, "message_reports").filter("resolved_by IS NOT NULL")
    users = r.groupBy("owner_user_id", T.email(F.col("resolved_by")).alias("email")).agg(F.bool_or(F.col("resolved_at").isNotNull()).alias("verified"))
    some = lambda name: r.filter(F.lower(F.trim("resolved_by")).startswith(name)).select(F.col("resolved_by").alias("email")).distinct()
    return store.administrators(users, some("desk1@"), some("desk2@")).select("owner_user_id", "email")


@query("claimed_usage", "WITH u AS (SELECT owner_user_id, count(DISTINCT memory_id) AS n, sum(DISTINCT length(coalesce(value, ''))) AS chars FROM memories GROUP BY 1), m AS (SELECT owner_user_id AS old, min(resolved_by) AS new FROM message_reports WHERE resolved_by IS NOT NULL GROUP BY 1) SELECT coalesce(m.new, u.owner_user_id) AS owner_user_id, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars FROM u LEFT JOIN m ON m.old = u.owner_user_id GROUP BY 1")
def claimed_usage(spark, d):
    u = table(spark, d, "memories").groupBy("owner_user_id").agg(F.countDistinct("memory_id").alias("n"), F.sum_distinct(F.length(F.coalesce("value", F.lit("")))).alias("chars"))
    m = table(spark, d, "message_reports").filter("resolved_by IS NOT NULL").groupBy(F.col("owner_user_id").alias("old")).agg(F.min("resolved_by").alias("new"))
    return store.claimed_usage(u, m, ["n", "chars"])


@query("model_specs", "SELECT source, CASE WHEN source IN ('wiki', 'manual') THEN source ELSE 'default' END AS model_id, CASE source WHEN 'wiki' THEN 8000 WHEN 'manual' THEN 32000 ELSE 16000 END::BIGINT AS context FROM (SELECT DISTINCT source FROM documents)")
def model_specs(spark, d):
    catalog = spark.createDataFrame([("wiki", 8_000), ("manual", 32_000), ("default", 16_000)], "model_id string, context long")
    return store.resolved(table(spark, d, "documents").select("source").distinct(), catalog, "source", "default").select("source", "model_id", "context")


@query("pinned_profiles", """SELECT project_id, '{"model":"' || coalesce(min(source), '') || '","n":' || count(*) || '}' AS profile FROM documents WHERE project_id IS NOT NULL GROUP BY 1""")
def pinned_profiles(spark, d):
    """A project's profile is pinned as JSON when it is made."""
    p = table(spark, d, "documents").filter("project_id IS NOT NULL").groupBy("project_id").agg(F.coalesce(F.min("source"), F.lit("")).alias("model"), F.count(F.lit(1)).alias("n"))
    return p.select("project_id", F.to_json(F.struct("model", "n")).alias("profile"))


# --- shares, members and projects by their operators ----------------------------------------------------------------------


@query("member_roles", "WITH l AS (SELECT o_custkey % 50 AS project_id, 'u' || o_orderkey % 200 || '@x' AS email, CASE WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END AS op, CASE WHEN o_totalprice > 150000 THEN 'editor' ELSE 'viewer' END AS role, o_orderkey AS seq FROM orders), m AS (SELECT project_id, email, arg_max(op, seq) AS op, arg_max(role, seq) AS role, min(seq) AS first FROM l GROUP BY 1, 2) SELECT project_id, email, role, first::BIGINT AS created_at FROM m WHERE op = 'add'")
def member_roles(spark, d):
    """Orders as a log of invitations: the last role stands, the first date, removals are applied."""
    o = table(spark, d, "orders")
    log = o.select((F.col("o_custkey") % 50).alias("project_id"), F.concat(F.lit(" U"), (F.col("o_orderkey") % 200).cast("string"), F.lit("@X ")).alias("email"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"), F.when(F.col("o_totalprice") > 150_000, "editor").otherwise("viewer").alias("role"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("long").alias("created_at"))
    return relational.members(log)


@query("share_states", "WITH l AS (SELECT user_id AS thread_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'share' WHEN 'view' THEN 'refresh' WHEN 'click' THEN 'access' WHEN 'purchase' THEN 'invite' ELSE 'revoke' END AS op FROM events), g AS (SELECT thread_id, max(seq) AS gone FROM l WHERE op = 'revoke' GROUP BY 1), v AS (SELECT l.* FROM l LEFT JOIN g USING (thread_id) WHERE gone IS NULL OR seq > gone) SELECT thread_id, min(CASE WHEN op = 'share' THEN seq END)::BIGINT AS share_id, arg_max(CASE WHEN op = 'invite' THEN 'invite' ELSE 'link' END, CASE WHEN op IN ('invite', 'access', 'share') THEN seq END) AS access, max(CASE WHEN op IN ('share', 'refresh') THEN seq END)::BIGINT AS through FROM v GROUP BY 1 HAVING count(CASE WHEN op = 'share' THEN 1 END) > 0")
def share_states(spark, d):
    names = {"signup": "share", "view": "refresh", "click": "access", "purchase": "invite", "error": "revoke"}
    log = _ops(spark, d, names, "thread_id").select("thread_id", "op", "seq", F.col("seq").cast("long").alias("share_id"), F.col("seq").cast("long").alias("through"), F.lit("link").alias("access"))
    return relational.share_state(log)


@query("user_profiles", "SELECT user_id AS owner_user_id, arg_max(event_id, CASE WHEN event_type = 'signup' THEN event_id END)::VARCHAR AS display_name, nullif(arg_max(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || event_id || '@x' END, CASE WHEN event_type = 'click' THEN event_id END), '') AS email FROM events GROUP BY 1")
def user_profiles(spark, d):
    """Null leaves a field as it is, blank clears it."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
    mail = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("U"), F.col("event_id").cast("string"), F.lit("@X"))))
    return relational.profile(e.select(F.col("user_id").alias("owner_user_id"), name.alias("display_name"), mail.alias("email"), F.col("event_id").alias("seq")))


@query("user_logins", "WITH l AS (SELECT user_id AS uid, event_id AS e, CASE WHEN event_type = 'click' THEN 'u' || event_id END AS email, event_type = 'error' AS c FROM events), a AS (SELECT uid, min(e) AS first_login, max(e) AS last_login, arg_max(email, CASE WHEN email IS NOT NULL THEN e END) AS m, max(CASE WHEN email IS NOT NULL THEN e END) AS mt, max(CASE WHEN c THEN e END) AS ct FROM l GROUP BY 1) SELECT uid, first_login, last_login, CASE WHEN ct IS NULL OR mt >= ct THEN m END AS email FROM a")
def user_logins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("email"), (F.col("event_type") == "error").alias("clear_email"))
    return relational.logins(e)


@query("memory_settings", "WITH s AS (SELECT owner_user_id, arg_max(reason <> 'privacy', struct_pack(a := created_at, b := report_id)) AS on FROM message_reports GROUP BY 1) SELECT m.owner_user_id, coalesce(s.on, true) AS memory_enabled FROM (SELECT DISTINCT owner_user_id FROM memories) m LEFT JOIN s USING (owner_user_id)".replace(" AS on ", " AS enabled ").replace("s.on", "s.enabled"))
def memory_settings(spark, d):
    """A report for privacy stands for switching memories off; users without a setting have the default."""
    r = table(spark, d, "message_reports").select("owner_user_id", (F.col("reason") != "privacy").alias("memory_enabled"), F.struct(F.col("created_at"), F.col("report_id")).alias("seq")).distinct()
    return relational.settings(table(spark, d, "memories"), r)


@query("settled_proposals", "WITH p AS (SELECT DISTINCT user_id AS proposal_id FROM events), a AS (SELECT user_id AS proposal_id, arg_min(CASE WHEN event_type = 'click' THEN 'confirm' ELSE 'dismiss' END, event_id) AS action FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT proposal_id, CASE WHEN action IS NULL THEN 'open' ELSE 'confirmed' END AS state FROM p LEFT JOIN a USING (proposal_id) WHERE action IS NULL OR action = 'confirm'")
def settled_proposals(spark, d):
    e = table(spark, d, "events")
    actions = e.filter("event_type IN ('click', 'error')").select(F.col("user_id").alias("proposal_id"), F.when(F.col("event_type") == "click", "confirm").otherwise("dismiss").alias("action"), F.col("event_id").alias("seq"))
    still, made = relational.proposals_settled(e.select(F.col("user_id").alias("proposal_id")).distinct(), actions)
    return still.withColumn("state", F.lit("open")).unionByName(made.withColumn("state", F.lit("confirmed")))


@query("purged_documents", "WITH f AS (SELECT doc_id AS file_id, sha256(text) AS content FROM documents WHERE text IS NOT NULL), g AS (SELECT file_id FROM f JOIN documents d ON d.doc_id = f.file_id WHERE lang IS NULL) SELECT DISTINCT content FROM f SEMI JOIN g USING (file_id) WHERE content NOT IN (SELECT content FROM f ANTI JOIN g USING (file_id))")
def purged_documents(spark, d):
    """Contents that lose their last file when those of no language go."""
    f = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("doc_id"), "lang")
    return relational.purge(f.drop("lang"), f.filter("lang IS NULL").select("file_id"))[1].withColumnRenamed("doc_id", "content")


@query("fresh_memories", f"WITH {_LIVE}, n AS (SELECT DISTINCT owner_user_id, key, {S.normalized('value')} AS v FROM live), c AS (SELECT owner_user_id, key, {S.normalized('value')} AS v, min(struct_pack(a := created_at, b := memory_id)) AS s FROM memories WHERE deleted_at IS NOT NULL GROUP BY 1, 2, 3) SELECT s.b AS memory_id FROM c ANTI JOIN n ON c.owner_user_id = n.owner_user_id AND c.key = n.key AND c.v = n.v")
def fresh_memories(spark, d):
    """Deleted memories come as candidates; what an owner holds already under its key is none."""
    m = table(spark, d, "memories")
    c = m.filter("deleted_at IS NOT NULL").select("owner_user_id", "key", "value", "memory_id", F.struct("created_at", "memory_id").alias("seq")).distinct()
    return relational.new_memories(c, history.live_memories(m)).select("memory_id")


# --- prompts and replies ----------------------------------------------------------------------------------------------


@query(
    "memory_sections",
    f"""WITH {_LIVE}, t AS (SELECT live.*, x.type FROM live JOIN (SELECT DISTINCT memory_id, type FROM memories) x USING (memory_id)), l AS (SELECT owner_user_id, type, '- ' || key || ': ' || coalesce(value, '') || CASE WHEN n <= 1 THEN '' ELSE ' (saved ' || n || ' days ago)' END AS line, row_number() OVER (PARTITION BY owner_user_id ORDER BY created_at DESC, memory_id) - 1 AS place
    FROM (SELECT *, floor((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 86400000000.0)::BIGINT AS n FROM t)), b AS (SELECT owner_user_id, string_agg(line, chr(10) ORDER BY line) FILTER (type = 'fact' AND place < 8) AS f, string_agg(line, chr(10) ORDER BY line) FILTER (type = 'preference' AND place < 8) AS p, sum(CASE WHEN place >= 8 THEN 1 ELSE 0 END) AS over FROM l GROUP BY 1)
    SELECT owner_user_id, md5(concat_ws(chr(10) || chr(10), 'Facts' || chr(10) || f, 'Preferences' || chr(10) || p, CASE WHEN over > 0 THEN over || ' more are not shown' END)) AS digest FROM b""",
)
def memory_sections(spark, d):
    from ..frames import bucketed_rank

    live = history.live_memories(table(spark, d, "memories"))
    line = prompts.memory_line(F.col("key"), F.coalesce("value", F.lit("")), T.age_phrase(prompts.last_relevant(F.col("last_used_at"), F.col("created_at")), _as_of()), F.lit(False))
    rows = bucketed_rank(live.withColumn("line", line), ["owner_user_id"], -F.floor(F.unix_micros("created_at") / 86_400_000_000), [F.desc("created_at"), F.col("memory_id")], "place")
    return prompts.memory_sections(rows, 8).select("owner_user_id", F.md5("section").alias("digest"))


_READ = "r AS (SELECT DISTINCT report_id, conversation FROM message_reports WHERE conversation LIKE '[%' AND json_valid(conversation))"


@query(
    "reply_operations",
    f"""WITH {_READ}, x AS (SELECT report_id, unnest(json_extract(conversation, '$[*]')) AS x, generate_subscripts(json_extract(conversation, '$[*]'), 1) AS p FROM r), o AS (SELECT report_id, p, json_extract_string(x, '$.role') AS kind, left({S.trimmed("json_extract_string(x, '$.content')")}, 160) AS text FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY p) AS n FROM o WHERE kind IN ('user', 'assistant') AND coalesce(text, '') <> '') SELECT report_id, n::INTEGER AS n, kind, md5(text) AS digest FROM k WHERE n <= 3""",
)
def reply_operations(spark, d):
    """Stored conversations as replies that are lists of objects: unknown kinds and blank texts are skipped, three are kept."""
    r = table(spark, d, "message_reports").filter("conversation LIKE '[%'").select("report_id", "conversation").distinct()
    ops = prompts.operations(F.col("conversation"), ["user", "assistant"], "role", "content", 3, 160)
    return r.select("report_id", F.posexplode(ops).alias("n", "o")).select("report_id", (F.col("n") + 1).alias("n"), "o.kind", F.md5("o.text").alias("digest"))


@query("reply_facts", "SELECT DISTINCT chunk_id, (SELECT string_agg(x, '|') FROM (SELECT unnest(list_filter(list_transform(section_path, lambda s: left(trim(s), 20)), lambda s: s <> '')[1:2]) AS x)) AS facts FROM chunks WHERE len(section_path) > 0")
def reply_facts(spark, d):
    """Section paths as JSON lists of facts, cut to twenty characters and two of them."""
    c = table(spark, d, "chunks").filter(F.size("section_path") > 0).select("chunk_id", F.to_json("section_path").alias("raw")).distinct()
    return c.select("chunk_id", F.array_join(prompts.facts(F.col("raw"), 2, 20), "|").alias("facts")).withColumn("facts", F.nullif("facts", F.lit("")))


@query("question_rewrites", "SELECT DISTINCT qid, CASE WHEN qid % 3 = 0 AND document IS NOT NULL AND trim(document) <> '' THEN trim(document) ELSE question END AS query, CASE WHEN qid % 3 = 0 THEN 2 ELSE 0 END AS n FROM requesta_items WHERE question IS NOT NULL")
def question_rewrites(spark, d):
    """Every third reply is a rewrite with candidates; the others are no JSON and leave the question as it is."""
    q = table(spark, d, "requesta_items").filter("question IS NOT NULL").select("qid", "question", "document").distinct()
    raw = F.when(F.col("qid") % 3 == 0, F.to_json(F.struct(F.col("document").alias("query"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("candidates")))).otherwise(F.lit("no rewrite"))
    r = prompts.rewrite(raw, F.col("question"))
    return q.select("qid", r.alias("r")).select("qid", "r.query", F.size("r.candidates").alias("n")).distinct()


@query("sse_frames", f"WITH {_TURNS} SELECT thread_id, role AS event, count(*)::BIGINT AS n, sum(position)::BIGINT AS total FROM tt WHERE role IN ('user', 'assistant') GROUP BY 1, 2")
def sse_frames(spark, d):
    """The turns of each thread as an event stream and back; a message is a frame, a ping without data is none."""
    t = history.turns(table(spark, d, "thread_messages")).filter("role IN ('user', 'assistant')")
    frame = F.concat(F.lit("event: "), "role", F.lit('\ndata: {"position": '), F.col("position").cast("string"), F.lit("}\n\nevent: ping"))
    f = t.select("thread_id", F.explode(prompts.sse_frames(frame)).alias("f"))
    return f.groupBy("thread_id", "f.event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("f.data", "$.position").cast("long")).alias("total"))


@query("token_calibration", f"WITH {_TURNS} SELECT thread_id, CASE WHEN sum(n) > 0 AND sum(size) > 0 AND count(*) % 2 = 0 THEN round(least(8.0, greatest(1.0, sum(size)::DOUBLE / sum(n))), 6) ELSE 4.0 END AS ratio, greatest(floor(8000 * 0.9)::BIGINT - sum(n)::BIGINT, 0) AS usable FROM (SELECT *, coalesce({S.n_tokens('content')}, 0) AS n FROM tt) GROUP BY 1")
def token_calibration(spark, d):
    """Characters of a token by thread (threads with an odd number of messages stand for another model), and the room left."""
    t = history.turns(table(spark, d, "thread_messages")).groupBy("thread_id").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"), F.sum(F.coalesce(T.n_tokens(F.col("content")), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("k"))
    return t.select("thread_id", F.round(prompts.chars_per_token(F.col("chars"), F.col("n"), F.col("k") % 2 == 0), 6).alias("ratio"), prompts.usable_tokens(F.lit(8_000), F.col("n")).alias("usable"))


@query("tool_checks", f"SELECT DISTINCT memory_id, CASE WHEN {S.memory_key('key')} = '' THEN 'invalid_key' WHEN {S.trimmed("coalesce(value, '')")} = '' THEN 'empty_value' WHEN length({S.trimmed("coalesce(value, '')")}) > 60 THEN 'too_long' WHEN coalesce(scope IN ('user', 'thread', 'project'), false) THEN 'ok' ELSE 'unknown_scope' END AS status FROM memories")
def tool_checks(spark, d):
    return table(spark, d, "memories").select("memory_id", prompts.tool_status(F.col("key"), F.col("value"), F.col("scope"), 60).alias("status")).distinct()


@query("ip_buckets", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '10.0.' || c_custkey % 200 || '.1' ELSE '2001:db8:0:' || format('{:x}', c_custkey % 200 + 1) || '::/64' END AS bucket FROM customer")
def ip_buckets(spark, d):
    """IPv6 addresses count by their /64 network."""
    n = (F.col("c_custkey") % 200).cast("string")
    address = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.0."), n, F.lit(".1"))).otherwise(F.concat(F.lit("2001:db8:0:"), F.lower(F.hex(F.col("c_custkey") % 200 + 1)), F.lit("::"), F.hex("c_custkey")))
    return prompts.hashed(table(spark, d, "customer").select("c_custkey", address.alias("address")), "address", "bucket", prompts.ip_bucket).select("c_custkey", "bucket")


@query("hashed_terms")
def hashed_terms(spark, d):
    """Terms of the leaves with their 32-bit ids; the hash is not to be had in SQL."""
    from .queries import leaves

    t = leaves(spark, d).select(F.explode(T.terms(F.col("source_text"))).alias("term")).distinct()
    return prompts.hashed(t, "term", "term_id", prompts.term_hash)


@query("recursive_summaries", f"WITH {_TURNS} SELECT thread_id, md5(right(string_agg(coalesce(content, ''), ' ' ORDER BY position), 400)) AS summary FROM tt GROUP BY 1")
def recursive_summaries(spark, d):
    """The one-paragraph baseline: each turn is added and the oldest text beyond 400 characters falls out.

    The end of a thread decides, so the newest turns are gathered only, up to the one that fills the paragraph.
    """
    from ..frames import bucketed_prefix

    t = history.turns(table(spark, d, "thread_messages")).withColumn("c", F.coalesce("content", F.lit("")))
    size = (F.length("c") + 1).cast("long")
    r = bucketed_prefix(t, ["thread_id"], -F.floor(F.col("position") / 1_024), [F.desc("position")], {"behind": size}).filter("behind < 401")
    joined = r.groupBy("thread_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "c"))), lambda x: x["c"]), " ").alias("s"))
    return joined.select("thread_id", F.md5(F.when(F.length("s") > 400, F.substring("s", -400, 400)).otherwise(F.col("s"))).alias("summary"))


@query("project_reassign", "WITH p AS (SELECT min(project_id) AS p FROM memories WHERE project_id IS NOT NULL) SELECT DISTINCT memory_id, CASE WHEN project_id = p THEN 'moved:' || owner_user_id ELSE owner_user_id END AS owner FROM memories, p")
def project_reassign(spark, d):
    """The rows of one project change hands; the owner's other rows stay."""
    m = table(spark, d, "memories").select("memory_id", "owner_user_id", "project_id").distinct()
    one = m.agg(F.min("project_id").alias("p")).first().p
    part = m.filter(F.col("project_id") == one)
    mapping = part.select(F.col("owner_user_id").alias("old"), F.concat(F.lit("moved:"), "owner_user_id").alias("new"))
    moved = relational.reassign(part, "owner_user_id", mapping)
    rest = m.filter(~F.coalesce(F.col("project_id") == one, F.lit(False)))
    return moved.unionByName(rest).select("memory_id", F.col("owner_user_id").alias("owner")).distinct()


@query("payload_codec", "SELECT DISTINCT chunk_id, doc_id, coalesce(domain, '') AS domain, coalesce(language, 'und') AS language, len(source_block_ids)::INTEGER AS n_blocks, citable FROM chunks")
def payload_codec(spark, d):
    """Chunks written as the JSON payload of an index and read again, with the defaults for what is missing."""
    c = table(spark, d, "chunks").select("chunk_id", F.to_json(F.struct("doc_id", "domain", "language", "source_block_ids", "citable")).alias("payload")).distinct()
    back = F.from_json("payload", "doc_id string, domain string, language string, source_block_ids array<string>, citable boolean")
    r = c.select("chunk_id", back.alias("r"))
    return r.select("chunk_id", "r.doc_id", F.coalesce("r.domain", F.lit("")).alias("domain"), F.coalesce("r.language", F.lit("und")).alias("language"), F.size("r.source_block_ids").alias("n_blocks"), "r.citable").distinct()
