"""Queries on converted documents and on who may see what, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import table
from ..operators import answers, convert, relational, structure
from ..sources import corpora
from . import sqltext as S
from .queries import _RANKED, _blocks, query

_CB = "cb AS (SELECT DISTINCT doc_id, seq, page, coalesce(text, '') AS text, block_type, bbox, coalesce(furniture, false) AS furniture FROM converted_blocks)"


def _converted(spark, d):
    return table(spark, d, "converted_blocks").select("doc_id", "seq", "page", "text", "block_type", "bbox", "furniture").dropDuplicates(["doc_id", "seq"])


_DECK = "dk AS (SELECT doc_id, seq, page, CASE WHEN block_type IN ('figure', 'table') THEN 'Figure ' || length(text) % 2 ELSE text END AS text, CASE WHEN block_type = 'table' THEN 'figure' ELSE block_type END AS block_type, furniture FROM cb), rf AS (SELECT doc_id, text FROM dk WHERE block_type = 'figure' AND text <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)"


def _deck(spark, d):
    """Captions that repeat: the test data has none, so tables count as figures with one of two captions."""
    c = _converted(spark, d)
    figure = F.col("block_type").isin("figure", "table")
    text = F.coalesce("text", F.lit(""))
    return c.withColumn("text", F.when(figure, F.concat(F.lit("Figure "), (F.length(text) % 2).cast("string"))).otherwise(text)).withColumn("block_type", F.when(figure, "figure").otherwise(F.col("block_type")))


@query("repeated_figures", f"WITH {_CB}, {_DECK} SELECT doc_id, text FROM rf")
def repeated_figures(spark, d):
    return convert.repeated_figures(_deck(spark, d))


@query(
    "slide_blocks",
    f"""WITH {_CB}, {_DECK}, k AS (SELECT * FROM dk WHERE NOT furniture AND text <> '' AND NOT (block_type = 'figure' AND EXISTS (SELECT 1 FROM rf WHERE rf.doc_id = dk.doc_id AND rf.text = dk.text))), t AS (SELECT doc_id, page, min(CASE WHEN block_type = 'heading' THEN seq END) AS h FROM k GROUP BY 1, 2),
    s AS (SELECT t.doc_id, t.page, t.h, coalesce(k.text, 'Slide ' || t.page) AS section FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND k.seq = t.h), a AS (SELECT doc_id, page, -1 AS seq, 'slide' AS type, section AS text, section FROM s UNION ALL SELECT k.doc_id, k.page, k.seq, k.block_type, k.text, s.section FROM k JOIN s ON s.doc_id = k.doc_id AND s.page = k.page WHERE s.h IS NULL OR k.seq <> s.h)
    SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1)::INTEGER AS place, type, md5(text) AS digest, md5(section) AS section FROM a""",
)
def slide_blocks(spark, d):
    return convert.slide_blocks(_deck(spark, d)).select("doc_id", "page", "place", "type", F.md5("text").alias("digest"), F.md5("section").alias("section"))


@query("reading_order", f"WITH {_CB} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page, bbox[2] NULLS FIRST, bbox[1] NULLS FIRST, seq) - 1 AS block_order FROM cb")
def reading_order(spark, d):
    return convert.reading_order(_converted(spark, d), F.get("bbox", F.lit(0)), F.get("bbox", F.lit(1))).select("doc_id", "seq", F.col("block_order").cast("long").alias("block_order"))


@query("page_kinds", f"WITH {_CB} SELECT doc_id, page, sum(length(text)) >= 20 OR (sum(length(text)) > 0 AND count(CASE WHEN block_type = 'heading' THEN 1 END) > 0) AS digital FROM cb WHERE block_type IN ('heading', 'table') GROUP BY 1, 2")
def page_kinds(spark, d):
    """Headings stand for fonts, and only they and tables for text that needs no scan."""
    p = _converted(spark, d).filter("block_type IN ('heading', 'table')").groupBy("doc_id", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum((F.col("block_type") == "heading").cast("int")).alias("fonts"))
    return convert.page_kinds(p)


@query("converted_walk", f"WITH {_CB} SELECT doc_id, seq, page + 1 AS page, CASE WHEN block_type IN ('heading', 'figure', 'table') THEN block_type ELSE 'paragraph' END AS block_type, furniture FROM cb WHERE {S.trimmed('text')} <> '' AND len(bbox) = 4 AND seq <= 3")
def converted_walk(spark, d):
    """The first blocks of every file written as a converter's answer, with pages from 0, and walked again."""
    kind = F.when(F.col("furniture"), "PageHeader").when(F.col("block_type") == "heading", "SectionHeader").when(F.col("block_type") == "figure", "Picture").when(F.col("block_type") == "table", "Table").otherwise("Text")
    c = _converted(spark, d).filter("seq <= 3")
    leaf = F.struct("seq", F.struct(kind.alias("block_type"), "page", "text", "bbox").alias("leaf"))
    doc = c.groupBy("doc_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(leaf)), lambda x: x["leaf"]).alias("children"))).alias("payload"), F.sort_array(F.collect_list("seq")).alias("seqs"))
    seqs = doc.select("doc_id", F.posexplode("seqs").alias("p", "s"))
    w = convert.converted_blocks(doc).join(seqs, "doc_id").filter("seq = p")
    was = c.select("doc_id", F.col("seq").alias("s"), "block_type")
    out = w.drop("block_type").join(was, ["doc_id", "s"]).select("doc_id", F.col("s").alias("seq"), "page", F.when(F.col("block_type").isin("heading", "figure", "table"), F.col("block_type")).otherwise("paragraph").alias("block_type"), "furniture")
    return out


@query(
    "markdown_texts",
    f"""WITH r AS ({_RANKED}), p AS (SELECT *, CASE WHEN type = 'heading' THEN repeat('#', least(greatest(len(section_path), 1), 6)) || ' ' WHEN type = 'figure' AND media_ref IS NOT NULL THEN '![](' || media_ref || ')' || chr(10) || chr(10) WHEN type = 'list' THEN '- ' WHEN type = 'code' THEN '```' || chr(10) WHEN type = 'formula' THEN '$$' || chr(10) WHEN type = 'caption' THEN '*' WHEN type = 'speech_turn' THEN '> ' WHEN type = 'slide' THEN '## ' ELSE '' END AS prefix,
    CASE WHEN type = 'code' THEN chr(10) || '```' WHEN type = 'formula' THEN chr(10) || '$$' WHEN type = 'caption' THEN '*' ELSE '' END || chr(10) || chr(10) AS suffix FROM r WHERE {S.trimmed("coalesce(text, '')")} <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS k FROM p) SELECT doc_id, k // 64 AS part, md5(string_agg(prefix || text || suffix, '' ORDER BY k)) AS digest FROM n GROUP BY 1, 2""",
)
def markdown_texts(spark, d):
    return convert.markdown(_blocks(spark, d), 64).select("doc_id", F.col("part").cast("long").alias("part"), F.md5("text").alias("digest"))


@query("filled_languages", f"SELECT DISTINCT block_id, coalesce(language, {S.language_label('text')}) AS language FROM blocks")
def filled_languages(spark, d):
    return convert.with_languages(table(spark, d, "blocks")).select("block_id", "language").distinct()


@query("long_documents", "SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, block_id FROM blocks) GROUP BY 1 HAVING count(*) > 30")
def long_documents(spark, d):
    return convert.too_long(table(spark, d, "blocks").select("doc_id", "block_id").distinct(), 30)


@query(
    "inserted_edges",
    f"""WITH r AS ({_RANKED}), w AS (SELECT *, last_value(CASE WHEN type = 'figure' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY block_order, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS figure_id FROM r WHERE type IN ('figure', 'caption')),
    e AS (SELECT DISTINCT block_id, unnest(relations).type AS type, unnest(relations).target_block_id AS target FROM blocks) SELECT * FROM e UNION SELECT block_id, 'caption_of', figure_id FROM w WHERE type = 'caption' AND figure_id IS NOT NULL AND page IS NOT NULL""",
)
def inserted_edges(spark, d):
    old = table(spark, d, "blocks").select("block_id", F.explode("relations").alias("r")).select("block_id", F.col("r.type").alias("type"), F.col("r.target_block_id").alias("target"))
    new = structure.caption_figures(_blocks(spark, d), F.col("page")).select("block_id", F.lit("caption_of").alias("type"), F.col("figure_id").alias("target"))
    return convert.with_edges(convert.with_edges(old, new), new)


@query("html_texts", f"SELECT doc_id, md5({S.collapsed('title')} || chr(10) || 'from a & b') AS digest FROM documents WHERE title IS NOT NULL AND {S.trimmed('title')} <> '' AND title NOT LIKE '%<%' AND title NOT LIKE '%&%'")
def html_texts(spark, d):
    """Titles written as a page with a heading, a script and an entity, and read again."""
    t = table(spark, d, "documents").filter("title IS NOT NULL AND title NOT LIKE '%<%' AND title NOT LIKE '%&%'").filter(F.trim("title") != "")
    page = F.concat(F.lit("<html><script>var x;</script><h1>"), "title", F.lit("</h1><p>from  a &amp; b</p></html>"))
    return corpora.html_text(t.select("doc_id", page.alias("page")), "doc_id", "page").select("doc_id", F.md5("text").alias("digest"))


@query("source_pages", r"SELECT DISTINCT qid, nullif(regexp_extract(s, '^[A-Z]+-(.+?)-page', 1), '') AS document, nullif(regexp_extract(s, '-page\s*(\d+)', 1), '')::INTEGER AS page FROM (SELECT qid, 'SRS-' || document || '-page' || page AS s FROM requesta_items WHERE document IS NOT NULL AND page IS NOT NULL)")
def source_pages(spark, d):
    r = table(spark, d, "requesta_items").filter("document IS NOT NULL AND page IS NOT NULL")
    s = corpora.source_parts(F.concat(F.lit("SRS-"), "document", F.lit("-page"), F.col("page").cast("string")))
    return r.select("qid", s.alias("s")).select("qid", "s.document", "s.page").distinct()


# --- who may see what: orders stand for a log of members, customers for projects ------------------------------------------

_MEM = "mem AS (SELECT o_custkey % 50 AS project_id, 'u' || o_orderkey % 200 || '@x' AS email, arg_max(CASE WHEN o_totalprice > 150000 THEN 'editor' ELSE 'viewer' END, o_orderkey) AS role FROM orders GROUP BY 1, 2), prj AS (SELECT DISTINCT o_custkey % 50 AS project_id, 'w' || o_custkey % 50 % 7 AS owner_user_id FROM orders), cal AS (SELECT DISTINCT 'w' || o_orderkey % 7 AS caller, 'u' || o_orderkey % 7 || '@x' AS email FROM orders)"


def _members(spark, d):
    o = table(spark, d, "orders")
    mem = o.groupBy((F.col("o_custkey") % 50).alias("project_id"), F.concat(F.lit("u"), (F.col("o_orderkey") % 200).cast("string"), F.lit("@x")).alias("email")).agg(F.max_by(F.when(F.col("o_totalprice") > 150_000, "editor").otherwise("viewer"), "o_orderkey").alias("role"))
    prj = o.select((F.col("o_custkey") % 50).alias("project_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 50 % 7).cast("string")).alias("owner_user_id")).distinct()
    n = (F.col("o_orderkey") % 7).cast("string")
    cal = o.select(F.concat(F.lit("w"), n).alias("caller"), F.concat(F.lit(" U"), n, F.lit("@X")).alias("email")).distinct()
    return mem, prj, cal


@query("effective_roles", f"WITH {_MEM} SELECT project_id, caller, 'owner' AS role, true AS may_edit FROM prj JOIN cal ON caller = owner_user_id UNION ALL SELECT project_id, caller, role, role = 'editor' FROM mem JOIN cal USING (email) JOIN prj USING (project_id) WHERE owner_user_id <> caller")
def effective_roles(spark, d):
    mem, prj, cal = _members(spark, d)
    r = relational.effective_role(prj, mem, cal)
    return r.select("project_id", "caller", "role", relational.at_least(F.col("role"), "editor").alias("may_edit"))


@query("listed_projects", f"WITH {_MEM} SELECT project_id, owner_user_id, false AS shared FROM prj WHERE owner_user_id = 'w3' UNION ALL SELECT project_id, owner_user_id, true FROM prj WHERE owner_user_id <> 'w3' AND project_id IN (SELECT project_id FROM mem WHERE email = 'u3@x')")
def listed_projects(spark, d):
    mem, prj, _ = _members(spark, d)
    return relational.listed_projects(prj, mem, "w3", " U3@x")


@query("project_members", f"WITH {_MEM} SELECT project_id, count(email)::BIGINT AS n FROM prj LEFT JOIN mem USING (project_id) GROUP BY 1")
def project_members(spark, d):
    mem, prj, _ = _members(spark, d)
    return prj.join(mem, "project_id", "left").groupBy("project_id").agg(F.count("email").alias("n"))


@query("transferred_projects", f"WITH {_MEM}, mv AS (SELECT project_id, 'n' || project_id AS new_owner, 'u' || project_id || '@x' AS ne, 'u' || project_id + 100 || '@x' AS oe FROM prj WHERE project_id % 5 = 0) SELECT project_id, email, role FROM mem WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.project_id = mem.project_id AND mem.email IN (ne, oe)) UNION ALL SELECT project_id, oe, 'editor' FROM mv")
def transferred_projects(spark, d):
    """Every fifth project goes to another owner, who is a member no longer; the old one edits."""
    mem, prj, _ = _members(spark, d)
    p = F.col("project_id")
    moves = prj.filter(p % 5 == 0).select("project_id", F.concat(F.lit("n"), p.cast("string")).alias("new_owner"), F.concat(F.lit("u"), p.cast("string"), F.lit("@x")).alias("new_email"), F.concat(F.lit("u"), (p + 100).cast("string"), F.lit("@x")).alias("old_email"), F.lit(0).alias("at"))
    return relational.transfer(prj, mem.withColumn("created_at", F.lit(0)), moves)[1].select("project_id", "email", "role")


@query("readable_shares", "WITH s AS (SELECT DISTINCT report_id AS share_id, CASE WHEN reason = 'privacy' THEN 'invite' ELSE 'link' END AS access FROM message_reports), i AS (SELECT DISTINCT report_id AS share_id FROM message_reports WHERE lower(trim(resolved_by)) LIKE 'desk1@%') SELECT share_id, access FROM s WHERE access = 'link' OR share_id IN (SELECT share_id FROM i)")
def readable_shares(spark, d):
    r = table(spark, d, "message_reports")
    shares = r.select(F.col("report_id").alias("share_id"), F.when(F.col("reason") == "privacy", "invite").otherwise("link").alias("access")).distinct()
    invited = r.filter(F.lower(F.trim("resolved_by")).startswith("desk1@")).select(F.col("report_id").alias("share_id"), F.lit("Desk1@x").alias("email"))
    return relational.readable_shares(shares, invited, "desk1@X")


@query("label_shares", "WITH q AS (SELECT DISTINCT qid, category, question, answer IS NULL AS empty FROM locomo_questions) SELECT category, CASE WHEN empty THEN 'none' ELSE 'given' END AS label, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY category), 2) AS percent FROM q GROUP BY 1, 2")
def label_shares(spark, d):
    q = table(spark, d, "locomo_questions").select("qid", "category", "question", F.when(F.col("answer").isNull(), "none").otherwise("given").alias("label")).distinct()
    return answers.summarise(q, ["category"], [], "label")


@query("usage_totals", "SELECT count(DISTINCT c_custkey)::BIGINT AS users, count(DISTINCT o_custkey)::BIGINT AS active, round(sum(CASE WHEN o_totalprice > 0 THEN o_totalprice ELSE 0 END), 2) AS total, round(max(o_totalprice), 2) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def usage_totals(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.agg(F.countDistinct("c_custkey").alias("users"), F.countDistinct("o_custkey").alias("active"), F.round(F.sum(F.greatest("o_totalprice", F.lit(0.0))), 2).alias("total"), F.round(F.max("o_totalprice"), 2).alias("top"))
