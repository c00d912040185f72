"""The core queries with their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import table
from ..functions import text as T
from ..operators import answers, history, relational, retrieval, structure
from ..streaming import limits
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The moment that stands for now, so that results do not depend on the clock.
AS_OF = "2026-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- text -------------------------------------------------------------------------------------------------------------


@query("token_count", f"SELECT DISTINCT block_id, coalesce({S.n_tokens('text')}, 0)::BIGINT AS n_tokens FROM blocks")
def token_count(spark, d):
    return table(spark, d, "blocks").select("block_id", F.coalesce(T.n_tokens(F.col("text")), F.lit(0)).cast("long").alias("n_tokens")).distinct()


@query("normalized_text", f"SELECT DISTINCT doc_id, md5({S.normalized('text')}) AS norm FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("norm")).distinct()


@query("language_label", f"SELECT DISTINCT doc_id, {S.language_label('text')} AS label FROM documents")
def language_label(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_label(F.col("text")).alias("label")).distinct()


@query("search_terms", f"SELECT chunk_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_different FROM (SELECT DISTINCT chunk_id, {S.terms('source_text')} AS t FROM chunks)")
def search_terms(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", T.terms(F.col("source_text")).alias("t")).distinct()
    return c.select("chunk_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_different"))


@query("clean_messages", f"SELECT DISTINCT message_id, md5({S.clean_answer('content')}) AS clean, {S.clean_answer('content')} <> content AS changed FROM thread_messages WHERE content IS NOT NULL")
def clean_messages(spark, d):
    m = table(spark, d, "thread_messages").filter("content IS NOT NULL")
    clean = T.clean_answer(F.col("content"))
    return m.select("message_id", F.md5(clean).alias("clean"), (clean != F.col("content")).alias("changed")).distinct()


@query(
    "cited_markers",
    f"""SELECT message_id, n AS marker, min(p)::BIGINT AS place FROM (SELECT message_id, unnest(list_transform(marks, lambda x: x::BIGINT)) AS n, generate_subscripts(marks, 1) AS p
    FROM (SELECT DISTINCT message_id, regexp_extract_all(content, {S.quoted(T.CITED)}, 1) AS marks FROM thread_messages WHERE content IS NOT NULL)) GROUP BY message_id, n""",
)
def cited_markers(spark, d):
    m = table(spark, d, "thread_messages").filter("content IS NOT NULL").select("message_id", F.regexp_extract_all("content", F.lit(T.CITED), F.lit(1)).alias("marks")).distinct()
    p = m.select("message_id", F.posexplode("marks").alias("p", "n"))
    return p.groupBy("message_id", F.col("n").cast("long").alias("marker")).agg((F.min("p") + 1).cast("long").alias("place"))


@query("used_markers", f"SELECT DISTINCT message_id, unnest(list_filter(list_transform(string_split(regexp_extract(content, {S.quoted(T.USED)}, 1), ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^s\\d+$'))) AS item FROM thread_messages WHERE content IS NOT NULL")
def used_markers(spark, d):
    return table(spark, d, "thread_messages").filter("content IS NOT NULL").select("message_id", F.explode(T.used_ids(F.col("content"))).alias("item")).distinct()


@query("clause_labels", f"SELECT DISTINCT block_id, {S.clause_label('text')} AS label, len(string_split({S.clause_label('text')}, '.'))::BIGINT AS depth FROM blocks WHERE {S.clause_label('text')} IS NOT NULL")
def clause_labels(spark, d):
    label = T.clause_label(F.col("text"))
    return table(spark, d, "blocks").select("block_id", label.alias("label"), F.size(F.split(label, r"\.")).cast("long").alias("depth")).filter("label IS NOT NULL").distinct()


@query("normalized_answers", f"SELECT DISTINCT qid, {S.normalize_answer('answer')} AS norm FROM locomo_questions WHERE answer IS NOT NULL")
def normalized_answers(spark, d):
    return table(spark, d, "locomo_questions").filter("answer IS NOT NULL").select("qid", T.normalize_answer(F.col("answer")).alias("norm")).distinct()


@query("estimated_tokens", "SELECT DISTINCT chunk_id, (length(source_text) // 4 + 1)::BIGINT AS n FROM chunks WHERE source_text IS NOT NULL")
def estimated_tokens(spark, d):
    return table(spark, d, "chunks").filter("source_text IS NOT NULL").select("chunk_id", T.estimated_tokens(F.col("source_text")).alias("n")).distinct()


@query("memory_keys", f"SELECT DISTINCT memory_id, {S.memory_key('key')} AS key FROM memories")
def memory_keys(spark, d):
    return table(spark, d, "memories").select("memory_id", T.memory_key(F.col("key")).alias("key")).distinct()


@query("resolver_addresses", f"SELECT {S.folded(S.trimmed('resolved_by'))} AS email, count(DISTINCT report_id)::BIGINT AS n FROM message_reports WHERE resolved_by IS NOT NULL GROUP BY 1")
def resolver_addresses(spark, d):
    return table(spark, d, "message_reports").filter("resolved_by IS NOT NULL").groupBy(T.email(F.col("resolved_by")).alias("email")).agg(F.countDistinct("report_id").alias("n"))


@query(
    "memory_ages",
    f"SELECT DISTINCT memory_id, CASE WHEN n <= 1 THEN '' ELSE 'saved ' || n || ' days ago' END AS age, CASE WHEN n <= 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n <= 7 THEN 'Past week' WHEN n <= 30 THEN 'Past month' ELSE 'Older' END AS bucket "
    f"FROM (SELECT memory_id, floor((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 86400000000.0)::BIGINT AS n FROM memories)",
)
def memory_ages(spark, d):
    m = table(spark, d, "memories")
    return m.select("memory_id", T.age_phrase(F.col("created_at"), _as_of()).alias("age"), T.relative_bucket(F.col("created_at"), _as_of()).alias("bucket")).distinct()


@query("content_hash_dedupe", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedupe(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


# --- structure --------------------------------------------------------------------------------------------------------

_RANKED = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_order NULLS FIRST, block_id NULLS FIRST) - 1 AS rank FROM (SELECT DISTINCT * EXCLUDE (relations, locators, alternatives), list_filter(locators, lambda l: l.kind = 'page_bbox')[1].page AS page, list_filter(locators, lambda l: l.kind = 'page_bbox')[1].bbox AS bbox FROM blocks)"


def _blocks(spark, d) -> DataFrame:
    page = F.get(F.filter("locators", lambda x: x["kind"] == "page_bbox"), F.lit(0))
    b = table(spark, d, "blocks").withColumn("page", page["page"]).withColumn("bbox", page["bbox"])
    return b.select("block_id", "doc_id", "block_order", "type", "text", "language", "parent_block_id", "section_path", "media_ref", "metadata", "page", "bbox").dropDuplicates(["doc_id", "block_id"])


@query(
    "running_headers",
    f"""WITH t AS (SELECT DISTINCT doc_id, seq, page, {S.normalized('text')} AS norm FROM converted_blocks WHERE bbox[2] <= 72 AND length(text) BETWEEN 1 AND 200 AND block_type IN ('paragraph', 'heading')),
    o AS (SELECT doc_id, norm FROM t GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3) SELECT DISTINCT doc_id, seq FROM t SEMI JOIN o USING (doc_id, norm)""",
)
def running_headers(spark, d):
    b = table(spark, d, "converted_blocks").withColumnRenamed("block_type", "type")
    return structure.running_headers(b, ["doc_id", "seq"], F.get("bbox", F.lit(1)), F.col("page"))


@query(
    "caption_figures",
    f"""WITH r AS ({_RANKED}), w AS (SELECT *, last_value(CASE WHEN type = 'figure' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY block_order, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS figure_id
    FROM r WHERE type IN ('figure', 'caption')) SELECT doc_id, block_id, figure_id FROM w WHERE type = 'caption' AND figure_id IS NOT NULL AND page IS NOT NULL""",
)
def caption_figures(spark, d):
    return structure.caption_figures(_blocks(spark, d), F.col("page"))


@query(
    "page_continuations",
    rf"""WITH r AS (SELECT doc_id, doc_id || ':' || seq AS block_id, block_type AS type, text, page, bbox, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rank FROM (SELECT DISTINCT doc_id, seq, block_type, text, page, bbox FROM converted_blocks WHERE bbox[2] BETWEEN 60 AND 700)),
    p AS (SELECT a.doc_id, a.block_id, b.block_id AS next_id, a.type AS ta, b.type AS tb, a.text AS xa, b.text AS xb, a.page AS pa, b.page AS pb, a.bbox AS ba, b.bbox AS bb FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.rank = a.rank + 1)
    SELECT doc_id, block_id, next_id FROM p WHERE pb = pa + 1 AND bb[2] <= 140 AND ((ta = 'paragraph' AND tb = 'paragraph' AND NOT regexp_matches(xa, '[.!?:;]["'')\]]?\s*$') AND regexp_matches(regexp_replace(xb, '^\s+', ''), '^[\p{{Ll}},;:)]'))
    OR (ta = 'table' AND tb = 'table' AND greatest(0, least(ba[3], bb[3]) - greatest(ba[1], bb[1])) / greatest(least(ba[3] - ba[1], bb[3] - bb[1]), 1) >= 0.7))""",
)
def page_continuations(spark, d):
    b = table(spark, d, "converted_blocks").filter(F.get("bbox", F.lit(1)).between(60, 700)).select("doc_id", F.concat_ws(":", "doc_id", "seq").alias("block_id"), F.col("seq").alias("block_order"), F.col("block_type").alias("type"), "text", "page", "bbox").distinct()
    return structure.continuations(b, F.col("page"), F.col("bbox"), 140.0)


_CLAUSES = f"""r AS ({_RANKED}), s AS (SELECT *, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before FROM r),
    tot AS (SELECT doc_id, sum(coalesce(length(text), 0)) AS total FROM r GROUP BY 1), c AS (SELECT doc_id, rank, {S.clause_label('text')} AS label, chars_before FROM s WHERE {S.clause_label('text')} IS NOT NULL),
    n AS (SELECT c.*, lead(chars_before) OVER w AS chars_end, lead(label) OVER w AS next_label FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY rank)),
    k AS (SELECT doc_id, rank, label, coalesce(chars_end, total) - chars_before AS size, total, coalesce(list_transform(string_split(next_label, '.'), lambda x: x::BIGINT) > list_transform(string_split(label, '.'), lambda x: x::BIGINT), true) AS rising FROM n JOIN tot USING (doc_id))"""


@query("clause_sizes", f"WITH {_CLAUSES} SELECT doc_id, rank::BIGINT AS rank, label, size::BIGINT AS size, rising FROM k")
def clause_sizes(spark, d):
    return structure.clause_starts(_blocks(spark, d)).select("doc_id", F.col("rank").cast("long").alias("rank"), "label", F.col("size").cast("long").alias("size"), "rising")


_UNITS = f"""{_CLAUSES}, pd AS (SELECT doc_id, sum(CASE WHEN len(section_path) > 0 THEN 1 ELSE 0 END) AS paths, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) AS headings, bool_or(type = 'heading' AND {S.trimmed('text')} <> '') AS titled FROM r GROUP BY 1),
    cl AS (SELECT doc_id, count(*) AS clauses, sum(size) AS covered, max(size) AS largest, max(total) AS total, bool_and(rising) AS rising FROM k GROUP BY 1),
    u AS (SELECT doc_id, paths, headings, clauses, covered, total, CASE WHEN paths > 0 OR coalesce(titled, false) THEN 'heading' WHEN coalesce(clauses >= 3 AND rising AND covered >= 0.6 * total AND largest <= 0.9 * covered, false) THEN 'clause' ELSE 'none' END AS unit FROM pd LEFT JOIN cl USING (doc_id))"""


@query(
    "natural_units",
    f"WITH {_UNITS} SELECT doc_id, unit, (CASE WHEN paths > 0 THEN paths WHEN unit = 'heading' THEN headings WHEN unit = 'clause' THEN clauses ELSE 0 END)::BIGINT AS matches, (CASE WHEN unit = 'heading' THEN 1.0 WHEN unit = 'clause' THEN round(covered::DOUBLE / total::DOUBLE, 6) ELSE 0.0 END)::DOUBLE AS coverage FROM u",
)
def natural_units(spark, d):
    return structure.natural_units(_blocks(spark, d))


@query(
    "clause_sections",
    rf"""WITH {_UNITS}, h AS (SELECT r.doc_id, r.block_id, r.rank, CASE WHEN {S.clause_label('text')} IS NOT NULL THEN left(regexp_split_to_array({S.trimmed('text')}, '\r\n|\r|\n')[1], 120) END AS head FROM r SEMI JOIN (SELECT doc_id FROM u WHERE unit = 'clause') USING (doc_id))
    SELECT doc_id, block_id, section FROM (SELECT doc_id, block_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h) WHERE section IS NOT NULL""",
)
def clause_sections(spark, d):
    return structure.clause_sections(_blocks(spark, d))


@query(
    "markdown_anchors",
    f"""WITH r AS ({_RANKED}), p AS (SELECT *, CASE WHEN type = 'heading' THEN repeat('#', least(greatest(len(section_path), 1), 6)) || ' ' WHEN type = 'figure' AND media_ref IS NOT NULL THEN '![](' || media_ref || ')' || chr(10) || chr(10) WHEN type = 'list' THEN '- '
    WHEN type = 'code' THEN '```' || chr(10) WHEN type = 'formula' THEN '$$' || chr(10) WHEN type = 'caption' THEN '*' WHEN type = 'speech_turn' THEN '> ' WHEN type = 'slide' THEN '## ' ELSE '' END AS prefix,
    CASE WHEN type = 'code' THEN 4 WHEN type = 'formula' THEN 3 WHEN type = 'caption' THEN 1 ELSE 0 END + 2 AS tail FROM r WHERE {S.trimmed("coalesce(text, '')")} <> ''),
    b AS (SELECT *, coalesce(sum(length(prefix) + length(text) + tail) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(prefix) AS s FROM p)
    SELECT doc_id, block_id, s::BIGINT AS start, (s + length(text))::BIGINT AS "end" FROM b WHERE type <> 'heading'""",
)
def markdown_anchors(spark, d):
    return structure.markdown_anchors(_blocks(spark, d)).select("doc_id", "block_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "fixed_window_chunks",
    f"""WITH r AS ({_RANKED}), n AS (SELECT doc_id, block_id, rank, coalesce({S.n_tokens('text')}, 0) AS n FROM r WHERE type <> 'heading'), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
    c AS (SELECT *, unnest(range((before // 256)::BIGINT, ((before + n - 1) // 256 + 1)::BIGINT)) AS chunk FROM b WHERE n > 0)
    SELECT doc_id, chunk, sum(least(before + n, (chunk + 1) * 256) - greatest(before, chunk * 256))::BIGINT AS n_words, arg_min(block_id, rank) AS first_block FROM c GROUP BY 1, 2""",
)
def fixed_window_chunks(spark, d):
    return structure.fixed_windows(_blocks(spark, d)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), "first_block")


@query(
    "section_groups",
    f"""WITH r AS ({_RANKED}), t AS (SELECT doc_id, rank, array_to_string(section_path, ' / ') AS section, CASE WHEN array_to_string(section_path, ' / ') = lag(array_to_string(section_path, ' / ')) OVER (PARTITION BY doc_id ORDER BY rank) THEN 0 ELSE 1 END AS turn FROM r),
    g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM t) SELECT doc_id, grp::BIGINT AS "group", count(*)::BIGINT AS n_blocks, max(section) AS section FROM g GROUP BY doc_id, grp""",
)
def section_groups(spark, d):
    return structure.section_groups(_blocks(spark, d)).select("doc_id", F.col("group").cast("long").alias("group"), "n_blocks", "section")


@query("majority_language", "WITH c AS (SELECT doc_id, language, count(DISTINCT block_id) AS n FROM blocks WHERE language IS NOT NULL GROUP BY 1, 2) SELECT doc_id, arg_min(language, (-n, language)) AS language, max(n)::BIGINT AS n FROM c GROUP BY 1")
def majority_language(spark, d):
    return structure.majority_language(_blocks(spark, d)).select("doc_id", "language", F.col("n").cast("long").alias("n"))


@query(
    "semantic_breaks",
    """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings), d AS (SELECT label, vec_id, round(1 - list_cosine_similarity(u, v), 9) AS dist FROM v),
    l AS (SELECT label, quantile_cont(dist, 0.95) AS lim FROM d GROUP BY 1) SELECT d.label, vec_id, (sum(CASE WHEN dist > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.label ORDER BY vec_id ROWS UNBOUNDED PRECEDING))::BIGINT AS piece FROM d JOIN l USING (label)""",
)
def semantic_breaks(spark, d):
    return structure.semantic_breaks(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "piece")


@query(
    "edit_diff",
    """WITH c AS (SELECT DISTINCT chunk_id, doc_id, parent_id, confidence, language, len(child_ids) AS n FROM chunks), o AS (SELECT chunk_id, parent_id FROM c),
    kept AS (SELECT chunk_id, CASE WHEN language IS NULL THEN doc_id ELSE parent_id END AS parent_id FROM c WHERE coalesce(confidence, 1) >= 0.8), added AS (SELECT chunk_id || ':2', parent_id FROM c WHERE n > 3)
    SELECT chunk_id, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.chunk_id = x.chunk_id) THEN 'fresh' WHEN bool_and(side = 'old') THEN 'stale' WHEN count(DISTINCT coalesce(parent_id, '-')) = 1 THEN 'kept' ELSE 'moved' END AS state
    FROM (SELECT chunk_id, parent_id, 'old' AS side FROM o UNION ALL SELECT *, 'new' FROM kept UNION ALL SELECT *, 'new' FROM added) x GROUP BY chunk_id""",
)
def edit_diff(spark, d):
    """The chunks before and after an edit: unsure ones leave, those of no language move to the document, wide ones get a second part."""
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "parent_id", "confidence", "language", F.size("child_ids").alias("n")).distinct()
    new = c.filter(F.coalesce("confidence", F.lit(1.0)) >= 0.8).select("chunk_id", F.when(F.col("language").isNull(), F.col("doc_id")).otherwise(F.col("parent_id")).alias("parent_id"))
    return structure.edit_diff(c.select("chunk_id", "parent_id"), new.unionByName(c.filter("n > 3").select(F.concat("chunk_id", F.lit(":2")).alias("chunk_id"), "parent_id")), "chunk_id", "parent_id")


@query("leaf_chunks")
def leaf_chunks(spark, d):
    """Leaves that are whole blocks have spans of -1."""
    return structure.leaf_chunks(_blocks(spark, d)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("span_start", "span_end")})


@query("chunk_tree")
def chunk_tree(spark, d):
    return structure.chunk_tree(_blocks(spark, d))


@query("relation_edges", "SELECT DISTINCT block_id, unnest(relations).type AS type, unnest(relations).target_block_id AS target FROM blocks")
def relation_edges(spark, d):
    return table(spark, d, "blocks").select("block_id", F.explode("relations").alias("r")).select("block_id", F.col("r.type").alias("type"), F.col("r.target_block_id").alias("target")).distinct()


@query("document_confidence", "SELECT doc_id, min(confidence) AS confidence, count(DISTINCT block_id)::BIGINT AS n_blocks FROM blocks GROUP BY 1")
def document_confidence(spark, d):
    return table(spark, d, "blocks").groupBy("doc_id").agg(F.min("confidence").alias("confidence"), F.countDistinct("block_id").alias("n_blocks"))


@query("editable_blocks", "SELECT doc_id, type, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, block_id, type FROM blocks WHERE type IN ('paragraph', 'list', 'heading', 'table', 'caption')) GROUP BY 1, 2")
def editable_blocks(spark, d):
    return table(spark, d, "blocks").filter(F.col("type").isin("paragraph", "list", "heading", "table", "caption")).select("doc_id", "block_id", "type").distinct().groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- retrieval --------------------------------------------------------------------------------------------------------

_LEAVES = "leaf AS (SELECT DISTINCT chunk_id, source_text FROM chunks WHERE level = 'leaf' AND citable)"
_POSTS = f"""{_LEAVES}, tok AS (SELECT chunk_id, {S.terms('source_text')} AS t FROM leaf), tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY 1, 2),
    post AS (SELECT chunk_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256.0::DOUBLE)) AS weight FROM tf)"""


def leaves(spark, d) -> DataFrame:
    return table(spark, d, "chunks").filter("level = 'leaf' AND citable").select("chunk_id", "source_text").dropDuplicates(["chunk_id"])


@query("bm25_postings", f"WITH {_POSTS} SELECT term, count(*)::BIGINT AS df, round(sum(weight), 4) AS weight FROM post GROUP BY 1")
def bm25_postings(spark, d):
    return retrieval.postings(leaves(spark, d), "chunk_id", "source_text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "bm25_topk",
    f"""WITH {_POSTS}, q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.terms('question')}) AS term FROM (SELECT DISTINCT qid, question FROM requesta_items WHERE qid % 100 = 0)) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    sc AS (SELECT qid, chunk_id, sum(qtf * ln(((SELECT count(*) FROM leaf) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * weight) AS score FROM q JOIN df USING (term) JOIN post USING (term) GROUP BY 1, 2)
    SELECT qid, chunk_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10""",
)
def bm25_topk(spark, d):
    """The queries are the items whose id is divisible by 100, against all leaves."""
    asked = table(spark, d, "requesta_items").filter("qid % 100 = 0").select("qid", "question").distinct()
    return retrieval.sparse_search(asked, "qid", "question", leaves(spark, d), "chunk_id", "source_text", 10).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def _cos(k: int) -> str:
    return f"""q AS (SELECT vec_id AS query, label AS qlabel, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS key, qlabel, label, list_cosine_similarity(qv, embedding::DOUBLE[]) AS score, list_inner_product(qv, embedding::DOUBLE[]) AS dot FROM q, embeddings WHERE vec_id <> query),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM s) WHERE rank <= {k}), dotted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dot, 9) DESC, key) AS rank FROM s) WHERE rank <= {k})"""


def _dense(spark, d, k: int, metric: str = "cosine") -> DataFrame:
    """The queries are the vectors whose id is divisible by 100, against all others."""
    v = table(spark, d, "embeddings")
    return retrieval.dense_search(v.filter("vec_id % 100 = 0"), "vec_id", "embedding", v, "vec_id", "embedding", k, metric, skip_self=True)


@query("dense_topk", f"WITH {_cos(10)} SELECT query, key, rank, round(score, 6) AS score FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d, 10).select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_FUSED = "u AS (SELECT query, key, rank, 0 AS source FROM dense UNION ALL SELECT query, key, rank, 1 FROM dotted)"


def _lists(spark, d) -> DataFrame:
    a = _dense(spark, d, 20).select("query", "key", "rank", F.lit(0).alias("source"))
    return a.unionByName(_dense(spark, d, 20, "dot").select("query", "key", "rank", F.lit(1).alias("source")))


@query("rrf_fusion", f"WITH {_cos(20)}, {_FUSED}, f AS (SELECT query, key, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY 1, 2) SELECT query, key, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM f) WHERE rank <= 10")
def rrf_fusion(spark, d):
    return retrieval.fuse(_lists(spark, d), "query", "key", 10).select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(
    "pool_round_robin",
    f"""WITH {_cos(20)}, {_FUSED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY source, rank) AS n FROM u) WHERE n = 1), t AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY rank, key) AS turn FROM f)
    SELECT query, key, place FROM (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY turn, source) AS place FROM t) WHERE place <= 30""",
)
def pool_round_robin(spark, d):
    return retrieval.fill_pool(_lists(spark, d), "query", "source", "key", "rank", 30).select("query", "key", F.col("place").cast("long").alias("place"))


@query("keep_ratio_cut", f"WITH {_cos(20)} SELECT query, key FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM dense) WHERE best <= 0 OR round(score, 9) >= round(0.5 * best, 9)")
def keep_ratio_cut(spark, d):
    return retrieval.keep_ratio(_dense(spark, d, 20), "query").select("query", "key")


def _judged(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return _dense(spark, d, 10).join(v.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(v.select(F.col("vec_id").alias("key"), F.col("label").alias("b")), "key").withColumn("relevant", F.col("a") == F.col("b"))


@query("hit_mrr", f"WITH {_cos(10)}, b AS (SELECT query, min(CASE WHEN label = qlabel THEN rank END) AS best FROM dense GROUP BY 1) SELECT query, (CASE WHEN best <= 5 THEN 1 ELSE 0 END)::INTEGER AS hit, round(CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0.0::DOUBLE END, 6) AS mrr FROM b")
def hit_mrr(spark, d):
    return retrieval.hit_and_mrr(_judged(spark, d), "query", "relevant")


@query(
    "recall_ndcg",
    f"""WITH {_cos(10)}, j AS (SELECT query, key, 1 AS grade FROM s WHERE label = qlabel), t AS (SELECT query, count(*) AS total, sum(CASE WHEN n <= 10 THEN 1.0::DOUBLE / log2(n + 1) ELSE 0 END) AS ideal FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY key) AS n FROM j) GROUP BY 1),
    g AS (SELECT query, count(*) AS hits, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM dense SEMI JOIN j USING (query, key) GROUP BY 1) SELECT query, round(coalesce(hits, 0)::DOUBLE / total, 6) AS recall, round(coalesce(dcg, 0.0) / ideal, 6) AS ndcg FROM t LEFT JOIN g USING (query)""",
)
def recall_ndcg(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    judged = q.join(v.select(F.col("vec_id").alias("key"), "label"), "label").filter("key <> query").select("query", "key", F.lit(1).alias("grade"))
    return retrieval.recall_and_ndcg(judged, _dense(spark, d, 10), "query", "key")


@query(
    "chunk_ancestors",
    """WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, parent_id FROM chunks), w AS (SELECT c.chunk_id, p.chunk_id AS ancestor_id, 1 AS depth, p.parent_id AS next FROM c JOIN c p ON c.parent_id = p.chunk_id
    UNION ALL SELECT w.chunk_id, p.chunk_id, w.depth + 1, p.parent_id FROM w JOIN c p ON w.next = p.chunk_id) SELECT chunk_id, ancestor_id, depth FROM w""",
)
def chunk_ancestors(spark, d):
    return retrieval.ancestors(table(spark, d, "chunks"))


@query(
    "descendant_leaves",
    """WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, level, child_ids FROM chunks), e AS (SELECT x.chunk_id, x.child, x.place FROM (SELECT chunk_id, unnest(child_ids) AS child, generate_subscripts(child_ids, 1) - 1 AS place FROM c WHERE level <> 'leaf') x),
    w AS (SELECT chunk_id AS root_id, chunk_id AS node, level, '' AS path FROM c UNION ALL SELECT w.root_id, e.child, c.level, w.path || lpad(e.place::VARCHAR, 5, '0') FROM w JOIN e ON e.chunk_id = w.node JOIN c ON c.chunk_id = e.child)
    SELECT root_id, node AS leaf_id, min(path) AS path FROM w WHERE level = 'leaf' GROUP BY 1, 2""",
)
def descendant_leaves(spark, d):
    return retrieval.descendant_leaves(table(spark, d, "chunks"))


@query("auto_merge")
def auto_merge(spark, d):
    asked = table(spark, d, "requesta_items").filter("qid % 100 = 0").select("qid", "question").distinct()
    hits = retrieval.sparse_search(asked, "qid", "question", leaves(spark, d), "chunk_id", "source_text", 30)
    return retrieval.auto_merge(hits.withColumnRenamed("qid", "query"), table(spark, d, "chunks"))


@query("hash_embeddings")
def hash_embeddings(spark, d):
    return retrieval.embed(leaves(spark, d), "chunk_id", "source_text")


@query(
    "message_citations",
    """SELECT DISTINCT message_id, coalesce(json_extract_string(x, '$.chunk_id'), CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END) AS chunk_id FROM (SELECT message_id, unnest(json_extract(citations::JSON, '$[*]')) AS x FROM thread_messages WHERE json_valid(citations) AND citations LIKE '[%') WHERE coalesce(json_extract_string(x, '$.chunk_id'), CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END) IS NOT NULL""",
)
def message_citations(spark, d):
    m = table(spark, d, "thread_messages").filter("citations LIKE '[%'")
    items = F.from_json("citations", "array<string>")
    x = m.select("message_id", F.explode(items).alias("x"))
    return x.select("message_id", F.when(F.col("x").startswith("{"), F.get_json_object("x", "$.chunk_id")).otherwise(F.col("x")).alias("chunk_id")).filter("chunk_id IS NOT NULL").distinct()


# --- answers ----------------------------------------------------------------------------------------------------------


def _f1_sql(p: str, r: str) -> str:
    same = S.overlap(S.answer_words(p), S.answer_words(r))
    return f"(CASE WHEN {same} = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * {same} / (len({S.answer_words(p)}) + len({S.answer_words(r)})), 6) END)"


_PAIRS = "(SELECT DISTINCT qid, gold_passage, answer, question FROM requesta_items WHERE answer IS NOT NULL AND gold_passage IS NOT NULL)"


@query("token_overlap_relevance", f"SELECT qid, share, share >= 0.5 AS relevant FROM (SELECT DISTINCT qid, answer, CASE WHEN len({S.words('gold_passage')}) > 0 THEN round({S.overlap(S.words('answer'), S.words('gold_passage'))}::DOUBLE / len({S.words('gold_passage')}), 6) END AS share FROM {_PAIRS})")
def token_overlap_relevance(spark, d):
    r = table(spark, d, "requesta_items").filter("answer IS NOT NULL AND gold_passage IS NOT NULL")
    return r.select("qid", "answer", answers.held_share(F.col("answer"), F.col("gold_passage")).alias("share")).distinct().select("qid", "share", (F.col("share") >= answers.RELEVANT).alias("relevant"))


@query("f1_unstemmed", f"SELECT DISTINCT qid, {_f1_sql('answer', 'gold_passage')} AS f1 FROM {_PAIRS}")
def f1_unstemmed(spark, d):
    r = table(spark, d, "requesta_items").filter("answer IS NOT NULL AND gold_passage IS NOT NULL")
    return r.select("qid", answers.f1(F.col("answer"), F.col("gold_passage")).alias("f1")).distinct()


@query("f1_stemmed")
def f1_stemmed(spark, d):
    """Stemming is not to be had in SQL."""
    r = table(spark, d, "requesta_items").filter("answer IS NOT NULL AND gold_passage IS NOT NULL").select("qid", "answer", "gold_passage").distinct()
    return answers.stemmed_f1(r, "qid", "answer", "gold_passage").distinct()


_N, _M = f"len({S.answer_words('answer')})", f"len({S.answer_words('gold_passage')})"
_SAME = S.overlap(S.answer_words("answer"), S.answer_words("gold_passage"))


@query("bleu1", f"SELECT DISTINCT qid, CASE WHEN {_N} <= 0 OR {_M} <= 0 THEN 0.0::DOUBLE ELSE round((CASE WHEN {_SAME} = 0 THEN 0.1::DOUBLE / {_N} ELSE {_SAME}::DOUBLE / {_N} END) * (CASE WHEN {_N} < {_M} THEN exp(1 - {_M}::DOUBLE / {_N}) ELSE 1.0::DOUBLE END), 6) END AS bleu FROM {_PAIRS}")
def bleu1(spark, d):
    r = table(spark, d, "requesta_items").filter("answer IS NOT NULL AND gold_passage IS NOT NULL")
    return r.select("qid", answers.bleu1(F.col("answer"), F.col("gold_passage")).alias("bleu")).distinct()


_LIST_F1 = f"round(list_avg(list_transform(string_split(answer, ','), lambda r: list_max(list_transform(string_split(question, ','), lambda p: {_f1_sql(S.trimmed('p'), S.trimmed('r'))})))), 6)"


@query(
    "category_f1",
    f"""SELECT DISTINCT qid, CASE WHEN category = 3 THEN {_f1_sql('question', S.trimmed("string_split(answer, ';')[1]"))} WHEN category IN (2, 4) THEN {_f1_sql('question', 'answer')} WHEN category = 1 THEN {_LIST_F1} END AS f1 FROM locomo_questions WHERE answer IS NOT NULL AND question IS NOT NULL AND category BETWEEN 1 AND 4""",
)
def category_f1(spark, d):
    q = table(spark, d, "locomo_questions").filter("answer IS NOT NULL AND question IS NOT NULL AND category BETWEEN 1 AND 4")
    return q.select("qid", answers.category_f1(F.col("question"), F.col("answer"), F.col("category")).alias("f1")).distinct()


@query("list_answers_f1", f"SELECT DISTINCT qid, {_LIST_F1} AS f1 FROM locomo_questions WHERE answer IS NOT NULL AND question IS NOT NULL AND category = 1")
def list_answers_f1(spark, d):
    q = table(spark, d, "locomo_questions").filter("answer IS NOT NULL AND question IS NOT NULL AND category = 1")
    return q.select("qid", answers.multi_f1(F.col("question"), F.col("answer")).alias("f1")).distinct()


@query("question_summary", "SELECT category, count(*)::BIGINT AS n, round(avg(length(question)), 4) AS length FROM (SELECT DISTINCT qid, category, question FROM locomo_questions) GROUP BY 1")
def question_summary(spark, d):
    q = table(spark, d, "locomo_questions").select("qid", "category", "question").distinct().withColumn("length", F.length("question"))
    return answers.summarise(q, ["category"], ["length"])


# --- conversations and memory -----------------------------------------------------------------------------------------

_TURNS = f"t AS (SELECT thread_id, position, arg_min(struct_pack(i := message_id, r := {S.folded(S.trimmed('role'))}, c := content), message_id) AS m FROM thread_messages WHERE position IS NOT NULL GROUP BY 1, 2), tt AS (SELECT thread_id, position, m.i AS message_id, m.r AS role, m.c AS content, coalesce(length(m.c), 0) AS size FROM t)"


@query(
    "history_window",
    f"""WITH {_TURNS}, o AS (SELECT thread_id, min(position) AS first, arg_min(size, position) AS spent, max(position) AS last FROM tt GROUP BY 1), m AS (SELECT tt.*, spent, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt JOIN o USING (thread_id) WHERE position > first),
    c AS (SELECT *, spent + sum(size) OVER (PARTITION BY thread_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM m), k AS (SELECT thread_id, position FROM c WHERE rn <= 2 OR (rn <= 6 AND cum <= 900)), x AS (SELECT thread_id, min(position) AS oldest FROM k GROUP BY 1),
    b AS (SELECT thread_id, first, CASE WHEN first = last THEN 0 ELSE coalesce(oldest - 1, last) END AS b FROM o LEFT JOIN x USING (thread_id)), e AS (SELECT thread_id, first, CASE WHEN b > first THEN b ELSE 0 END::INTEGER AS boundary FROM b)
    SELECT thread_id, position, boundary FROM (SELECT * FROM k UNION ALL SELECT thread_id, first FROM o) JOIN e USING (thread_id)""",
)
def history_window(spark, d):
    return history.history_window(table(spark, d, "thread_messages"), 2, 6, 900)


@query(
    "fold_span",
    f"""WITH {_TURNS}, w AS (SELECT thread_id, max(position) // 3 AS through FROM tt GROUP BY 1), r AS (SELECT tt.*, row_number() OVER (PARTITION BY thread_id ORDER BY position) AS rn FROM tt JOIN w USING (thread_id) WHERE position > through),
    c AS (SELECT *, sum(size) OVER (PARTITION BY thread_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM r) SELECT thread_id, position FROM c WHERE rn = 1 OR (rn <= 40 AND cum <= 900)""",
)
def fold_span(spark, d):
    m = table(spark, d, "thread_messages")
    mark = m.filter("position IS NOT NULL").groupBy("thread_id").agg(F.floor(F.max("position") / 3).cast("int").alias("through"))
    return history.fold_span(m, mark, 40, 900)


@query(
    "recent_context",
    f"""WITH {_TURNS}, l AS (SELECT thread_id, position, role || ': ' || coalesce(content, '') AS line, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt), k AS (SELECT * FROM l WHERE rn <= 4), c AS (SELECT *, sum(length(line)) OVER (PARTITION BY thread_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM k)
    SELECT thread_id, md5(string_agg(line, chr(10) ORDER BY position)) AS context FROM c WHERE rn = 1 OR cum <= 1500 GROUP BY 1""",
)
def recent_context(spark, d):
    return history.recent_context(table(spark, d, "thread_messages")).select("thread_id", F.md5("context").alias("context"))


@query(
    "retry_groups",
    f"""WITH {_TURNS}, u AS (SELECT thread_id, position, coalesce(content, '') AS c FROM tt WHERE role = 'user'), n AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY thread_id ORDER BY position) THEN 0 ELSE 1 END AS opens FROM u),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY thread_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT thread_id, min(position) AS first_position, count(*)::BIGINT AS tries FROM g GROUP BY thread_id, island HAVING count(*) > 1""",
)
def retry_groups(spark, d):
    return history.retry_groups(table(spark, d, "thread_messages"))


@query("newest_messages", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt), k AS (SELECT * FROM r WHERE rn <= 5) SELECT thread_id, position, (max(rn) OVER (PARTITION BY thread_id) - rn + 1)::INTEGER AS place FROM k")
def newest_messages(spark, d):
    return history.newest(table(spark, d, "thread_messages"), 5)


@query("forked_threads", f"WITH {_TURNS} SELECT thread_id, position, row_number() OVER (PARTITION BY thread_id ORDER BY position)::BIGINT AS new_position FROM tt WHERE position <= 6")
def forked_threads(spark, d):
    return history.fork(table(spark, d, "thread_messages"), F.lit(6)).select("thread_id", "position", F.col("new_position").cast("long").alias("new_position"))


_LIVE = """m AS (SELECT DISTINCT * FROM memories WHERE deleted_at IS NULL), tg AS (SELECT *, coalesce(CASE WHEN scope = 'thread' THEN thread_id WHEN scope = 'project' THEN project_id ELSE '' END, '') AS target FROM m),
    live AS (SELECT owner_user_id, scope, target, key, arg_max(memory_id, (created_at, memory_id)) AS memory_id, arg_max(value, (created_at, memory_id)) AS value, max(created_at) AS created_at, arg_max(last_used_at, (created_at, memory_id)) AS last_used_at, arg_max(source, (created_at, memory_id)) AS source, count(*) AS versions FROM tg GROUP BY 1, 2, 3, 4)"""


@query("memory_supersede", f"WITH {_LIVE} SELECT memory_id, versions::BIGINT AS versions FROM live")
def memory_supersede(spark, d):
    return history.live_memories(table(spark, d, "memories")).select("memory_id", "versions")


@query(
    "scope_resolve",
    f"""WITH {_LIVE} SELECT owner_user_id, key, arg_min(memory_id, (CASE scope WHEN 'thread' THEN 0 WHEN 'project' THEN 1 ELSE 2 END, created_at, memory_id)) AS memory_id, arg_min(scope, (CASE scope WHEN 'thread' THEN 0 WHEN 'project' THEN 1 ELSE 2 END, created_at, memory_id)) AS scope, count(*) > 1 AS displaced FROM live GROUP BY 1, 2""",
)
def scope_resolve(spark, d):
    return history.resolve_scopes(history.live_memories(table(spark, d, "memories")))


@query("memory_promotion", "SELECT owner_user_id, key, count(DISTINCT thread_id)::BIGINT AS threads, count(DISTINCT thread_id) >= 5 AS promote FROM memories WHERE deleted_at IS NULL AND scope = 'thread' AND thread_id IS NOT NULL GROUP BY 1, 2")
def memory_promotion(spark, d):
    return history.promotable(table(spark, d, "memories"))


@query(
    "memory_budget",
    f"""WITH RECURSIVE {_LIVE}, o AS (SELECT owner_user_id, memory_id, coalesce(length(key), 0) + 2 + coalesce(length(value), 0) AS size, row_number() OVER (PARTITION BY owner_user_id ORDER BY CASE scope WHEN 'thread' THEN 0 WHEN 'project' THEN 1 ELSE 2 END, created_at DESC, memory_id) AS rn FROM live),
    w AS (SELECT owner_user_id, 0::BIGINT AS rn, 2000::BIGINT AS room, 0 AS taken, NULL::VARCHAR AS memory_id, false AS fits FROM (SELECT DISTINCT owner_user_id FROM o)
    UNION ALL SELECT o.owner_user_id, o.rn, CASE WHEN w.taken < 25 AND o.size <= w.room THEN w.room - o.size ELSE w.room END, CASE WHEN w.taken < 25 AND o.size <= w.room THEN w.taken + 1 ELSE w.taken END, o.memory_id, w.taken < 25 AND o.size <= w.room FROM w JOIN o ON o.owner_user_id = w.owner_user_id AND o.rn = w.rn + 1)
    SELECT owner_user_id, (taken - 1)::INTEGER AS place, memory_id FROM w WHERE fits""",
)
def memory_budget(spark, d):
    return history.select_memories(history.live_memories(table(spark, d, "memories")))


@query(
    "memory_eviction",
    f"""WITH {_LIVE}, n AS (SELECT owner_user_id, scope, target, count(*) - CASE scope WHEN 'thread' THEN 1 WHEN 'project' THEN 2 ELSE 3 END AS over FROM live GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY owner_user_id, scope, target ORDER BY coalesce(last_used_at, created_at), memory_id) AS rn FROM live WHERE source = 'llm_extracted')
    SELECT owner_user_id, scope, target, memory_id FROM a JOIN n USING (owner_user_id, scope, target) WHERE rn <= over""",
)
def memory_eviction(spark, d):
    """With caps small enough that scopes of the test data go over them."""
    return history.over_cap(history.live_memories(table(spark, d, "memories")), {"thread": 1, "project": 2, "user": 3})


# Items in the order of their last touch as (id, folds, form, text); every fourth message and the last one close a fold.
_FORM = S.collapsed(S.folded("t"))


@query(
    "summary_replay",
    f"""WITH RECURSIVE {_TURNS}, r AS (SELECT thread_id, left({S.trimmed("string_split(coalesce(content, ''), '. ')[1]")}, 160) AS t, row_number() OVER (PARTITION BY thread_id ORDER BY position) AS rn, count(*) OVER (PARTITION BY thread_id) AS n FROM tt WHERE role IN ('user', 'assistant')),
    f AS (SELECT *, {_FORM} AS form FROM r), w AS (SELECT thread_id, 0::BIGINT AS rn, 0 AS number, []::STRUCT(id INTEGER, folds INTEGER, fresh BOOLEAN, form VARCHAR, "text" VARCHAR)[] AS items, 0 AS lost FROM (SELECT DISTINCT thread_id FROM f)
    UNION ALL SELECT thread_id, rn, number, CASE WHEN closes THEN list_filter(aged, lambda x: NOT list_contains(gone, x.id)) ELSE items END, lost + CASE WHEN closes THEN len(gone) ELSE 0 END FROM (
    SELECT *, list_transform(list_sort(list_transform(aged, lambda x, i: struct_pack(a := x.folds < 1, b := -x.folds, c := i, id := x.id)))[1:greatest(0, len(aged) - 8)], lambda x: x.id) AS gone FROM (
    SELECT *, list_transform(items, lambda x: struct_pack(id := x.id, folds := CASE WHEN x.fresh THEN 0 ELSE x.folds + 1 END, fresh := false, form := x.form, "text" := x."text")) AS aged FROM (
    SELECT f.thread_id, f.rn, f.rn % 4 = 0 OR f.rn = f.n AS closes, w.lost, CASE WHEN len(list_filter(w.items, lambda x: x.form = f.form)) > 0 THEN w.number ELSE w.number + 1 END AS number,
    CASE WHEN len(list_filter(w.items, lambda x: x.form = f.form)) > 0 THEN list_concat(list_filter(w.items, lambda x: x.form <> f.form), list_filter(w.items, lambda x: x.form = f.form)) ELSE list_append(w.items, struct_pack(id := w.number + 1, folds := 0, fresh := true, form := f.form, "text" := f.t)) END AS items
    FROM w JOIN f ON f.thread_id = w.thread_id AND f.rn = w.rn + 1)))) SELECT thread_id, len(items)::INTEGER AS items, lost::INTEGER AS evicted, array_to_string(list_transform(items, lambda x: '[s' || x.id || '|u:0|f:' || x.folds || '] ' || x."text"), chr(10)) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY rn DESC) AS k FROM w) WHERE k = 1""",
)
def summary_replay(spark, d):
    return history.summary_replay(table(spark, d, "thread_messages"))


@query("thread_titles", f"WITH {_TURNS}, f AS (SELECT thread_id, {S.collapsed('arg_min(content, position)')} AS flat FROM tt WHERE content IS NOT NULL GROUP BY 1) SELECT thread_id, CASE WHEN flat = '' THEN 'New chat' WHEN length(flat) > 42 THEN rtrim(left(flat, 42)) || '…' ELSE flat END AS title FROM f")
def thread_titles(spark, d):
    t = history.turns(table(spark, d, "thread_messages")).filter("content IS NOT NULL").groupBy("thread_id").agg(F.min_by("content", "position").alias("c"))
    return t.select("thread_id", T.title_from(F.col("c")).alias("title"))


# --- relational -------------------------------------------------------------------------------------------------------


@query(
    "usage_left_outer_topk",
    """WITH u AS (SELECT c_custkey AS uid FROM customer), g AS (SELECT o_custkey AS uid, sum(greatest(o_totalprice, 0)) AS total, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT uid, coalesce(n, 0)::BIGINT AS n, round(coalesce(total, 0), 2) AS total FROM u LEFT JOIN g USING (uid))
    SELECT uid, n, total FROM j WHERE total > 0 ORDER BY total DESC, uid LIMIT 5""",
)
def usage_left_outer_topk(spark, d):
    """The five users with the most usage; users without any count 0. The limit is the feature."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"))
    usage = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.sum(F.greatest("o_totalprice", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))
    j = users.join(usage, "uid", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))
    return j.filter("total > 0").orderBy(F.desc("total"), "uid").limit(5)


@query("all_usage", "SELECT c_custkey AS uid, coalesce(n, 0)::BIGINT AS n, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(greatest(o_totalprice, 0)) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def all_usage(spark, d):
    usage = relational.accumulate_usage(table(spark, d, "orders").withColumn("n", F.lit(1)), "o_custkey", ["n", "o_totalprice"])
    j = table(spark, d, "customer").select("c_custkey").join(usage, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(F.col("c_custkey").alias("uid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("o_totalprice", F.lit(0.0)), 2).alias("total"))


@query("member_counts", "SELECT p.project_id, count(DISTINCT d.doc_id)::BIGINT AS n FROM (SELECT DISTINCT project_id FROM documents WHERE project_id IS NOT NULL UNION SELECT DISTINCT project_id FROM memories WHERE project_id IS NOT NULL) p LEFT JOIN documents d USING (project_id) GROUP BY 1")
def member_counts(spark, d):
    docs = table(spark, d, "documents").filter("project_id IS NOT NULL")
    projects = docs.select("project_id").union(table(spark, d, "memories").filter("project_id IS NOT NULL").select("project_id")).distinct()
    n = docs.groupBy("project_id").agg(F.countDistinct("doc_id").alias("n"))
    return projects.join(n, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "system_stats",
    """SELECT (SELECT count(DISTINCT thread_id) FROM thread_messages)::BIGINT AS threads, (SELECT count(DISTINCT message_id) FROM thread_messages)::BIGINT AS messages, (SELECT count(DISTINCT memory_id) FROM memories)::BIGINT AS memories, (SELECT count(DISTINCT memory_id) FROM memories WHERE deleted_at IS NULL)::BIGINT AS live_memories,
    (SELECT count(DISTINCT report_id) FROM message_reports)::BIGINT AS reports, (SELECT count(DISTINCT report_id) FROM message_reports WHERE resolved_at IS NULL)::BIGINT AS open_reports, (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(DISTINCT project_id) FROM documents)::BIGINT AS projects""",
)
def system_stats(spark, d):
    m = table(spark, d, "thread_messages").agg(F.countDistinct("thread_id").alias("threads"), F.countDistinct("message_id").alias("messages"))
    k = table(spark, d, "memories").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct(F.when(F.col("deleted_at").isNull(), F.col("memory_id"))).alias("live_memories"))
    r = table(spark, d, "message_reports").agg(F.countDistinct("report_id").alias("reports"), F.countDistinct(F.when(F.col("resolved_at").isNull(), F.col("report_id"))).alias("open_reports"))
    x = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("project_id").alias("projects"))
    return m.join(F.broadcast(k)).join(F.broadcast(r)).join(F.broadcast(x))  # one row each


@query("seven_day_active", "SELECT count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS events FROM events, (SELECT max(ts) AS t FROM events) WHERE ts > t - INTERVAL 7 DAY")
def seven_day_active(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("t"))
    return e.join(F.broadcast(last), F.col("ts") > F.col("t") - F.expr("INTERVAL 7 DAYS")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))


@query("title_search", "SELECT doc_id, title FROM documents WHERE contains(lower(title), 'req') ORDER BY created_at DESC, doc_id LIMIT 30")
def title_search(spark, d):
    """The thirty newest titles that hold a text. The limit is the feature."""
    return table(spark, d, "documents").filter(F.contains(F.lower("title"), F.lit("req"))).orderBy(F.desc("created_at"), "doc_id").limit(30).select("doc_id", "title")


@query("open_reports", "SELECT DISTINCT report_id, owner_user_id, reason FROM message_reports WHERE resolved_at IS NULL")
def open_reports(spark, d):
    return table(spark, d, "message_reports").filter("resolved_at IS NULL").select("report_id", "owner_user_id", "reason").distinct()


@query("reports_by_owner", "SELECT owner_user_id, count(DISTINCT report_id)::BIGINT AS n, count(DISTINCT CASE WHEN resolved_at IS NULL THEN report_id END)::BIGINT AS open FROM message_reports GROUP BY 1")
def reports_by_owner(spark, d):
    return table(spark, d, "message_reports").groupBy("owner_user_id").agg(F.countDistinct("report_id").alias("n"), F.countDistinct(F.when(F.col("resolved_at").isNull(), F.col("report_id"))).alias("open"))


@query(
    "upload_outcomes",
    f"""WITH f AS (SELECT project_id, sha256(text) AS h, min(doc_id) AS file FROM documents WHERE text IS NOT NULL AND project_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT f.*, d.created_at AS trashed_at, d.lang FROM f JOIN documents d ON d.doc_id = f.file),
    s AS (SELECT project_id, h, min(CASE WHEN lang IS NOT NULL OR trashed_at IS NULL THEN 1 WHEN epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(trashed_at) <= 604800000000 THEN 2 ELSE 3 END) AS s FROM x GROUP BY 1, 2)
    SELECT d.doc_id AS upload_id, CASE coalesce(s.s, 4) WHEN 1 THEN 'duplicate' WHEN 2 THEN 'restored' WHEN 3 THEN 'purged_then_indexed' ELSE 'indexed' END AS outcome FROM documents d LEFT JOIN s ON s.project_id = d.project_id AND s.h = sha256(d.text)""",
)
def upload_outcomes(spark, d):
    docs = table(spark, d, "documents").withColumn("content_hash", F.sha2("text", 256))
    files = docs.filter("text IS NOT NULL AND project_id IS NOT NULL").groupBy("project_id", "content_hash").agg(F.min_by(F.struct("created_at", "lang"), "doc_id").alias("f"))
    files = files.select("project_id", "content_hash", F.when(F.col("f.lang").isNull(), F.col("f.created_at")).alias("trashed_at"), F.lit("completed").alias("status"))
    return relational.upload_outcomes(docs.select(F.col("doc_id").alias("upload_id"), "project_id", "content_hash"), files, _as_of())


@query(
    "status_steps",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, ts FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
    SELECT event_id, coalesce((before IS NULL AND status = 'pending') OR (before = 'pending' AND status = 'processing') OR (before = 'processing' AND status IN ('completed', 'failed')) OR (before IN ('failed', 'completed') AND status = 'processing'), false) AS legal FROM l""",
)
def status_steps(spark, d):
    kind = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select("user_id", "event_id", "ts", kind.alias("status"))
    return relational.status_steps(e, "user_id", "status", ["ts", "event_id"]).select("event_id", F.coalesce("legal", F.lit(False)).alias("legal"))


@query("report_snapshots", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt), k AS (SELECT * FROM r WHERE rn <= 4) SELECT thread_id, count(*)::BIGINT AS n, md5(string_agg(role || chr(31) || coalesce(content, ''), chr(30) ORDER BY position)) AS digest FROM k GROUP BY 1")
def report_snapshots(spark, d):
    s = relational.report_snapshot(table(spark, d, "thread_messages"), 4).withColumn("m", F.from_json("conversation", "array<struct<role string, content string>>"))
    return s.select("thread_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\x1f"), x["content"])), "\x1e")).alias("digest"))


@query("tenant_reassign", "SELECT owner, count(*)::BIGINT AS n FROM (SELECT DISTINCT memory_id, CASE WHEN owner_user_id IN (SELECT owner_user_id FROM message_reports) THEN 'claimed:' || owner_user_id ELSE owner_user_id END AS owner FROM memories) GROUP BY 1")
def tenant_reassign(spark, d):
    mapping = table(spark, d, "message_reports").filter("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("old"), F.concat(F.lit("claimed:"), "owner_user_id").alias("new"))
    moved = relational.reassign(table(spark, d, "memories").select("memory_id", "owner_user_id").distinct(), "owner_user_id", mapping)
    return moved.groupBy(F.col("owner_user_id").alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query("tenant_documents", "SELECT project_id, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE project_id IS NOT NULL AND lang = 'en' GROUP BY 1, 2")
def tenant_documents(spark, d):
    return table(spark, d, "documents").filter("project_id IS NOT NULL AND lang = 'en'").groupBy("project_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "rate_limit_replay",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, 0::BIGINT AS rn, []::DOUBLE[] AS hits, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::DOUBLE AS wait FROM (SELECT DISTINCT user_id FROM e)
    UNION ALL SELECT user_id, rn, CASE WHEN least(c1, c2) >= 1 THEN list_append(kept, t) ELSE kept END, event_id, c1 >= 1 AND c2 >= 1, greatest(CASE WHEN c1 < 1 THEN kept[len(kept) - 1] + 259200 - t ELSE 0 END, CASE WHEN c2 < 1 THEN kept[len(kept) - 2] + 864000 - t ELSE 0 END)
    FROM (SELECT e.user_id, e.rn, e.event_id, e.t, list_filter(w.hits, lambda x: x > e.t - 864000) AS kept, 2 - len(list_filter(w.hits, lambda x: x > e.t - 259200)) AS c1, 3 - len(list_filter(w.hits, lambda x: x > e.t - 864000)) AS c2 FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
    SELECT user_id AS bucket, event_id AS key, allowed, round(wait, 6) AS wait FROM w WHERE rn > 0""",
)
def rate_limit_replay(spark, d):
    """Two rules: two calls in three days and three in ten."""
    return limits.replay(table(spark, d, "events"), "user_id", "ts", "event_id", ((2, 259_200.0), (3, 864_000.0)))


# --- extras on the star schema ----------------------------------------------------------------------------------------


@query("revenue_rollup", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("region_revenue", "SELECT r_name, count(DISTINCT o_orderkey)::BIGINT AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def customers_without_orders(spark, d):
    """Customers without an urgent order."""
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "session_windows",
    """WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS events FROM s GROUP BY user_id, n""",
)
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.unix_micros("w.start").alias("start_us"), "events")


@query("event_props", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.sum(k).alias("k"))


@query("shared_projects", "SELECT project_id FROM documents WHERE project_id IS NOT NULL INTERSECT SELECT project_id FROM memories WHERE project_id IS NOT NULL")
def shared_projects(spark, d):
    return table(spark, d, "documents").filter("project_id IS NOT NULL").select("project_id").intersect(table(spark, d, "memories").filter("project_id IS NOT NULL").select("project_id"))
