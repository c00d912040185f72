"""Queries of the retrieval chain with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import stage, table
from ..functions import text as T
from ..operators import chain, history, retrieval, structure
from . import sqltext as S
from .queries import _LEAVES, _POSTS, _TURNS, AS_OF, SQL, _as_of, leaves, query

_C = "c AS (SELECT DISTINCT chunk_id, doc_id, owner_user_id, project_id, level, source_text, parent_id, child_ids, section_path, source_block_ids, citable, language FROM chunks)"


def _chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "doc_id", "owner_user_id", "project_id", "level", "source_text", "parent_id", "child_ids", "section_path", "source_block_ids", "citable", "language").dropDuplicates(["chunk_id"])


@query("tenant_chunks", f"WITH {_C}, t AS (SELECT min(owner_user_id) AS o FROM chunks) SELECT project_id, level, count(*)::BIGINT AS n FROM c, t WHERE owner_user_id = o AND doc_id NOT IN (SELECT doc_id FROM c GROUP BY 1 HAVING count(*) > 40) GROUP BY 1, 2")
def tenant_chunks(spark, d):
    """The chunks of one owner without those of the documents of more than 40 chunks."""
    c = _chunks(spark, d)
    owner = c.agg(F.min("owner_user_id").alias("o")).first().o
    long = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 40")
    return chain.without_documents(chain.tenant(c, owner, None), long).groupBy("project_id", "level").agg(F.count(F.lit(1)).alias("n"))


_CITED = "SELECT DISTINCT thread_id, json_extract_string(x, '$.chunk_id') AS chunk_id FROM (SELECT thread_id, unnest(json_extract(citations::JSON, '$[*]')) AS x FROM thread_messages WHERE json_valid(citations) AND citations LIKE '[{%') WHERE json_extract_string(x, '$.chunk_id') IS NOT NULL"


def _cited(spark, d):
    m = table(spark, d, "thread_messages").filter("citations LIKE '[{%'").select("thread_id", F.explode(F.from_json("citations", "array<string>")).alias("x"))
    return m.select("thread_id", F.get_json_object("x", "$.chunk_id").alias("chunk_id")).filter("chunk_id IS NOT NULL").distinct()


@query("fetched_chunks", f"WITH {_C}, w AS ({_CITED}), a AS (SELECT chunk_id, min(owner_user_id) AS owner_user_id FROM (SELECT w.chunk_id, r.owner_user_id FROM w JOIN message_reports r USING (thread_id)) GROUP BY 1) SELECT chunk_id, doc_id FROM c SEMI JOIN a USING (chunk_id, owner_user_id)")
def fetched_chunks(spark, d):
    """Chunks that reported threads cite, if they belong to whoever reported."""
    asked = _cited(spark, d).join(table(spark, d, "message_reports").select("thread_id", "owner_user_id"), "thread_id").groupBy("chunk_id").agg(F.min("owner_user_id").alias("owner_user_id"))
    return chain.fetched(_chunks(spark, d), asked, ["owner_user_id"]).select("chunk_id", "doc_id")


@query("owned_citations", f"WITH {_C}, w AS ({_CITED}) SELECT w.thread_id, w.chunk_id, c.chunk_id IS NOT NULL AS found, c.owner_user_id FROM w LEFT JOIN c USING (chunk_id)")
def owned_citations(spark, d):
    c = _chunks(spark, d).select("chunk_id", "owner_user_id", F.lit(True).alias("__f"))
    return _cited(spark, d).join(c, "chunk_id", "left").select("thread_id", "chunk_id", F.coalesce("__f", F.lit(False)).alias("found"), "owner_user_id")


@query("chunks_by_block", f"WITH {_C}, h AS (SELECT DISTINCT chunk_id, unnest(source_block_ids) AS block_id FROM c WHERE level = 'leaf' AND citable), b AS (SELECT DISTINCT block_id FROM blocks WHERE type = 'paragraph') SELECT block_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY chunk_id) AS n FROM h SEMI JOIN b USING (block_id)) WHERE n <= 2")
def chunks_by_block(spark, d):
    return chain.holding_blocks(_chunks(spark, d), table(spark, d, "blocks").filter("type = 'paragraph'"), 2)


@query("chunk_parents", f"WITH {_C} SELECT doc_id, chunk_id, parent_id FROM c WHERE level <> 'document'")
def chunk_parents(spark, d):
    """What a document's chunks hang on, read as three columns."""
    return _chunks(spark, d).filter("level <> 'document'").select("doc_id", "chunk_id", "parent_id")


@query(
    "searchable_documents",
    """WITH f AS (SELECT project_id, title AS doc_id, CASE WHEN lang IS NULL THEN created_at END AS trashed_at, CASE WHEN source IS NULL THEN 'failed' ELSE 'completed' END AS status FROM documents WHERE project_id IS NOT NULL AND title IS NOT NULL),
    p AS (SELECT project_id, doc_id, bool_or(status = 'completed' AND trashed_at IS NULL) AS a, bool_or(trashed_at IS NOT NULL) AS t FROM f GROUP BY 1, 2)
    SELECT project_id, count(CASE WHEN a THEN 1 END)::BIGINT AS active, count(CASE WHEN t AND NOT a THEN 1 END)::BIGINT AS trashed, md5(string_agg(CASE WHEN a THEN doc_id END, '|' ORDER BY doc_id)) AS digest FROM p GROUP BY 1""",
)
def searchable_documents(spark, d):
    f = table(spark, d, "documents").filter("project_id IS NOT NULL AND title IS NOT NULL").select("project_id", F.col("title").alias("doc_id"), F.when(F.col("lang").isNull(), F.col("created_at")).alias("trashed_at"), F.when(F.col("source").isNull(), "failed").otherwise("completed").alias("status"))
    s = chain.searchable(f)
    return s.select("project_id", F.size("active").cast("long").alias("active"), F.size("trashed").cast("long").alias("trashed"), F.when(F.size("active") > 0, F.md5(F.array_join("active", "|"))).alias("digest"))


_TERMS = S.terms("text")


@query(
    "hybrid_search",
    f"""WITH doc AS (SELECT doc_id AS key, coalesce(project_id, '') AS tenant, coalesce(text, '') AS text, title FROM documents), q AS (SELECT key AS query, tenant, coalesce(title, '') AS question FROM doc WHERE key % 100 = 0),
    tf AS (SELECT key, term, count(*) AS tf, any_value(n) AS n FROM (SELECT key, len(t) AS n, unnest(t) AS term FROM (SELECT key, {_TERMS} AS t FROM doc)) GROUP BY 1, 2),
    post AS (SELECT key, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256.0::DOUBLE)) AS weight FROM tf), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    qt AS (SELECT query, tenant, term, count(*) AS qtf FROM (SELECT query, tenant, unnest({S.terms('question')}) AS term FROM q) GROUP BY 1, 2, 3),
    sp AS (SELECT query, post.key, sum(qtf * ln(((SELECT count(*) FROM doc) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * weight) AS score FROM qt JOIN df USING (term) JOIN post USING (term) JOIN doc ON doc.key = post.key AND doc.tenant = qt.tenant WHERE post.key <> query GROUP BY 1, 2),
    e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings), de AS (SELECT query, b.key, list_cosine_similarity(a.v, b.v) AS score FROM q JOIN e a ON a.key = q.query JOIN doc ON doc.tenant = q.tenant AND doc.key <> q.query JOIN e b ON b.key = doc.key),
    l AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM de UNION ALL SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) FROM sp),
    f AS (SELECT query, key, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l WHERE rank <= 20 GROUP BY 1, 2) SELECT query, key, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM f) WHERE rank <= 10""",
)
def hybrid_search(spark, d):
    """The queries are the documents whose id is divisible by 100, by title and vector, within their project, against all documents."""
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("project_id", F.lit("")).alias("tenant"), F.coalesce("text", F.lit("")).alias("text"), "title")
    asked = doc.filter("key % 100 = 0").select(F.col("key").alias("query"), "tenant", F.coalesce("title", F.lit("")).alias("question"))
    out = chain.hybrid(asked, doc.select("key", "tenant", "text"), table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"), 10)
    return out.select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


# The chain over chunks: sparse candidates, routing, the scoped pass, rerank, references, merged scores, evidence.
def _bm25(k: int) -> str:
    return f"""{_POSTS}, q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.terms('question')}) AS term FROM (SELECT DISTINCT qid, question FROM requesta_items WHERE qid % 100 = 0)) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    sc AS (SELECT qid, chunk_id, sum(qtf * ln(((SELECT count(*) FROM leaf) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * weight) AS score FROM q JOIN df USING (term) JOIN post USING (term) GROUP BY 1, 2),
    hit AS (SELECT * FROM (SELECT qid AS query, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= {k})"""


def _hits(spark, d, k: int):
    asked = table(spark, d, "requesta_items").filter("qid % 100 = 0").select("qid", "question").distinct()
    return retrieval.sparse_search(asked, "qid", "question", leaves(spark, d), "chunk_id", "source_text", k).withColumnRenamed("qid", "query")


_OF = "of_doc AS (SELECT DISTINCT chunk_id, doc_id, owner_user_id FROM chunks)"
_ROUTE = "route AS (SELECT * FROM (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query, doc_id, max(score) AS score FROM hit JOIN of_doc USING (chunk_id) GROUP BY 1, 2)) WHERE rank <= 3)"


def _routed(spark, d):
    of = _chunks(spark, d).select("chunk_id", "doc_id")
    return chain.shortlist(_hits(spark, d, 20).join(of, "chunk_id"), "query", "doc_id", 3)


@query("document_routing", f"WITH {_bm25(20)}, {_OF}, {_ROUTE} SELECT query, doc_id, rank, round(score, 6) AS score FROM route")
def document_routing(spark, d):
    return _routed(spark, d).select("query", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("scoped_pass", f"WITH {_bm25(20)}, {_OF}, {_ROUTE}, t AS (SELECT DISTINCT query, owner_user_id FROM route JOIN of_doc USING (doc_id) WHERE rank = 1), a AS (SELECT DISTINCT t.query, o.doc_id FROM t JOIN of_doc o USING (owner_user_id)) SELECT DISTINCT query FROM a ANTI JOIN (SELECT * FROM route WHERE rank = 1) USING (query, doc_id)")
def scoped_pass(spark, d):
    """The questions whose best document is not all that its owner has."""
    of = _chunks(spark, d).select("doc_id", "owner_user_id").distinct()
    routed = _routed(spark, d)
    best = routed.filter("rank = 1").join(of, "doc_id").select("query", "owner_user_id").distinct()
    return retrieval.routed_elsewhere(best.join(of, "owner_user_id").select("query", "doc_id").distinct(), routed.filter("rank = 1").select("query", "doc_id"), "query")


_RERANKED = f"""rr AS (SELECT query, chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, place) AS rank FROM (SELECT h.query, h.chunk_id, h.rank AS place, coalesce(CASE WHEN len({S.words('question')}) > 0 THEN round({S.overlap(S.words('source_text'), S.words('question'))}::DOUBLE / len({S.words('question')}), 6) END, 0.0) AS score
    FROM hit h JOIN (SELECT DISTINCT qid, question FROM requesta_items) i ON i.qid = h.query JOIN leaf USING (chunk_id)))"""


def _reranked(spark, d, most: int):
    pool = _hits(spark, d, 20).select("query", F.col("chunk_id").alias("key"), F.col("rank").alias("place"))
    asked = table(spark, d, "requesta_items").select(F.col("qid").alias("query"), "question").distinct()
    return chain.rerank(pool, asked, leaves(spark, d).select(F.col("chunk_id").alias("key"), F.col("source_text").alias("text")), most)


@query("rerank_overlap", f"WITH {_bm25(20)}, {_RERANKED} SELECT query, chunk_id AS key, rank, score FROM rr WHERE rank <= 10")
def rerank_overlap(spark, d):
    return _reranked(spark, d, 10).select("query", "key", F.col("rank").cast("long").alias("rank"), "score")


_BLOCK_REFS = "ref AS (SELECT x.chunk_id AS key, lead(x.first) OVER (PARTITION BY x.doc_id ORDER BY x.chunk_id) AS block_id FROM (SELECT DISTINCT chunk_id, doc_id, source_block_ids[1] AS first FROM chunks WHERE level = 'leaf' AND citable) x), held AS (SELECT DISTINCT chunk_id AS key, unnest(source_block_ids) AS block_id FROM chunks WHERE level = 'leaf' AND citable)"


@query(
    "reference_expansion",
    f"""WITH {_bm25(20)}, {_BLOCK_REFS}, b AS (SELECT query, block_id, max(score) AS weight FROM hit JOIN ref ON ref.key = hit.chunk_id WHERE hit.rank <= 5 AND block_id IS NOT NULL GROUP BY 1, 2), hv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, block_id) AS n FROM b) WHERE n <= 4),
    k AS (SELECT hv.query, held.key, max(weight) AS weight FROM hv JOIN held USING (block_id) WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.query = hv.query AND hit.chunk_id = held.key AND hit.rank <= 5) GROUP BY 1, 2) SELECT query, key, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, key) AS n FROM k) WHERE n <= 2""",
)
def reference_expansion(spark, d):
    """Each leaf refers to the first block of the next leaf of its document, as the test data holds no references."""
    from pyspark.sql import Window

    leaf = _chunks(spark, d).filter("level = 'leaf' AND citable")
    refs = leaf.select(F.col("chunk_id").alias("key"), F.lead(F.get("source_block_ids", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("chunk_id")).alias("block_id")).filter("block_id IS NOT NULL")
    held = leaf.select(F.col("chunk_id").alias("key"), F.explode("source_block_ids").alias("block_id")).distinct()
    picked = _hits(spark, d, 5).select("query", F.col("chunk_id").alias("key"), "score")
    return retrieval.expand_references(picked, refs, held, 2).select("query", "key", F.round("weight", 6).alias("weight"))


_BELOW = "RECURSIVE tree AS (SELECT DISTINCT chunk_id, level, child_ids FROM chunks), ed AS (SELECT x.chunk_id, x.child, x.place FROM (SELECT chunk_id, unnest(child_ids) AS child, generate_subscripts(child_ids, 1) - 1 AS place FROM tree WHERE level <> 'leaf') x), dw AS (SELECT chunk_id AS root_id, chunk_id AS node, level, '' AS path FROM tree UNION ALL SELECT dw.root_id, ed.child, tree.level, dw.path || lpad(ed.place::VARCHAR, 5, '0') FROM dw JOIN ed ON ed.chunk_id = dw.node JOIN tree ON tree.chunk_id = ed.child), below AS (SELECT root_id, node AS leaf_id, min(path) AS path FROM dw WHERE level = 'leaf' GROUP BY 1, 2)"
_CHOSEN = "par AS (SELECT DISTINCT chunk_id, parent_id FROM chunks), chosen AS (SELECT DISTINCT query, coalesce(parent_id, chunk_id) AS chunk_id FROM hit JOIN par USING (chunk_id)), ms AS (SELECT c.query, c.chunk_id, coalesce(max(h.score), 0.0) AS score, coalesce(min(h.rank), any_value(n.n) + 1) AS rank FROM chosen c JOIN (SELECT query, count(*) AS n FROM hit GROUP BY 1) n USING (query) LEFT JOIN below b ON b.root_id = c.chunk_id LEFT JOIN hit h ON h.query = c.query AND h.chunk_id = b.leaf_id GROUP BY 1, 2)"


def _merged(spark, d):
    hits = stage(_hits(spark, d, 20))
    c = table(spark, d, "chunks")
    up = c.select("chunk_id", "parent_id").distinct()
    chosen = hits.join(up, "chunk_id").select("query", F.coalesce("parent_id", "chunk_id").alias("chunk_id"))
    below = retrieval.descendant_leaves(c, chosen)
    return chain.merged_scores(chosen, hits, below), below


@query("merged_scores", f"WITH {_BELOW}, {_bm25(20)}, {_CHOSEN} SELECT query, chunk_id, round(score, 6) AS score, rank::BIGINT AS rank FROM ms")
def merged_scores(spark, d):
    """The parents of all hits stand for what a merge chose."""
    return _merged(spark, d)[0].select("query", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _climb(n: int, of: str) -> str:
    """One step of a merge: the parent of the node last chosen takes the place of its chosen children where it has earned it."""
    get = lambda x, field: f"map_extract(m, {x})[1].{field}"
    up, kin, total = f"up{n}", f"kin{n}", f"spent{n}"
    return f"""c{n} AS (SELECT * EXCLUDE (chosen, node, active), CASE WHEN ok{n} THEN list_append(list_filter(chosen, lambda x: {get("x", "p")} IS DISTINCT FROM {up}), {up}) ELSE chosen END AS chosen, CASE WHEN ok{n} THEN {up} ELSE node END AS node, ok{n} AS active FROM (
    SELECT *, coalesce(active AND map_contains(m, {up}) AND len({kin}) >= 2 AND 3 * list_sum(list_transform({kin}, lambda x: {get("x", "ch")})) * 4000 >= {get(up, "ch")} * (4000 + {total}) AND {get(up, "t")} - list_sum(list_transform({kin}, lambda x: {get("x", "t")})) <= 4000 - {total}, false) AS ok{n} FROM (
    SELECT *, list_filter(chosen, lambda x: {get("x", "p")} = {up}) AS {kin}, coalesce(list_sum(list_transform(chosen, lambda x: {get("x", "t")})), 0) AS {total} FROM (SELECT *, {get("node", "p")} AS {up} FROM {of}))))"""


_CLIMBED = f"WITH {_climb(1, 'c0')}, {_climb(2, 'c1')} SELECT query, k, chosen, merges + ok1::INTEGER + ok2::INTEGER AS merges, stopped OR coalesce(list_sum(list_transform(chosen, lambda x: map_extract(m, x)[1].t)), 0) >= 4000 AS stopped, m FROM c2"
_MERGED = f"""sz AS (SELECT DISTINCT chunk_id, parent_id AS p, len(child_ids) AS c, length(source_text) AS ch, {S.n_tokens("coalesce(source_text, '')")} AS t FROM chunks), own AS (SELECT query, chunk_id FROM hit UNION SELECT query, sz.p FROM hit JOIN sz USING (chunk_id) WHERE sz.p IS NOT NULL UNION SELECT query, s2.p FROM hit JOIN sz USING (chunk_id) JOIN sz s2 ON s2.chunk_id = sz.p WHERE s2.p IS NOT NULL),
    maps AS (SELECT query, map_from_entries(list(struct_pack(k := sz.chunk_id, v := struct_pack(p := sz.p, c := sz.c, ch := sz.ch, t := sz.t)))) AS m FROM own JOIN sz USING (chunk_id) GROUP BY 1),
    am AS (SELECT query, 0::BIGINT AS k, []::VARCHAR[] AS chosen, 0 AS merges, false AS stopped, m FROM maps UNION ALL SELECT * FROM (WITH c0 AS (SELECT query, k, m, merges, stopped, CASE WHEN skip THEN chosen ELSE list_append(chosen, node) END AS chosen, node, NOT skip AS active FROM (
    SELECT *, stopped OR list_contains(chosen, chunk_id) OR coalesce(list_contains(chosen, u1), false) OR coalesce(list_contains(chosen, u2), false) AS skip, CASE WHEN map_contains(m, u1) AND map_extract(m, u1)[1].c = 1 THEN u1 ELSE chunk_id END AS node FROM (SELECT *, map_extract(m, u1)[1].p AS u2 FROM (SELECT am.query, hit.rank AS k, am.chosen, am.merges, am.stopped, am.m, hit.chunk_id, map_extract(am.m, hit.chunk_id)[1].p AS u1 FROM am JOIN hit ON hit.query = am.query AND hit.rank = am.k + 1)))), {_CLIMBED[5:]})),
    fin AS (SELECT query, chosen, merges FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k DESC) AS z FROM am) WHERE z = 1)"""
SQL["auto_merge"] = f"WITH {_BELOW}, {_bm25(30)}, {_MERGED} SELECT query, place, chunk_id, coalesce(n, 0)::INTEGER AS n_leaves, merges FROM (SELECT query, merges, unnest(chosen) AS chunk_id, (generate_subscripts(chosen, 1) - 1)::INTEGER AS place FROM fin) LEFT JOIN (SELECT root_id AS chunk_id, count(*) AS n FROM below GROUP BY 1) USING (chunk_id)"


@query("evidence_leaves", f"WITH {_BELOW}, {_bm25(20)}, {_CHOSEN}, ev AS (SELECT query, leaf_id, min(struct_pack(r := ms.rank::BIGINT, c := ms.chunk_id, p := path)) AS w FROM ms JOIN below ON root_id = ms.chunk_id GROUP BY 1, 2) SELECT query, leaf_id, row_number() OVER (PARTITION BY query ORDER BY w, leaf_id) AS place FROM ev")
def evidence_leaves(spark, d):
    scored, below = _merged(spark, d)
    return chain.evidence(scored, below).select("query", "leaf_id", F.col("place").cast("long").alias("place"))


@query("hit_projection", f"WITH {_bm25(5)} SELECT query, chunk_id, doc_id, level, round(score, 6) AS score, left(coalesce(c.source_text, ''), 120) AS snippet FROM hit JOIN (SELECT DISTINCT chunk_id, doc_id, level, source_text FROM chunks) c USING (chunk_id)")
def hit_projection(spark, d):
    return chain.projection(_hits(spark, d, 5), table(spark, d, "chunks"))


@query("context_size", f"WITH {_bm25(5)} SELECT query, count(*)::BIGINT AS hits, sum({S.n_tokens('source_text')})::BIGINT AS tokens FROM hit JOIN leaf USING (chunk_id) GROUP BY 1")
def context_size(spark, d):
    return chain.retrieval_row(_hits(spark, d, 5), table(spark, d, "chunks"))


@query("answer_context", f"WITH {_bm25(5)} SELECT query, md5(string_agg('[' || rank || '] ' || left(source_text, 200), chr(10) ORDER BY rank)) AS context FROM hit JOIN leaf USING (chunk_id) GROUP BY 1")
def answer_context(spark, d):
    """The extractive stand-in of an answer: numbered beginnings of the evidence."""
    j = _hits(spark, d, 5).join(leaves(spark, d), "chunk_id").select("query", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("source_text", 1, 200)).alias("line"))
    return j.groupBy("query").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")).alias("context"))


_PAGES = "list_sort(list_transform(list_filter(locators, lambda l: l.kind = 'page_bbox'), lambda l: l.page))"


@query(
    "index_texts",
    f"""WITH x AS (SELECT DISTINCT chunk_id, doc_id, section_path, {_PAGES} AS p, coalesce(source_text, '') AS t FROM chunks), b AS (SELECT *, concat_ws(' / ', nullif(doc_id, ''), CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' / ') END, CASE WHEN len(p) > 0 THEN CASE WHEN p[1] = p[-1] THEN 'page ' || p[1] ELSE 'page ' || p[1] || '-' || p[-1] END END) AS crumb FROM x)
    SELECT chunk_id, crumb, md5(concat_ws(chr(10), nullif(crumb, ''), t)) AS digest FROM b""",
)
def index_texts(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "section_path", F.transform(F.filter("locators", lambda x: x["kind"] == "page_bbox"), lambda x: x["page"]).alias("p"), F.coalesce("source_text", F.lit("")).alias("t")).distinct()
    whole = chain.index_text(F.col("doc_id"), F.col("section_path"), F.col("p"), F.col("t"))
    return c.select("chunk_id", chain.index_text(F.col("doc_id"), F.col("section_path"), F.col("p"), F.lit(None).cast("string")).alias("crumb"), F.md5(whole).alias("digest"))


@query("distinct_locators", "SELECT DISTINCT chunk_id, len(list_distinct(list_transform(locators, lambda l: l.kind || ':' || coalesce(l.page::VARCHAR, '') || ':' || coalesce(array_to_string(l.bbox, ','), ''))))::BIGINT AS n FROM chunks")
def distinct_locators(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.size(F.array_distinct("locators")).cast("long").alias("n")).distinct()


_UNITS = f"{_TURNS}, un AS (SELECT a.thread_id, a.position, a.thread_id || ':' || a.position AS unit, concat_ws(chr(10), coalesce(a.content, ''), CASE WHEN b.thread_id IS NOT NULL THEN coalesce(b.content, '') END) AS text FROM tt a LEFT JOIN tt b ON b.thread_id = a.thread_id AND b.position = a.position + 1 AND b.role = 'assistant' WHERE a.role = 'user')"


@query("conversation_units", f"WITH {_UNITS} SELECT thread_id, unit, position, md5(text) AS digest FROM un")
def conversation_units(spark, d):
    return chain.conversation_units(history.turns(table(spark, d, "thread_messages"))).select("thread_id", "unit", "position", F.md5("text").alias("digest"))


@query("retrieved_history", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY position DESC) AS rn FROM tt), h AS (SELECT thread_id, position FROM tt WHERE contains(lower(coalesce(content, '')), 'response')) SELECT thread_id, position, md5(content) AS digest FROM tt SEMI JOIN h USING (thread_id, position) ANTI JOIN (SELECT * FROM r WHERE rn <= 4) w USING (thread_id, position)")
def retrieved_history(spark, d):
    """Messages that a search names (those that hold a word) and the window of the newest four does not show."""
    t = history.turns(table(spark, d, "thread_messages"))
    hits = t.filter(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit("response")))
    return chain.outside_window(hits, history.newest(table(spark, d, "thread_messages"), 4), t).select("thread_id", "position", F.md5("content").alias("digest"))


@query("late_chunks", "WITH r AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4 AS piece, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, piece, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM r), m AS (SELECT label, piece, p, avg(x) AS x, count(*) AS n FROM x GROUP BY 1, 2, 3) SELECT label, piece::BIGINT AS piece, max(n)::BIGINT AS n, round(sum(x), 6) AS total, round(max(x), 6) AS top FROM m GROUP BY 1, 2")
def late_chunks(spark, d):
    p = chain.pooled(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 4)
    return p.select("label", "piece", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("embedding"), 6).alias("top"))


@query("seeded_sample", "SELECT qid, question FROM (SELECT DISTINCT qid, question FROM requesta_items) ORDER BY md5(concat_ws(':', qid::VARCHAR, '7')), qid LIMIT 50")
def seeded_sample(spark, d):
    """Fifty questions whatever their order. The limit is the feature."""
    return chain.seeded_sample(table(spark, d, "requesta_items").select("qid", "question").distinct(), "qid", 50, 7)


@query("sampled_corpus", f"WITH {_LEAVES}, j AS ({_CITED}), k AS (SELECT chunk_id FROM leaf ANTI JOIN j USING (chunk_id) ORDER BY md5(concat_ws(':', chunk_id, '7')), chunk_id LIMIT 40) SELECT chunk_id FROM leaf SEMI JOIN j USING (chunk_id) UNION ALL SELECT chunk_id FROM k")
def sampled_corpus(spark, d):
    """All cited leaves and forty others. The limit is the feature."""
    return chain.sampled_corpus(leaves(spark, d), _cited(spark, d), "chunk_id", 40, 7).select("chunk_id")


@query("embedding_fallback", "SELECT doc_id, vec_id IS NOT NULL AS stored FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_fallback(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chain.with_fallback(docs, table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), "embedding"), "doc_id", "embedding", "text", 64).select("doc_id", "stored")


def _tree_units(spark, d):
    from .queries import _blocks

    groups = structure.section_groups(_blocks(spark, d)).select("doc_id", "group", "n_blocks")
    return groups


_GROUPS = """r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_order NULLS FIRST, block_id NULLS FIRST) - 1 AS rank FROM (SELECT DISTINCT doc_id, block_id, block_order, section_path FROM blocks)), t AS (SELECT doc_id, rank, CASE WHEN array_to_string(section_path, ' / ') = lag(array_to_string(section_path, ' / ')) OVER (PARTITION BY doc_id ORDER BY rank) THEN 0 ELSE 1 END AS turn FROM r),
    g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM t), s AS (SELECT doc_id, grp::BIGINT AS grp, count(*) AS n FROM g GROUP BY 1, 2)"""


@query(
    "packed_requests",
    f"""WITH RECURSIVE {_GROUPS}, w AS (SELECT doc_id, 0::BIGINT AS grp, 0::BIGINT AS request, 12 - n AS room FROM s WHERE grp = 0 UNION ALL SELECT s.doc_id, s.grp, CASE WHEN s.n <= w.room THEN w.request ELSE w.request + 1 END, CASE WHEN s.n <= w.room THEN w.room - s.n ELSE 12 - s.n END FROM w JOIN s ON s.doc_id = w.doc_id AND s.grp = w.grp + 1) SELECT doc_id, grp AS "group", request FROM w""",
)
def packed_requests(spark, d):
    """Section groups of a document packed into requests of twelve blocks."""
    return chain.packed_requests(_tree_units(spark, d), "doc_id", "group", "n_blocks", 12)


@query(
    "citation_highlights",
    f"""WITH x AS (SELECT message_id, unnest(json_extract(citations::JSON, '$[*]')) AS x FROM (SELECT DISTINCT message_id, citations FROM thread_messages WHERE json_valid(citations) AND citations LIKE '[{{%')), cit AS (SELECT DISTINCT message_id || ':' || json_extract_string(x, '$.chunk_id') AS citation, json_extract_string(x, '$.doc_id') AS doc_id, unnest(json_extract_string(x, '$.block_ids[*]')) AS block_id FROM x),
    b AS (SELECT doc_id, block_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_order NULLS FIRST, block_id) AS rank FROM (SELECT DISTINCT doc_id, block_id, block_order, coalesce(text, '') AS text FROM blocks)), a AS (SELECT doc_id, block_id, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS n FROM b)
    SELECT citation, min(s)::BIGINT AS start, max(s + n)::BIGINT AS "end" FROM cit JOIN a USING (doc_id, block_id) GROUP BY 1""",
)
def citation_highlights(spark, d):
    """Anchors count the characters of the blocks of a document in order."""
    from ..frames import bucketed_sum
    from .queries import _blocks

    m = table(spark, d, "thread_messages").filter("citations LIKE '[{%'").select("message_id", F.explode(F.from_json("citations", "array<string>")).alias("x"))
    field = lambda name: F.get_json_object("x", f"$.{name}")
    cited = m.select(F.concat_ws(":", "message_id", field("chunk_id")).alias("citation"), field("doc_id").alias("doc_id"), F.explode(F.from_json(field("block_ids"), "array<string>")).alias("block_id")).distinct()
    b = _blocks(spark, d).select("doc_id", "block_id", "block_order", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    a = bucketed_sum(b, ["doc_id"], F.floor(F.col("block_order") / 1_024), [F.col("block_order").asc_nulls_first(), F.col("block_id")], F.col("n"), "start")
    return chain.highlight(cited, a.select("doc_id", "block_id", "start", (F.col("start") + F.col("n")).alias("end")))


@query(
    "edit_blocks",
    f"""WITH b AS (SELECT DISTINCT doc_id, block_id, block_order, text FROM blocks), e AS (SELECT doc_id, 'the ' AS value, any_value(g) AS gold FROM (SELECT doc_id, max(text) AS g FROM b GROUP BY 1) GROUP BY 1), h AS (SELECT e.doc_id AS edit, b.block_id, block_order, coalesce(CASE WHEN len({S.words('b.text')}) > 0 THEN round({S.overlap(S.words('gold'), S.words('b.text'))}::DOUBLE / len({S.words('b.text')}), 6) >= 0.5 END, false) AS rel FROM e JOIN b USING (doc_id) WHERE contains(lower(b.text), 'the '))
    SELECT edit, arg_min(block_id, struct_pack(a := NOT rel, b := block_order, c := block_id)) AS block_id FROM h GROUP BY 1""",
)
def edit_blocks(spark, d):
    from .queries import _blocks

    b = _blocks(spark, d).select("doc_id", "block_id", "block_order", "text")
    edits = b.groupBy("doc_id").agg(F.max("text").alias("gold")).select(F.col("doc_id").alias("edit"), "doc_id", F.lit("the ").alias("value"), "gold")
    return chain.choose_block(b, edits)


@query(
    "reindex_costs",
    f"""WITH c AS (SELECT DISTINCT chunk_id, parent_id, confidence, {S.n_tokens("coalesce(source_text, '')")} AS n FROM chunks), x AS (SELECT chunk_id, n, coalesce(confidence, 1) >= 0.9 AS stays FROM c) SELECT CASE WHEN stays THEN 'kept' ELSE 'stale' END AS state, count(*)::BIGINT AS chunks, sum(n)::BIGINT AS tokens FROM x GROUP BY 1""",
)
def reindex_costs(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "parent_id", "confidence", T.n_tokens(F.coalesce("source_text", F.lit(""))).alias("n_tokens")).distinct()
    diff = structure.edit_diff(c.select("chunk_id", "parent_id"), c.filter(F.coalesce("confidence", F.lit(1.0)) >= 0.9).select("chunk_id", "parent_id"), "chunk_id", "parent_id")
    return chain.reindex_cost(diff, c.select("chunk_id", "n_tokens"), "chunk_id")


@query("chunk_configs", f"WITH {_C} SELECT 'leaf' AS config, count(*)::BIGINT AS n FROM c WHERE level = 'leaf' UNION ALL SELECT 'section', count(*) FROM c WHERE level = 'section' UNION ALL SELECT 'without_prefix', count(DISTINCT md5(source_text)) FROM c WHERE level = 'leaf' UNION ALL SELECT 'document', count(*) FROM c WHERE level = 'document'")
def chunk_configs(spark, d):
    """One row for each way of chunking, as a union with the name of the configuration."""
    c = _chunks(spark, d)
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("config"), "n")
    bare = c.filter("level = 'leaf'").agg(F.countDistinct(F.md5("source_text")).alias("n")).select(F.lit("without_prefix").alias("config"), "n")
    return one("leaf", c.filter("level = 'leaf'")).unionByName(one("section", c.filter("level = 'section'"))).unionByName(bare).unionByName(one("document", c.filter("level = 'document'")))


__all__ = ["AS_OF", "_as_of"]
