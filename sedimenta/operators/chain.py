"""The retrieval chain over many questions at once: tenants, routing, fusion, rerank, merging, references, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import answers, retrieval


def tenant(df: DataFrame, owner: str | None, project: str | None) -> DataFrame:
    """The rows of one owner and project; every read of the index goes through this. Null stands for no restriction."""
    if owner is not None:
        df = df.filter(F.col("owner_user_id") == owner)
    return df if project is None else df.filter(F.col("project_id") == project)


def without_documents(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """The rows whose document is not excluded; the list of documents joins like any table, so it may be long."""
    return df.join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")


def fetched(chunks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks asked for by (chunk_id, keys), each checked again for the keys of whoever asks."""
    return chunks.join(wanted.select("chunk_id", *keys).distinct(), ["chunk_id", *keys], "left_semi")


def holding_blocks(chunks: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(block_id, chunk_id): the citable leaves that hold each block, the first ``most`` by id."""
    held = chunks.filter("level = 'leaf' AND citable").select("chunk_id", F.explode("source_block_ids").alias("block_id")).distinct().join(blocks.select("block_id").distinct(), "block_id", "left_semi")
    return held.withColumn("n", F.row_number().over(Window.partitionBy("block_id").orderBy("chunk_id"))).filter(F.col("n") <= most).select("block_id", "chunk_id")


def searchable(files: DataFrame) -> DataFrame:
    """(project_id, active, trashed): the documents a question may and may not see, as sorted arrays.

    files: (project_id, doc_id, status, trashed_at). A document with an active file is active, whatever else it has.
    """
    active = (F.col("status") == "completed") & F.col("trashed_at").isNull()
    per = files.groupBy("project_id", "doc_id").agg(F.bool_or(F.coalesce(active, F.lit(False))).alias("a"), F.bool_or(F.col("trashed_at").isNotNull()).alias("t"))
    collect = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("doc_id"))))
    return per.groupBy("project_id").agg(collect(F.col("a")).alias("active"), collect(F.col("t") & ~F.col("a")).alias("trashed"))


def shortlist(ranked: DataFrame, query: str, doc: str, most: int) -> DataFrame:
    """(query, doc, rank, score): the documents of the best chunks, a document standing for its best one."""
    best = ranked.groupBy(query, doc).agg(F.max("score").alias("score"))
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), doc)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(query, doc, "rank", "score")


def rerank(pool: DataFrame, questions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query, key, rank, score): the pool ordered by the share of the question's words that a chunk holds.

    A stand-in for a reranking model with its contract: every index of the pool comes back once, scores are finite, ties
    go to the place in the pool. pool: (query, key, place); questions: (query, question); chunks: (key, text).
    """
    scored = pool.join(questions, "query").join(chunks, "key").withColumn("score", F.coalesce(answers.held_share(F.col("text"), F.col("question")), F.lit(0.0)))
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "place")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query", "key", "rank", "score")


def hybrid(queries: DataFrame, documents: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, key, rank, score): within the tenant of each query, the 2k best by vector and the 2k best by words, fused.

    queries: (query, tenant, question); documents: (key, tenant, text); vectors: (key, embedding). A query is the vector of
    its own id and never finds itself. Both legs are filtered to the tenant before they are cut.
    """
    of = documents.select(F.col("key"), F.col("tenant").alias("__t"))
    mine = queries.select(F.col("query"), F.col("tenant"))
    asked = vectors.join(mine, vectors["key"] == mine["query"]).select("query", "tenant", F.col("embedding").cast("array<double>").alias("q"))
    held = vectors.join(of, "key").select(F.col("key"), F.col("__t"), F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(dot(c, c)))
    # A tenant may hold a third of the vectors: they are spread over parts that each meet the tenant's queries.
    parts = retrieval.SALTS
    spread = asked.select("query", "tenant", unit(F.col("q")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    placed = held.select("key", F.col("__t").alias("tenant"), unit(F.col("v")).alias("v"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    dense = retrieval.top_k(spread.join(placed, ["tenant", "part"]).filter("key <> query").select("query", "key", dot(F.col("q"), F.col("v")).alias("score")), "query", "key", 2 * k)
    sparse = retrieval.sparse_search(queries, "query", "question", documents, "key", "text", 2 * k, tenants=(queries.select("query", "tenant"), documents.select("key", "tenant")))
    lists = dense.select("query", "key", "rank", F.lit(0).alias("source")).unionByName(sparse.select("query", "key", "rank", F.lit(1).alias("source")))
    return retrieval.fuse(lists, "query", "key", k)


def merged_scores(chosen: DataFrame, hits: DataFrame, below: DataFrame) -> DataFrame:
    """(query, chunk_id, score, rank): a chosen chunk has the best score and the best rank of the hits below it.

    chosen: (query, chunk_id); hits: (query, chunk_id, rank, score); below: (root_id, leaf_id). Without a hit below, the
    score is 0 and the rank follows all hits of the query.
    """
    sizes = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    leaf = below.select(F.col("root_id").alias("chunk_id"), "leaf_id").join(chosen.select("query", "chunk_id").distinct(), "chunk_id")
    got = leaf.join(hits.select("query", F.col("chunk_id").alias("leaf_id"), "rank", "score"), ["query", "leaf_id"]).groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    out = chosen.select("query", "chunk_id").distinct().join(got, ["query", "chunk_id"], "left").join(sizes, "query", "left")
    return out.select("query", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1).cast("long").alias("rank"))


def evidence(scored: DataFrame, below: DataFrame) -> DataFrame:
    """(query, leaf_id, place): the citable leaves of the chosen chunks in rank order, each once, in document order within a chunk."""
    rows = scored.join(below.select(F.col("root_id").alias("chunk_id"), "leaf_id", "path"), "chunk_id")
    first = rows.groupBy("query", "leaf_id").agg(F.min(F.struct("rank", "chunk_id", "path")).alias("at"))
    return first.select("query", "leaf_id", F.row_number().over(Window.partitionBy("query").orderBy("at", "leaf_id")).alias("place"))


def projection(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, chunk_id, doc_id, level, score, snippet): what a caller sees of a hit; without a score it is 0."""
    c = chunks.select("chunk_id", "doc_id", "level", "source_text").dropDuplicates(["chunk_id"])
    return hits.join(c, "chunk_id").select("query", "chunk_id", "doc_id", "level", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.substring(F.coalesce("source_text", F.lit("")), 1, 120).alias("snippet"))


def index_text(title: Column, section_path: Column, pages: Column, text: Column) -> Column:
    """What is indexed of a chunk: title / sections / pages, a line end, and its text; parts that are missing leave no sign."""
    page = F.when(F.size(pages) > 0, F.when(F.array_min(pages) == F.array_max(pages), F.concat(F.lit("page "), F.array_min(pages).cast("string"))).otherwise(F.concat(F.lit("page "), F.array_min(pages).cast("string"), F.lit("-"), F.array_max(pages).cast("string"))))
    crumb = F.concat_ws(" / ", F.nullif(title, F.lit("")), F.when(F.size(section_path) > 0, F.array_join(section_path, " / ")), page)
    return F.concat_ws("\n", F.nullif(crumb, F.lit("")), text)


def conversation_units(turns: DataFrame) -> DataFrame:
    """(thread_id, unit, position, text): each user turn with the answer right behind it, as one text to search."""
    said = turns.filter("role = 'user'").select("thread_id", "position", F.coalesce("content", F.lit("")).alias("q"))
    reply = turns.filter("role = 'assistant'").select("thread_id", (F.col("position") - 1).alias("position"), F.coalesce("content", F.lit("")).alias("a"))
    u = said.join(reply, ["thread_id", "position"], "left")
    return u.select("thread_id", F.concat_ws(":", "thread_id", "position").alias("unit"), "position", F.concat_ws("\n", "q", "a").alias("text"))


def outside_window(hits: DataFrame, window: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, position, content): the messages that hits name and the window does not show."""
    return hits.select("thread_id", "position").distinct().join(window.select("thread_id", "position"), ["thread_id", "position"], "left_anti").join(turns.select("thread_id", "position", "content"), ["thread_id", "position"])


def pooled(vectors: DataFrame, group: str, order: str, vector: str, window: int) -> DataFrame:
    """(group, piece, n, embedding): mean vectors of runs of ``window`` neighbours (late chunking over given vectors)."""
    from ..frames import bucketed_rank

    r = bucketed_rank(vectors.select(group, order, F.col(vector).cast("array<double>").alias("v")), [group], F.floor(F.col(order) / 1_024), [F.col(order)], "n").withColumn("piece", F.floor(F.col("n") / window).cast("long"))
    each = r.select(group, "piece", F.posexplode("v").alias("at", "x")).groupBy(group, "piece", "at").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(group, "piece").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding"))


def seeded_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows whatever their order: those with the least hash of key and seed. The limit is the feature."""
    return rows.withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("__h", key).limit(size).drop("__h")


def sampled_corpus(passages: DataFrame, judged: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """All judged passages, and ``size`` of the others by seeded_sample."""
    have = judged.select(key).distinct()
    return passages.join(have, key, "left_semi").unionByName(seeded_sample(passages.join(have, key, "left_anti"), key, size, seed))


def highlight(citations: DataFrame, anchors: DataFrame) -> DataFrame:
    """(citation, start, end): from the first to the last anchor of the blocks that a citation names."""
    return citations.join(anchors, ["doc_id", "block_id"]).groupBy("citation").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def choose_block(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit, block_id): the block an edit goes to: one that holds the value, the relevant ones first, then the first in order.

    edits: (edit, doc_id, value, gold).
    """
    held = edits.join(blocks.select("doc_id", "block_id", "block_order", "text"), "doc_id").filter(F.contains(F.lower("text"), F.lower("value")))
    relevant = F.coalesce(answers.held_share(F.col("gold"), F.col("text")) >= answers.RELEVANT, F.lit(False))
    best = held.groupBy("edit").agg(F.min(F.struct((~relevant).alias("r"), "block_order", "block_id")).alias("b"))
    return best.select("edit", F.col("b.block_id").alias("block_id"))


def reindex_cost(diff: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(state, chunks, tokens) of an edit: what a partial index touches; the sum of all states but stale is the full cost."""
    return diff.join(sizes, key, "left").groupBy("state").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("tokens"))


def with_fallback(wanted: DataFrame, stored: DataFrame, key: str, vector: str, text: str, dimensions: int) -> DataFrame:
    """(key, embedding, stored): the stored vector of each key, or the hashed embedding of its text; only misses are embedded."""
    have = stored.select(key, F.col(vector).cast("array<double>").alias("embedding"))
    misses = retrieval.embed(wanted.join(have.select(key), key, "left_anti"), key, text, dimensions)
    return wanted.select(key).join(have, key).withColumn("stored", F.lit(True)).unionByName(misses.withColumn("stored", F.lit(False)))


def packed_requests(groups: DataFrame, doc: str, order: str, size: str, most: int) -> DataFrame:
    """(doc, order, request): groups packed in order into requests of at most ``most`` tokens; a larger one stands alone.

    A sequential fold for each document that holds the room left only.
    """
    from ..frames import fold_streams

    def step(state: list, row: tuple) -> list[tuple]:
        place, n = row
        state[:] = [state[0], state[1] - n] if state[0] >= 0 and n <= state[1] else [state[0] + 1, most - n]
        return [(place, state[0])]

    rows = groups.select(F.col(doc), F.col(order).cast("long").alias("place"), F.col(size).cast("long").alias("n"))
    out = fold_streams(rows, [doc], ["place"], lambda: [-1, 0], step, lambda s: [], ["place", "n"], f"{doc} {dict(groups.dtypes)[doc]}, place long, request long")
    return out.withColumnRenamed("place", order)


def retrieval_row(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, hits, tokens): how many chunks a question got and how many tokens its context has."""
    sized = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", T.n_tokens(F.coalesce("source_text", F.lit(""))).alias("n"))
    return ranked.join(sized, "chunk_id").groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.sum("n").alias("tokens"))
