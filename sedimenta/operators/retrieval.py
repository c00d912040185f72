"""Retrieval: sparse and dense search over many queries at once, fusion, pooling, cuts, merging along the chunk tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import in_groups, stage
from ..functions import text as T

#: Saturation and length normalisation of BM25, the pipeline's mean length, the fusion constant.
K1, B, MEAN_LENGTH, RRF_K = 1.2, 0.75, 256.0, 60
KEEP = 0.5
#: Vectors in a block of the blocked dense search.
BLOCK_ROWS = 2_048
#: Parts that the postings of a term are spread over when they meet the queries.
SALTS = 16


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): the term-frequency side of BM25 for each term of each chunk."""
    tokens = chunks.select(key, T.terms(F.col(text)).alias("t"))
    counted = tokens.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / MEAN_LENGTH))
    return counted.select(key, "term", weight.alias("weight"))


def top_k(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key, rank, score) of the k best for each query; scores are compared to nine digits, ties by key.

    The filter on the row number lets the engine limit each group before the shuffle.
    """
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query, key, "rank", "score")


def sparse_search(queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, text: str, k: int, tenants: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, key, rank, score): BM25 over all chunks; idf = ln((N - n + 0.5) / (n + 0.5) + 1).

    With ``tenants``, ((query, tenant), (key, tenant)), a query only meets the chunks of its tenant and not itself; the idf
    is that of the whole index.
    """
    posts = postings(chunks, key, text)
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    asked = queries.select(query, F.explode(T.terms(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
    # Only the postings of asked terms go on.
    hits = posts.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total))
    idf = df.select("term", F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    on, mine = ["term", "salt"], asked
    if tenants:
        mine, hits, on = asked.join(tenants[0].select(query, "tenant"), query), hits.join(tenants[1].select(key, "tenant"), key), ["term", "salt", "tenant"]
    # A term may stand in a third of all chunks: its postings are spread over SALTS parts, which each meet the queries.
    spread = mine.join(idf, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = spread.join(hits.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")), on)
    if tenants:
        met = met.filter(F.col(query) != F.col(key))
    scored = met.groupBy(query, key).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("weight")).alias("score"))
    return top_k(scored, query, key, k)


def _packed(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows packed into blocks of about BLOCK_ROWS vectors: (block, ids, vectors)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    numbered = rows.withColumn("block", F.concat_ws(":", F.spark_partition_id().cast("string"), F.floor(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) / BLOCK_ROWS).cast("string")))
    return numbered.groupBy("block").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vs")).drop("block")


def dense_search(queries: DataFrame, query: str, query_vector: str, vectors: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """(query, key, rank, score): exact search in blocks: every block of queries meets every block of vectors.

    A pair of blocks is one matrix product and leaves its k best for each query; those are merged by rank.
    """
    q, v = _packed(queries, query, query_vector, "q"), _packed(vectors, key, vector, "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a, b = np.array(list(map(list, row.q_vs)), dtype=np.float64), np.array(list(map(list, row.v_vs)), dtype=np.float64)
                if metric == "cosine":
                    a, b = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300), b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                score = a @ b.T
                ids = np.array(row.v_ids)
                for i, qid in enumerate(row.q_ids):
                    s = np.round(score[i], 9)
                    mine = ids != qid if skip_self else np.ones(len(ids), bool)
                    best = np.lexsort((ids[mine], -s[mine]))[:k]
                    out += [(qid, ids[mine][j], float(score[i][mine][j])) for j in best]
            yield pd.DataFrame(out, columns=["query", "key", "score"])

    kinds = dict(queries.dtypes)[query], dict(vectors.dtypes)[key]
    pairs = q.join(v).mapInPandas(run, f"query {kinds[0]}, key {kinds[1]}, score double")
    return top_k(pairs, "query", "key", k)


def fuse(lists: DataFrame, query: str, key: str, k: int, constant: int = RRF_K) -> DataFrame:
    """(query, key, rank, score): reciprocal rank fusion of (query, source, key, rank)."""
    scores = lists.groupBy(query, key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(scores, query, key, k)


def fill_pool(lists: DataFrame, query: str, source: str, key: str, rank: str, budget: int) -> DataFrame:
    """(query, key, place): candidates of several ranked lists, each once from its first list, taken in turns up to the budget."""
    first = lists.withColumn("n", F.row_number().over(Window.partitionBy(query, key).orderBy(source, rank))).filter("n = 1")
    place = first.withColumn("turn", F.row_number().over(Window.partitionBy(query, source).orderBy(rank, key)))
    order = Window.partitionBy(query).orderBy("turn", source)
    return place.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).select(query, key, "place")


def keep_ratio(ranked: DataFrame, query: str, share: float = KEEP) -> DataFrame:
    """The rows whose score is at least a share of their query's best; all of them where the best is not above 0."""
    best = ranked.groupBy(query).agg(F.max("score").alias("best"))
    return ranked.join(best, query).filter((F.col("best") <= 0) | (F.round("score", 9) >= F.round(share * F.col("best"), 9))).drop("best")


def routed_elsewhere(project_docs: DataFrame, routed_docs: DataFrame, query: str) -> DataFrame:
    """(query): the queries whose routed documents do not cover their project, which need the scoped pass."""
    all_of = project_docs.groupBy(query).agg(F.collect_set("doc_id").alias("a"))
    some = routed_docs.groupBy(query).agg(F.collect_set("doc_id").alias("b"))
    return all_of.join(some, query, "left").filter(F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))) > 0).select(query)


def ancestors(chunks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(chunk_id, ancestor_id, depth): the chain of parents of every chunk (or of those ``of`` names), however deep.

    Parents that are not among the rows end a chain. The frontier is joined once for each level until it is empty. A chunk that comes up again (a cycle) ends its chain.
    """
    c = stage(chunks.select("chunk_id", "parent_id").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("parent_id").alias("parent_id")))
    step = c.select(F.col("chunk_id").alias("ancestor_id"), F.col("parent_id").alias("next"))
    begin = c if of is None else c.join(of.select("chunk_id").distinct(), "chunk_id", "left_semi")
    front = begin.filter("parent_id IS NOT NULL").select("chunk_id", F.col("parent_id").alias("ancestor_id")).join(step, "ancestor_id").select("chunk_id", "ancestor_id", "next", F.array("ancestor_id").alias("path"))
    levels = []
    while True:
        front = stage(front)
        if front.isEmpty():
            break
        levels.append(front.select("chunk_id", "ancestor_id", F.lit(len(levels) + 1).alias("depth")))
        up = front.filter("next IS NOT NULL").select("chunk_id", F.col("next").alias("ancestor_id"), "path").join(step, "ancestor_id")
        front = up.filter(~F.array_contains("path", F.col("ancestor_id"))).select("chunk_id", "ancestor_id", "next", F.concat("path", F.array("ancestor_id")).alias("path"))
    out = levels[0] if levels else front.select("chunk_id", "ancestor_id", F.lit(1).alias("depth"))
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def descendant_leaves(chunks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(root_id, leaf_id, path): the leaves below each chunk (or below those ``of`` names), each once, by path in document order.

    A path is the place of the child on each level, five digits each. A leaf is below itself with an empty path. Children
    that are not among the rows are skipped; the frontier goes down until it is empty.
    """
    c = stage(chunks.select("chunk_id", "level", "child_ids").filter("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"]))
    edge = c.filter("level <> 'leaf'").select("chunk_id", F.posexplode("child_ids").alias("place", "child"))
    edge = edge.join(c.select(F.col("chunk_id").alias("child"), F.col("level").alias("child_level")), "child").select(F.col("chunk_id").alias("at"), "child", "child_level", F.lpad(F.col("place").cast("string"), 5, "0").alias("place"))
    begin = c if of is None else c.join(of.select("chunk_id").distinct(), "chunk_id", "left_semi")
    front = begin.select(F.col("chunk_id").alias("root_id"), F.col("chunk_id").alias("at"), F.col("level"), F.lit("").alias("path"), F.array("chunk_id").alias("seen"))
    levels = []
    while True:
        front = stage(front)
        if front.isEmpty():
            break
        levels.append(front.filter("level = 'leaf'").select("root_id", F.col("at").alias("leaf_id"), "path"))
        down = front.filter("level <> 'leaf'").join(edge, "at").filter(~F.array_contains("seen", F.col("child")))
        front = down.select("root_id", F.col("child").alias("at"), F.col("child_level").alias("level"), F.concat("path", "place").alias("path"), F.concat("seen", F.array("child")).alias("seen"))
    out = levels[0] if levels else front.select("root_id", F.col("at").alias("leaf_id"), "path")
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.groupBy("root_id", "leaf_id").agg(F.min("path").alias("path"))


def expand_references(selected: DataFrame, refs: DataFrame, blocks_of: DataFrame, cap: int) -> DataFrame:
    """(query, key, weight): chunks that hold blocks which the selected chunks refer to.

    selected: (query, key, score); refs: (key, block_id); blocks_of: (key, block_id). A block weighs as its best referrer;
    the 2*cap heaviest blocks count, and of the chunks that hold them and are not selected the cap heaviest.
    """
    by_block = selected.join(refs, "key").groupBy("query", "block_id").agg(F.max("score").alias("weight"))
    heavy = by_block.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "block_id"))).filter(F.col("n") <= 2 * cap)
    held = heavy.join(blocks_of, "block_id").groupBy("query", "key").agg(F.max("weight").alias("weight")).join(selected.select("query", "key"), ["query", "key"], "left_anti")
    return held.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "key"))).filter(F.col("n") <= cap).select("query", "key", "weight")


class Siblings:
    """The chosen chunks of one query, with running sums for each parent, so that a choice costs its depth only."""

    def __init__(self, tree: dict[str, tuple[str | None, int, int, int]], budget: int) -> None:
        # tree: id -> (parent, number of children, characters, tokens)
        self.tree, self.budget = tree, budget
        self.chosen: dict[str, None] = {}
        self.kin: dict[str | None, dict[str, None]] = {}
        self.sums: dict[str | None, list[int]] = {}
        self.spent = self.merges = 0

    def _count(self, node: str, sign: int) -> None:
        up, _, chars, tokens = self.tree[node]
        sums = self.sums.setdefault(up, [0, 0])
        sums[0] += sign * chars
        sums[1] += sign * tokens
        self.spent += sign * tokens

    def put(self, node: str) -> None:
        self.chosen[node] = None
        self.kin.setdefault(self.tree[node][0], {})[node] = None
        self._count(node, 1)

    def line(self, node: str) -> Iterator[str]:
        """The node and what stands above it among the rows."""
        met = set()
        while node in self.tree and node not in met:
            met.add(node)
            yield node
            node = self.tree[node][0]

    def offer(self, leaf: str) -> None:
        if leaf not in self.tree or any(n in self.chosen for n in self.line(leaf)):
            return
        up = self.tree[leaf][0]
        self.put(up if up in self.tree and self.tree[up][1] == 1 else leaf)
        for parent in list(self.line(next(reversed(self.chosen))))[1:]:
            _, _, chars, tokens = self.tree[parent]
            held, paid = self.sums.get(parent, (0, 0))
            earned = 3 * held * self.budget >= chars * (self.budget + self.spent)
            if len(self.kin.get(parent, ())) < 2 or not earned or tokens - paid > self.budget - self.spent:
                return
            for child in self.kin.pop(parent):
                del self.chosen[child]
                self._count(child, -1)
            self.put(parent)
            self.merges += 1


def auto_merge(ranked: DataFrame, chunks: DataFrame, budget: int = 4_000) -> DataFrame:
    """(query, place, chunk_id, n_leaves, merges): chunks chosen for every query from its ranked leaves (query, chunk_id, rank).

    A leaf that is its parent's only child stands for the parent. Once at least two chosen siblings hold a third of their
    parent's characters (more as the budget is spent) and the rest of the parent fits, the parent takes their place. n_leaves
    counts the leaves below. A query holds its ranked leaves and their ancestors only, as sizes, which the search bounds.
    """
    ranked = stage(ranked.select("query", "chunk_id", "rank"))
    up = ancestors(chunks, ranked)
    mine = ranked.select("query", "chunk_id", F.col("rank").cast("int").alias("rank"))
    above = mine.join(up, "chunk_id").select("query", F.col("ancestor_id").alias("chunk_id")).distinct().join(mine.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti").withColumn("rank", F.lit(None).cast("int"))
    text = F.coalesce("source_text", F.lit(""))
    sized = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "parent_id", F.coalesce(F.size("child_ids"), F.lit(0)).alias("n_children"), F.length(text).alias("n_chars"), T.n_tokens(text).alias("n_tokens"))
    rows = mine.unionByName(above).join(sized, "chunk_id")

    def fold(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        state = Siblings({c: (p, int(k), int(n), int(t)) for _, c, p, k, n, t in group}, budget)
        for _, leaf in sorted((int(r), c) for r, c, *_ in group if r is not None and r == r) if budget > 0 else ():
            state.offer(leaf)
            if state.spent >= budget:
                break
        for place, chunk in enumerate(state.chosen):
            yield (*key, place, chunk, state.merges)

    kind = dict(ranked.dtypes)["query"]
    chosen = stage(in_groups(rows, ["query"], ["rank", "chunk_id"], fold, ["rank", "chunk_id", "parent_id", "n_children", "n_chars", "n_tokens"], f"query {kind}, place int, chunk_id string, merges int"))
    below = descendant_leaves(chunks, chosen).groupBy(F.col("root_id").alias("chunk_id")).agg(F.count(F.lit(1)).cast("int").alias("n_leaves"))
    return chosen.join(below, "chunk_id", "left").select("query", "place", "chunk_id", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), "merges")


def hash_embedding(text: str, dimensions: int = 384) -> list[float]:
    """Signed feature hashing of the terms of a text, of length 1 (all zeros for a text without terms)."""
    out = np.zeros(dimensions)
    for term in _TERM.findall(text.casefold()):
        h = hashlib.blake2b(term.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % dimensions] += 1.0 if h[4] & 1 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


import re  # noqa: E402

_TERM = re.compile(r"[^\W_]+(?:[-_.:/][^\W_]+)*")


def embed(df: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, embedding) by feature hashing, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": [hash_embedding(t or "", dimensions) for t in pdf[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def check_vectors(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """The rows, failing the job where a vector has another size or a value that is not finite."""
    v = F.col(vector).cast("array<double>")
    ok = (F.size(v) == dimensions) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(F.assert_true(ok, "a vector has the wrong size or a value that is not finite").isNull(), F.lit(True)))


def hit_and_mrr(ranked: DataFrame, query: str, relevant: str, hit_k: int = 5, mrr_k: int = 10) -> DataFrame:
    """(query, hit, mrr) from (query, rank, relevant flag)."""
    best = F.min(F.when(F.col(relevant), F.col("rank")))
    return ranked.groupBy(query).agg(F.coalesce((best <= hit_k).cast("int"), F.lit(0)).alias("hit"), F.round(F.coalesce(F.when(best <= mrr_k, 1.0 / best), F.lit(0.0)), 6).alias("mrr"))


def recall_and_ndcg(judged: DataFrame, ranked: DataFrame, query: str, key: str, k: int = 10) -> DataFrame:
    """(query, recall, ndcg): judged (query, key, grade) leads, so queries without results score 0; gain 2^grade - 1."""
    good = judged.filter("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = good.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), key))).filter(F.col("n") <= k).groupBy(query).agg(F.sum(gain / F.log2(F.col("n") + 1)).alias("ideal"))
    totals = good.groupBy(query).agg(F.count(F.lit(1)).alias("total"))
    got = good.join(ranked.filter(F.col("rank") <= k), [query, key]).groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    j = totals.join(ideal, query).join(got, query, "left")
    return j.select(query, F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))
