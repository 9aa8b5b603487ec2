"""Rankings of documents for many queries at once, and their fusion.

Queries, documents and rankings are tables keyed by ``query_id`` and ``doc_id``; a ranking has a ``rank`` from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..storage import checkpointed

K1, B, EPSILON = 1.5, 0.75, 0.25
POOL, RRF_K, DIGITS = 50, 60, 6
#: Vectors and query vectors that are multiplied at once.
CHUNK, BLOCK = 512, 256
#: Documents or queries, and their tokens, in a pack of BM25 at most (one of more tokens is a pack of its own); pairs beyond which a token is part of the product; shares of the documents; queries in a task.
BAGS, PACKED, DENSE, SHARES, SLICE = 1024, 1 << 16, 1 << 12, 8, 2048


def top(scored: DataFrame, k: int, by: list[Column], key: str = "query_id") -> DataFrame:
    """The first k rows of each query in a total order, with their rank; Spark cuts each partition to k before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= k)


def postings(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id, token, tf, the document's length dl, and whether it is kept; docs has doc_id and text. Documents without tokens have none."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    listed = docs.select("doc_id", kept.alias("kept"), tokens(F.col("text")).alias("list"))
    counted = listed.select("doc_id", "kept", F.size("list").alias("dl"), F.explode("list").alias("token"))
    return counted.groupBy("doc_id", "kept", "dl", "token").agg(F.count("*").alias("tf"))


def idf_weights(post: DataFrame, stats: DataFrame) -> DataFrame:
    """token and idf; a negative idf is replaced by a fixed part of the mean over the vocabulary. stats has one row, with n."""
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def _block_scores(docs: DataFrame, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """block, query_id, doc_id, score > 0; all rows of a block of documents are in one partition."""
    post = checkpointed(postings(docs, keep))
    stats = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weighted = asked.join(idf_weights(post, stats), "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = post.where("kept").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    # by hint, as Spark takes the repeated weights for fewer than they are and might send them all to every task
    every = weighted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block").hint("shuffle_hash")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = dealt.crossJoin(F.broadcast(stats.select("avgdl"))).join(every, ["block", "token"]).select("block", "query_id", "doc_id", part.alias("part"))
    return scores.groupBy("block", "query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score")).where("score > 0")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score > 0 of all documents for all queries, by Okapi BM25 with an idf floor.

    Statistics are those of all documents, empty ones included; a token counts as often as the query has it.
    Postings are made once and stored, as frequencies, lengths and scores all read them. They are dealt to blocks by
    document, and each block is given the weights of all query tokens: so a token that most documents have is spread
    over all blocks, a document's score is summed where its postings are, and documents that share no token with a
    query never meet it.
    """
    return _block_scores(docs, queries).drop("block")


def _packed_bags(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key, tokens (hashed) and values, many to a row: their keys, and by token the place of each one's key, the tokens and the values."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["tokens"].map(len)
            for _, some in batch.groupby(np.floor(np.maximum(sizes / PACKED, 1 / BAGS).cumsum())):
                words = np.concatenate(some["tokens"].tolist())
                order = np.argsort(words, kind="stable")
                places = np.repeat(np.arange(len(some), dtype=np.int32), sizes[some.index])
                yield pd.DataFrame({"ids": [some["id"].tolist()], "places": [places[order]], "tokens": [words[order]], "parts": [np.concatenate(some["parts"].tolist())[order]]})

    plain = rows.select(F.col(key).alias("id"), "tokens", "parts")
    return plain.mapInPandas(pack, f"ids array<{dict(plain.dtypes)['id']}>, places array<int>, tokens array<long>, parts array<double>")


def _products(tokens_of: np.ndarray, rows: np.ndarray, parts: np.ndarray, n: int, asked: np.ndarray, asked_rows: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The scores of n documents for m queries, both by token: tokens that many of both have as a matrix product, others pair by pair."""
    starts = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
    words, qf = asked[starts], np.diff(np.r_[starts, len(asked)])
    low = np.searchsorted(tokens_of, words)
    df = np.searchsorted(tokens_of, words, "right") - low
    dense = df * qf > DENSE
    left, right = np.zeros((m, dense.sum())), np.zeros((dense.sum(), n))
    q, d = np.repeat(dense, qf), _ranges(low[dense], df[dense])
    left[asked_rows[q], np.repeat(np.arange(dense.sum()), qf[dense])] = weights[q]
    right[np.repeat(np.arange(dense.sum()), df[dense]), rows[d]] = parts[d]
    scores = left @ right
    times = np.repeat(df, qf)[~q]
    posting = _ranges(np.repeat(low, qf)[~q], times)
    flat = np.repeat(asked_rows[~q].astype(np.int64) * n, times) + rows[posting]
    scores += np.bincount(flat, np.repeat(weights[~q], times) * parts[posting], minlength=m * n).reshape(m, n)
    return scores


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Best:
    """The k best of the documents given so far for each of m queries: scores above 0, ties by id.

    What may be among them is gathered, and cut when it has doubled: ids are compared and let go only then.
    """

    def __init__(self, m: int, k: int):
        self.k, self.size, self.ids = k, 0, []
        self.found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        self.least, self.full = np.zeros(m), np.zeros(m, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of each query for documents of these ids. A rounded score is less than a last digit from its own."""
        bound = self.least.copy()
        if len(ids) > self.k and not self.full.all():
            bound[~self.full] = np.partition(scores[~self.full], -self.k, axis=1)[:, -self.k]
        q, d = np.nonzero(scores > np.maximum(bound - 10.0**-DIGITS, 0)[:, None])
        s = np.round(scores[q, d], DIGITS)
        self.found.append((q[s > 0], s[s > 0], d[s > 0] + len(self.ids)))
        self.ids.extend(ids.tolist())
        if sum(len(q) for q, _, _ in self.found[1:]) > max(self.size, len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of the best."""
        q, s, d = map(np.concatenate, zip(*self.found, strict=True))
        met, d = np.unique(d, return_inverse=True)
        ids = np.array([*(self.ids[i] for i in met), None], object)[:-1]
        by_id = np.argsort(np.argsort(ids, kind="stable"))
        order = np.lexsort((by_id[d], -s, q))
        order = order[_places(q[order]) < self.k]
        q, s, d = q[order], s[order], d[order]
        n = np.bincount(q, minlength=len(self.least))
        self.found, self.size, self.ids, self.full = [(q, s, d)], len(q), ids.tolist(), n >= self.k
        self.least[self.full] = s[(np.cumsum(n) - 1)[self.full]]
        return q, s, ids[d]


def bm25_ranking(docs: DataFrame, queries: DataFrame, k: int = POOL, keep: Column | None = None) -> DataFrame:
    """The k best documents per query, ties by doc_id. ``keep`` filters after scoring: statistics stay those of all documents.

    Scores are those of ``bm25``. Queries of the same tokens are scored once. Documents and queries are packed, some
    thousands and some hundreds to a row, and each pack of queries meets each pack of documents in memory: no row for
    a query and a document is made but the k best of a query in a share of the documents, of which there are eight at
    most, and the fewer the more tasks the queries make. Tokens go by a hash of 64 bits.
    """
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    listed = checkpointed(docs.select("doc_id", kept.alias("kept"), hashed(tokens(F.col("text"))).alias("list")).repartition(SHARES, "doc_id"))
    stats = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("list")), F.lit(0)).alias("total")).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
    each = queries.select("query_id", hashed(tokens(F.col("text"))).alias("list")).groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("list"))).alias("list")).where("size(list) > 0")
    named = checkpointed(each.withColumn("bag", F.md5(F.array_join(F.transform("list", lambda t: t.cast("string")), " "))))
    asked = named.groupBy("bag").agg(F.first("list").alias("list")).select("bag", F.explode("list").alias("token")).groupBy("bag", "token").agg(F.count("*").alias("qtf"))
    weighted = asked.join(idf_weights(listed.select(F.explode(F.array_distinct("list")).alias("token")), stats).hint("merge"), "token").groupBy("bag").agg(F.collect_list(F.struct("token", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("l"))
    slices = -(-named.select("bag").distinct().count() // SLICE) or 1
    packed_queries = checkpointed(_packed_bags(weighted.select("bag", F.col("l.token").alias("tokens"), F.col("l.weight").alias("parts")).repartition(slices, "bag"), "bag"))

    def impacts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(np.asarray(x), return_counts=True) for x in batch["list"]]
            dl, avgdl = batch["list"].map(len), batch["avgdl"]
            parts = [tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean)) for (_, tf), n, mean in zip(found, dl, avgdl, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [t for t, _ in found], "parts": parts})

    kind = dict(docs.dtypes)["doc_id"]
    own = listed.where("kept and size(list) > 0").crossJoin(F.broadcast(stats.select("avgdl"))).select("doc_id", "list", "avgdl")
    packed_docs = checkpointed(_packed_bags(own.mapInPandas(impacts, f"doc_id {kind}, tokens array<long>, parts array<double>"), "doc_id"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[np.ndarray, _Best]] = {}  # by pack of queries
        for batch in batches:
            for ids, rows, words, parts, bags, asked_rows, asked_words, weights in batch.itertuples(index=False):
                n, m = len(ids), len(bags)
                _, own = best.setdefault(bags[0], (bags, _Best(m, k)))
                own.add(_products(words, rows, parts, n, asked_words, asked_rows, weights, m), ids)
        for bags, own in best.values():
            q, s, d = own.cut()
            yield pd.DataFrame({"bag": bags[q], "doc_id": d, "score": s})

    pairs = packed_docs.coalesce(min(SHARES, -(-2 * SHARES // slices))).join(packed_queries.toDF("asked", "asked_places", "asked_tokens", "weights").hint("shuffle_replicate_nl"))
    ranked = top(pairs.mapInPandas(score, f"bag string, doc_id {kind}, score double"), k, [F.desc("score"), F.asc("doc_id")], "bag")
    return named.select("query_id", "bag").join(ranked, "bag").select("query_id", "doc_id", "score", "rank")


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each entry in its group, from 0; equal groups stand together."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _packed(rows: DataFrame, key: str, vector: str, at_once: int) -> DataFrame:
    """key and vector of the rows (nulls left out), so many to a row: ids, and their vectors one after the other."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = range(0, len(batch), at_once)
            yield pd.DataFrame({"ids": [batch["id"].iloc[i : i + at_once].tolist() for i in cuts], "matrix": [np.concatenate(batch["v"].iloc[i : i + at_once].tolist()) for i in cuts]})

    plain = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).dropna()
    kinds = dict(plain.dtypes)
    return plain.mapInPandas(pack, f"ids array<{kinds['id']}>, matrix {kinds['v']}")


def _better(best: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``asked``, score and item of the k best so far and of these vectors, ties by item; of an item's vectors the best counts."""
    q0, s0, d0 = best
    order = np.argsort(ids, kind="stable")
    items, starts = np.unique(ids[order], return_index=True)
    scores = np.maximum.reduceat(np.round(asked @ vectors[order].T, DIGITS), starts, axis=1)
    full = np.bincount(q0, minlength=len(asked)) >= k
    least = np.full(len(asked), np.inf)
    np.minimum.at(least, q0, s0)
    least[~full] = np.partition(scores[~full], -k, axis=1)[:, -k] if len(items) > k else -np.inf
    q, d = np.nonzero(scores >= least[:, None])
    q, s, d = np.concatenate([q0, q]), np.concatenate([s0, scores[q, d]]), np.concatenate([d0, items[d]])
    _, by_id = np.unique(d, return_inverse=True)
    order = np.lexsort((-s, by_id, q))
    q, s, d, by_id = q[order], s[order], d[order], by_id[order]
    first = np.r_[True, (q[1:] != q[:-1]) | (by_id[1:] != by_id[:-1])]
    q, s, d, by_id = q[first], s[first], d[first], by_id[first]
    order = np.lexsort((by_id, -s, q))
    order = order[_places(q[order]) < k]
    return q[order], s[order], d[order]


def vector_ranking(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """The k nearest items per query by inner product of unit vectors, exactly.

    vectors has doc_id and embedding, with as many rows to an item as it has languages: its best one counts.
    queries has query_id and embedding, a stated set. Queries of the same vector are scored once. Both are packed, a
    few hundred vectors to a row, and each block of queries meets each block of vectors; the two are multiplied as
    matrices and only the k best of a query in a share of the vectors, of which there are a fixed number, leave the
    task, which is enough as an item among the best of all is among the best where its best vector is. A filter on
    ``vectors`` is applied before the cut. Null vectors have no place.
    """
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), " ", "null")
    named = checkpointed(queries.select("query_id", F.col("embedding").alias("v")).dropna().withColumn("bag", F.md5(text)))
    each = named.groupBy("bag").agg(F.first("v").alias("v"))
    slices = -(-named.select("bag").distinct().count() // SLICE) or 1
    packed_queries = checkpointed(_packed(each.repartition(slices, "bag"), "bag", "v", BLOCK))
    pairs = _packed(vectors.coalesce(SHARES), "doc_id", "embedding", CHUNK).join(packed_queries.toDF("asked", "asked_matrix").hint("shuffle_replicate_nl"))
    kind = dict(pairs.dtypes)["ids"][6:-1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # by block of queries: its bags, and the best so far
        for batch in batches:
            for ids, matrix, asked, asked_matrix in batch.itertuples(index=False):
                ids, asked = np.asarray(ids), np.asarray(asked)
                _, before = best.get(asked[0], (None, (np.empty(0, np.int64), np.empty(0), ids[:0])))
                best[asked[0]] = asked, _better(before, ids, np.asarray(matrix, np.float64).reshape(len(ids), -1), np.asarray(asked_matrix, np.float64).reshape(len(asked), -1), k)
        for asked, (q, s, d) in best.values():
            yield pd.DataFrame({"bag": asked[q], "doc_id": d, "score": s})

    found = pairs.mapInPandas(score, f"bag string, doc_id {kind}, score double").groupBy("bag", "doc_id").agg(F.max("score").alias("score"))
    ranked = top(found, k, [F.desc("score"), F.asc("doc_id")], "bag").drop("rank")
    best = named.select("query_id", "bag").join(ranked, "bag").repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top(best, k, [F.desc("score"), F.asc("doc_id")])


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: query_id, doc_id, score, rank.

    Ties keep the order of first appearance: by system, then by rank within it. A document that a ranking names
    twice counts twice. No rankings, or empty ones, give no rows.
    """
    parts = [df.select("query_id", "doc_id", F.lit(i).alias("system"), "rank", (F.lit(w) / (k + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(rankings)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # dealt out by query once, for the sums and for the window
    fused = union.repartition("query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("system", "rank")).alias("first"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id"))).drop("first")


def minmax_fusion(scores: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of the systems' scores, each scaled to 0..1 per query; a system without spread gives 0."""
    union = None
    for i, (df, w) in enumerate(scores):
        per = Window.partitionBy("query_id")
        span = F.max("score").over(per) - F.min("score").over(per)
        part = df.select("query_id", "doc_id", (F.lit(w) * (F.col("score") - F.min("score").over(per)) / F.when(span == 0, 1.0).otherwise(span)).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def fold_groups(ranking: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ranking folded to whole parent groups, the k whose first hit ranks best.

    ranking has query_id, doc_id, score, rank; members has doc_id, parent and ord (its place in the corpus). A hit
    whose parent is no member of the corpus takes no slot. Output per query and group: group_rank, parent, score
    (of the best hit), matched (hits in rank order), and rules: all members in corpus order, with score 0 where
    not hit.
    """
    known = members.select("doc_id", "parent").join(members.select(F.col("doc_id").alias("parent")), "parent", "left_semi")
    hits = ranking.join(known, "doc_id").repartition("query_id")
    groups = hits.groupBy("query_id", "parent").agg(
        F.min("rank").alias("first"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("matched"), F.map_from_entries(F.collect_list(F.struct("doc_id", "score"))).alias("by_doc")
    )
    best = checkpointed(groups.withColumn("group_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("group_rank") <= k))  # read twice
    whole = members.join(best.select("parent").distinct(), "parent", "left_semi").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("ord", "doc_id"))).alias("all"))
    rules = F.transform("all", lambda m: F.struct(m.doc_id.alias("doc_id"), F.coalesce(F.element_at("by_doc", m.doc_id), F.lit(0.0)).alias("score")))
    return best.join(whole, "parent").select("query_id", "group_rank", "parent", "score", "matched", rules.alias("rules"))
