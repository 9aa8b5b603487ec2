"""Filling containers of fixed capacity with documents, by their sizes in tokens."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import checkpointed

CAPACITY = 2048
#: Vocabulary file in ranks, and the module beside it that has the pattern words are split by.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Rows of one size that a task ranks at most.
RANKED_TOGETHER = 100_000


@lru_cache(2)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """key and n_tokens of every row; a null or empty text has 0.

    The vocabulary is a file of the driver's, which Spark sends to the workers. The pattern that words are split by
    is that of the public tokenizers unless given.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(SparkFiles.get(name), pattern)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.select(F.col(key).alias("key"), pandas_udf(count, LongType())(F.col(text)).alias("n_tokens"))


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where items of each size go: (size, rank_from, first container, items a container, offset, position).

    ``counts`` is the number of items by size, so the work depends on the number of sizes and not of items. An
    item of ``size`` with rank r goes into container first + (r - rank_from) // items.

    Large items, over a third of the capacity, come first, at most two to a container: from the largest down, each
    size is matched with the largest one that still fits beside it. Smaller ones, from the largest down, go into
    the smallest gap that holds them, and into new containers where none does. Containers filled alike are kept
    as one range, by their gap.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first container, containers, items in each)
    order: list[int] = []
    n_containers = 0

    def put(gap: int, first: int, n: int, items: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n, items))

    large = sorted(s for s in counts if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not (left[large[at]] >= 2 if large[at] == a else left[large[at]]):
            at -= 1
        if at < 0:
            n, b = left[a], 0
        else:
            b = large[at]
            n = left[a] // 2 if b == a else min(left[a], left[b])
        if b == a:
            plan.append((a, taken[a], n_containers, 2, 0, 0))
            left[a], taken[a] = left[a] - 2 * n, taken[a] + 2 * n
        else:
            plan.append((a, taken[a], n_containers, 1, 0, 0))
            left[a], taken[a] = left[a] - n, taken[a] + n
            if b:
                plan.append((b, taken[b], n_containers, 1, a, 1))
                left[b], taken[b] = left[b] - n, taken[b] + n
        put(capacity - a - b, n_containers, n, 2 if b else 1)
        n_containers += n
        large = [s for s in large if left[s]]

    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                put(capacity, n_containers, -(-left[size] // each), 0)
                n_containers += -(-left[size] // each)
                continue
            gap = order[at]
            first, n, items = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                plan.append((size, taken[size], first, each, capacity - gap, items))
                left[size], taken[size] = left[size] - full * each, taken[size] + full * each
                put(gap - each * size, first, full, items + each)
            if full < n:
                rest = min(left[size], each - 1) if left[size] < each else 0
                if rest:  # the last items of this size share one container
                    plan.append((size, taken[size], first + full, rest, capacity - gap, items))
                    left[size], taken[size] = left[size] - rest, taken[size] + rest
                    put(gap - rest * size, first + full, 1, items + rest)
                    full += 1
                put(gap, first + full, n - full, items)
    return plan


_PLACE = StructType([StructField(n, LongType()) for n in ("container", "position", "start_token")])


def containers(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document with the container, the position in it and the token it starts at; the capacity is never exceeded.

    Only a document longer than the capacity is split, into full containers and a last piece that is packed like
    any other (piece counts from 0). One without tokens (null, empty) takes no space and has no container. Repeated
    keys are packed once each row.

    The driver sees only how many pieces there are of each size, at most ``capacity`` numbers; ``packing_plan``
    turns them into ranges. Each piece then finds its place by its rank among those of its size. Ranks are counted
    within salts of a size, sized by its number of pieces, so a size that a third of all documents have is
    spread over as many tasks as it needs.
    Output: key, piece, n_tokens, container, position, start_token.
    """
    sizes = checkpointed(token_counts(documents, key, text, vocabulary))
    full = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)) - 1)
    pieces = sizes.select("key", "n_tokens", F.explode(full).alias("piece")).select("key", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    counts = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = sorted(packing_plan(counts, capacity))
    salts = -(-max(counts.values(), default=1) // RANKED_TOGETHER)

    salted = pieces.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    group = ["n_tokens", "salt"]
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("key", "piece")) - 1).join(bases, group).withColumn("rank", F.col("rank") + F.col("base"))

    table = np.array(plan, dtype=np.int64).reshape(-1, 6)
    starts = table[:, 0] * (1 << 44) + table[:, 1]

    def place(n_tokens: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = n_tokens.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(starts, size * (1 << 44) + r, side="right") - 1] if len(size) else table[:0]
        r = r - row[:, 1]
        slot = r % np.maximum(row[:, 3], 1)
        return pd.DataFrame({"container": row[:, 2] + r // np.maximum(row[:, 3], 1), "position": row[:, 5] + slot, "start_token": row[:, 4] + slot * size})

    place.__annotations__ = {"n_tokens": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    placed = ranked.select("key", "piece", "n_tokens", pandas_udf(place, _PLACE)("n_tokens", "rank").alias("at")).select("key", "piece", "n_tokens", "at.*")
    nothing = pieces.where("n_tokens = 0").select("key", "piece", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in _PLACE.names))
    return placed.unionByName(nothing).withColumnRenamed("key", key)
