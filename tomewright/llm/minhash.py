"""Clusters of near-equal short texts by verified MinHash."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from ..storage import checkpointed

SHINGLE = 3
BANDS, ROWS = 12, 2
_MIX = np.random.default_rng(7).integers(1, 2**63, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> set[str]:
    """Character triples; a shorter text is its own shingle."""
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@lru_cache(200_000)
def _hash(shingle: str) -> int:
    return int.from_bytes(hashlib.blake2b(shingle.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def bands(text: str) -> list[int]:
    """One hash per band of the MinHash signature."""
    h = np.array([_hash(s) for s in shingles(text)], dtype=np.uint64)
    mixed = h[None, :] * _MIX
    mixed ^= mixed >> np.uint64(29)
    signature = (mixed * _MIX[::-1]).min(axis=1).reshape(BANDS, ROWS)
    keys = signature[:, 0] * np.uint64(0x9E3779B97F4A7C15) + signature[:, 1] + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64).tolist()


@pandas_udf(ArrayType(LongType()))
def bands_udf(texts: pd.Series) -> pd.Series:
    return texts.map(bands)


@pandas_udf(DoubleType())
def jaccard_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(ArrayType(StringType()))
def shingles_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(shingles(t)))


def _closed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """text and cluster with the least cluster that links (a, b, both ways) reach.

    Each round takes the least label among the neighbours and then that label's own, so paths halve and the rounds
    grow with the logarithm of a component's width; it ends when nothing changes.
    """
    while True:
        offered = links.join(labels, links.b == labels.text).groupBy("a").agg(F.min("cluster").alias("offered"))
        hooked = labels.join(offered, labels.text == offered.a, "left").select("text", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("offered", "cluster")).alias("cluster"))
        own = labels.select(F.col("text").alias("of"), F.col("cluster").alias("further"))
        moved = checkpointed(hooked.join(own, F.col("cluster") == F.col("of"), "left").select("text", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster"), "old"))
        labels = moved.select("text", "cluster")
        if moved.where("cluster < old").isEmpty():
            return labels


def _linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold's similarity, both ways."""
    links = checkpointed(pairs.where(jaccard_udf("a", "b") >= threshold))
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def clusters(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """text and cluster (its least text) for the distinct non-null texts: what links of exact Jaccard similarity connect.

    First each band bucket names one leader, drawn by a hash that differs from band to band, and every text is
    verified against its leaders: one comparison a text and band, whatever the bucket's size. What that leaves
    apart is then searched exactly: texts that are similar enough share one of the rarest shingles of each (of n
    shingles, the n - ceil(threshold n) + 1 that the fewest texts hold), so texts of different clusters that share
    one, and whose numbers of shingles allow it, are verified. Links are closed over after each step.
    """
    nodes = checkpointed(texts.select("text").dropna().distinct())
    keyed = nodes.select("text", F.posexplode(bands_udf("text")).alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("band", "text"), "text"))["text"].alias("leader"), F.count("*").alias("n")).where("n > 1")
    links = _linked(keyed.join(leaders, ["band", "key"]).where("text != leader").select(F.col("text").alias("a"), F.col("leader").alias("b")).distinct(), threshold)
    labels = _closed(nodes.select("text", F.col("text").alias("cluster")), links)

    held = checkpointed(nodes.select("text", shingles_udf("text").alias("s")).select("text", F.size("s").alias("n"), F.explode("s").alias("shingle")))
    ranked = held.join(held.groupBy("shingle").agg(F.count("*").alias("holders")), "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy("holders", "shingle")))
    # a little less than the threshold, so that rounding shortens nothing
    rare = ranked.where(F.col("rank") <= F.col("n") - F.ceil((threshold - 1e-9) * F.col("n")) + 1).join(labels, "text").select("text", "cluster", "n", "shingle")
    rare = checkpointed(rare)
    a, b = rare.alias("a"), rare.alias("b")
    apart = a.join(b, "shingle").where(F.col("a.cluster") < F.col("b.cluster")).where(F.least("a.n", "b.n") >= (threshold - 1e-9) * F.greatest("a.n", "b.n"))
    more = _linked(apart.select(F.col("a.text").alias("a"), F.col("b.text").alias("b")).distinct(), threshold)
    return labels if more.isEmpty() else _closed(labels, links.unionByName(more))
