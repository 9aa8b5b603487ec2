"""Whole searches: direct lookup, hybrid ranking, groups, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..functions.numbers import number_query, parent_of
from ..functions.tokens import normalized, tokens
from ..operators.glossary import glossary_ranking, secondary_queries, term_hits
from ..operators.lookup import direct_lookup
from ..operators.ranking import POOL, bm25_ranking, fold_groups, rrf, top, vector_ranking
from ..storage import checkpointed

SECTION_WEIGHT = 0.3
SHOWN = 600


def passages(corpus: DataFrame) -> DataFrame:
    """doc_id, text of the bilingual passages: number, English text, and the Japanese on a line of its own if there is any."""
    ja = F.when(F.coalesce("text_ja", F.lit("")) != "", F.concat(F.lit("\n"), F.col("text_ja"))).otherwise("")
    return corpus.select(F.col("number").alias("doc_id"), F.concat(F.col("number"), F.lit(" "), F.coalesce("text_en", F.lit("")), ja).alias("text"))


def language_passages(corpus: DataFrame, fallback: bool = False) -> DataFrame:
    """id (number#language), doc_id, lang, section, text: a row per language that has a text; with ``fallback`` the English stands in for a missing Japanese one."""
    ja = F.coalesce(F.nullif("text_ja", F.lit("")), F.col("text_en")) if fallback else F.col("text_ja")
    both = F.array(F.struct(F.lit("en").alias("lang"), F.col("text_en").alias("t")), F.struct(F.lit("ja").alias("lang"), ja.alias("t")))
    rows = corpus.select("number", "section", F.explode(both).alias("p")).where("coalesce(p.t, '') != ''")
    return rows.select(F.concat_ws("#", "number", "p.lang").alias("id"), F.col("number").alias("doc_id"), F.col("p.lang").alias("lang"), "section", F.concat_ws(" ", "number", "p.t").alias("text"))


@pandas_udf(DoubleType())
def shared_tokens(query: pd.Series, passage: pd.Series) -> pd.Series:
    """Stand-in for a cross-encoder, which needs model files: the share of the query's tokens that the passage has."""
    return pd.Series([round(len(set(q) & set(p)) / max(1, len(set(q))), 9) for q, p in zip(query, passage, strict=True)], dtype=float)


def reranked(ranking: DataFrame, queries: DataFrame, docs: DataFrame, scorer=shared_tokens, pool: int = POOL) -> DataFrame:
    """The first ``pool`` of each query reordered by a scorer of (query tokens, passage tokens); the new score is 1/rank, the rest falls away."""
    cut = ranking.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("old"))
    scored = cut.join(queries.select("query_id", tokens(F.col("text")).alias("q")), "query_id").join(docs.select("doc_id", tokens(F.col("text")).alias("p")), "doc_id").withColumn("s", scorer("q", "p"))
    return top(scored, pool, [F.desc("s"), F.asc("old")]).select("query_id", "doc_id", (1.0 / F.col("rank")).alias("score"), "rank")


@dataclass
class Index:
    """The tables a search reads: passages (doc_id, text), members (doc_id, parent, ord, section), and, as far as there are any, vectors (doc_id, embedding) and terms."""

    docs: DataFrame
    members: DataFrame
    vectors: DataFrame | None = None
    terms: DataFrame | None = None
    query_vectors: DataFrame | None = field(default=None)


def hybrid_ranking(index: Index, queries: DataFrame, section: str | None = None, rerank: bool = False) -> DataFrame:
    """Vector, BM25 and glossary rankings fused by reciprocal rank; with the reranker also the sections' rules, at a lower weight.

    A section filters vectors and terms before ranking, BM25 after scoring. Systems without tables are left out.
    """
    inside = None if section is None else index.members.where(F.col("section") == section).select("doc_id")
    within = lambda df: df if inside is None else df.join(inside, "doc_id", "left_semi")
    systems: list[tuple[DataFrame, float]] = []
    if index.vectors is not None and index.query_vectors is not None:
        asked = index.query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
        systems.append((vector_ranking(within(index.vectors), asked), 1.0))
    sections = index.docs if section is None else index.docs.join(index.members.select("doc_id", "section"), "doc_id", "left")
    systems.append((bm25_ranking(sections, queries, keep=None if section is None else F.col("section") == section), 1.0))
    if index.terms is not None:
        renumber = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        hits = checkpointed(term_hits(queries, index.terms))
        systems.append((renumber(within(glossary_ranking(queries, index.terms, hits=hits))), 1.0))
        if rerank:
            systems.append((renumber(within(glossary_ranking(queries, index.terms, "section", hits))), SECTION_WEIGHT))
    fused = rrf(systems)
    return reranked(fused, queries, index.docs) if rerank else fused


def search(index: Index, queries: DataFrame, groups: int = 7, section: str | None = None, rerank: bool = False) -> DataFrame:
    """Groups of rules for every query (query_id, text): by number where the query is one, else by hybrid ranking.

    A query of a number's shape that no rule has stays without result. Output as of ``fold_groups``. What several
    steps read is stored, here and in them: without that, plans repeat one another until the driver can't hold them.
    """
    numbers = checkpointed(queries.select("query_id", "text", number_query(normalized(F.col("text"))).isNotNull().alias("is_number")))
    direct = direct_lookup(numbers.where("is_number"), index.members.select(F.col("doc_id").alias("number")))
    if section is not None:
        direct = direct.join(index.members.where(F.col("section") == section).select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score", "rank")
    hybrid = hybrid_ranking(index, numbers.where("not is_number").select("query_id", "text"), section, rerank)
    return fold_groups(direct.unionByName(hybrid.select("query_id", "doc_id", "score", "rank")), index.members, groups)


def corpus_members(corpus: DataFrame) -> DataFrame:
    """doc_id, parent, ord, section of a corpus (number, section, ord)."""
    return corpus.select(F.col("number").alias("doc_id"), parent_of(F.col("number")).alias("parent"), "ord", "section")


def multi_query_groups(results: DataFrame, query_of: DataFrame) -> DataFrame:
    """Groups found by several queries of a question, each once, in the order of the queries and their ranks.

    query_of has query_id, question_id, query_ord. Output: question_id, parent, place.
    """
    first = results.join(query_of, "query_id").groupBy("question_id", "parent").agg(F.min(F.struct("query_ord", "group_rank")).alias("first"))
    return first.select("question_id", "parent", F.row_number().over(Window.partitionBy("question_id").orderBy("first", "parent")).alias("place"))


def contexts(groups: DataFrame, corpus: DataFrame) -> DataFrame:
    """question_id, place, parent, rules (number, text_en, text_ja) of the groups as given to a generator: Japanese texts cut to 600 characters, empty ones null."""
    shown = F.nullif(F.substring(F.coalesce("text_ja", F.lit("")), 1, SHOWN), F.lit(""))
    groups = checkpointed(groups)
    shown_ones = corpus.withColumn("parent", parent_of(F.col("number"))).join(groups.select("parent").distinct(), "parent", "left_semi")
    whole = shown_ones.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "text_en", shown.alias("text_ja")))).alias("all"))
    return groups.join(whole, "parent").select("question_id", "place", "parent", F.transform("all", lambda r: F.struct(r.number.alias("number"), r.text_en.alias("text_en"), r.text_ja.alias("text_ja"))).alias("rules"))


def question_queries(questions: DataFrame, terms: DataFrame, rephrasings: DataFrame | None = None) -> DataFrame:
    """query_id, question_id, query_ord, text: each question (query_id, text), if it contains terms a second query of them, and its rephrasings (id, queries) in order."""
    second = secondary_queries(questions, terms).select("query_id", F.lit(1).alias("query_ord"), "text")
    several = questions.select("query_id", F.lit(0).alias("query_ord"), "text").unionByName(second)
    if rephrasings is not None:
        own = rephrasings.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
        several = several.unionByName(own.select(F.col("id").alias("query_id"), F.posexplode("queries").alias("pos", "text")).select("query_id", (F.col("pos") + 2).alias("query_ord"), "text"))
    return checkpointed(several.select(F.concat_ws("#", "query_id", "query_ord").alias("query_id"), F.col("query_id").alias("question_id"), "query_ord", "text"))


def fingerprint(hashes: DataFrame, model: str) -> DataFrame:
    """One row: the sources' hashes (ord, sha256) in order and the model's name, joined by +."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sha256"))), lambda x: x.sha256), "+")
    return hashes.agg(F.concat(joined, F.lit(f"+{model}+dual")).alias("fingerprint"))


def reusable(spark: SparkSession, path: str, mark: str, count: int | None = None) -> bool:
    """Whether a stored table has this fingerprint and, if given, row count; a table that is not there can't be reused, other errors are raised."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    stored = spark.read.parquet(path)
    row = stored.agg(F.count("*").alias("n"), F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).first()
    return count in (None, row["n"]) and row["low"] == row["high"] == mark


def build_or_load(spark: SparkSession, path: str, rows: DataFrame, mark: str, count: int | None = None) -> tuple[DataFrame, bool]:
    """The stored table of ``rows`` and whether it was reused: it is written anew unless its fingerprint and count are the same.

    Without an expected count (as of ``vector_count``) the fingerprint decides, and rows are computed only to be written.
    """
    old = reusable(spark, path, mark, count)
    if not old:
        rows.withColumn("fingerprint", F.lit(mark)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("fingerprint"), old


def vector_count() -> Column:
    """The vectors that an index of a corpus has: one a rule, two with a Japanese text."""
    return F.sum(F.when(F.coalesce("text_ja", F.lit("")) != "", 2).otherwise(1))


def model_text(text: Column, model: str, role: str) -> Column:
    """A text as the model wants it: models of the e5 family take ``query: `` or ``passage: `` before it."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def encoded(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], model: str = "", role: str = "passage") -> DataFrame:
    """The rows with the unit vectors (embedding) of their texts; null texts have none.

    ``encoder`` makes, once a task, a function from texts to a matrix: no model file comes with this package.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            own = np.flatnonzero(texts.notna())
            if len(own):
                matrix = np.asarray(of(texts.iloc[own].tolist()), np.float32)
                matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                for i, v in zip(own, matrix, strict=True):
                    out[i] = v
            yield out

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("embedding", pandas_udf(encode, ArrayType(FloatType()))(model_text(F.col("text"), model, role)))
