"""The queries of the training-data problems, with their SQL where there is any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table
from .abuse import found_kinds, rates, scored
from .leakage import leaked_passages
from .lookalikes import lookalike_classes, lookalike_pairs, normalized
from .packing import containers
from .pairs import defective_pairs
from .sentences import sentences


#: The texts of problem 3: table, key, text.
LOOKS = [("questions", "id", "question"), ("corpus", "number", "text_ja"), ("glossary", "term_en", "term_ja")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_pairs(table(spark, sf, "questions"))


def _looks(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf, t).select(F.lit(t).alias("source_table"), F.col(k).alias("key"), F.col(x).alias("stored")) for t, k, x in LOOKS])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(_looks(spark, sf))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every record that has a look-alike, with its class and number of links."""
    return lookalike_classes(_looks(spark, sf))


def p3_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of problem 3 with its consistent form."""
    return normalized(_looks(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "corpus")
    texts = [corpus.select("number", F.lit(lang).alias("lang"), F.col(f"text_{lang}").alias("text")) for lang in ("en", "ja")]
    return sentences(texts[0].unionByName(texts[1]), ["number", "lang"])


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source", "text")
    return scored(documents, table(spark, sf, "labels")).drop("text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_kinds(p8_scores(spark, sf))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rates(p8_scores(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_classes, p3_consistent, p5_found, p6_containers, p7_found, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}
