"""Rules by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_query, parent_of, section_of, sort_key
from ..functions.tokens import normalized


def direct_lookup(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, doc_id, score 1, rank for queries that are a rule number: the number itself first, then what lies under it in order.

    Each rule is listed under the prefixes it answers to (itself, its parent, its section), which makes it an
    equi-join. A number that no rule has gives no rows, and so does any other query. corpus has number.
    """
    asked = queries.select("query_id", number_query(normalized(F.col("text"))).alias("prefix")).where("prefix is not null")
    n = F.col("number")
    prefixes = F.array_distinct(F.array(n, parent_of(n), section_of(n)))
    listed = corpus.select("number").distinct().select("number", F.explode(prefixes).alias("prefix"))
    by = Window.partitionBy("query_id").orderBy(F.col("number") != F.col("prefix"), sort_key(n))
    return asked.join(listed, "prefix").select("query_id", n.alias("doc_id"), F.lit(1.0).alias("score"), F.row_number().over(by).alias("rank"))
