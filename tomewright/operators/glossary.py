"""The glossary as a ranking: terms found in a query bring the rules they refer to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..functions.numbers import parent_of, section_of, sort_key
from ..functions.text import narrow, rule_number
from ..functions.tokens import normalized
from ..storage import checkpointed

SECTION_HEAD = 8
#: Lengths of a term's opening that is matched by equality before the whole term is looked for, each twice the one before.
GRAMS = (1, 2, 4, 8, 16)
#: Bits of the filter of openings (2 MB, whatever the terms), and of a piece of it, as Spark's bitmap functions cut it.
FILTER_BITS, PIECE = 24, 1 << 15
#: Queries cut to stretches at once.
TOGETHER = 1 << 10


def term_table(glossary: DataFrame, known: DataFrame, head: int = SECTION_HEAD) -> DataFrame:
    """term, kind (explicit, section), ord and rules: what each normalised term, Japanese or English, refers to.

    Explicit rules are those named and known; section rules are the parents of the sections named, all of them in
    a section of up to ``SECTION_HEAD``, else the first ``head`` in numeric order (none if head is 0), less those named
    outright. Longer terms come first, then the glossary's order, Japanese before English. glossary has ord,
    term_en, term_ja, rules, sections; known has number. A missing term or list is empty; terms without rules of
    a kind have no row.
    """
    numbers = known.select("number").distinct()
    named = glossary.select("ord", F.posexplode(F.transform("rules", rule_number)).alias("pos", "number")).join(numbers, "number", "left_semi")
    explicit = named.groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x.number)).alias("rules"))

    parents = numbers.where(parent_of(F.col("number")) == F.col("number")).where("number rlike '^[^.]*\\\\.[0-9]+$'").select(section_of(F.col("number")).alias("section"), "number")
    per = Window.partitionBy("section")
    parents = parents.withColumn("place", F.row_number().over(per.orderBy(sort_key(F.col("number"))))).withColumn("size", F.count("*").over(per))
    reached = parents.where((F.col("size") <= SECTION_HEAD) | (F.col("place") <= head))
    wanted = glossary.select("ord", F.posexplode(F.array_distinct(F.transform("sections", lambda s: F.regexp_extract(narrow(s), r"(\d{3})", 1)))).alias("pos", "section"))
    expanded = wanted.join(reached, "section").join(named.select("ord", "number"), ["ord", "number"], "left_anti")
    section = expanded.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place", "number"))), lambda x: x.number).alias("rules"))

    both = F.array(F.struct(F.lit(0).alias("lang"), F.col("term_ja").alias("text")), F.struct(F.lit(1).alias("lang"), F.col("term_en").alias("text")))
    terms = glossary.select("ord", F.explode(both).alias("t")).select("ord", F.col("t.lang").alias("lang"), F.trim(normalized(F.col("t.text"))).alias("term")).where("term != ''")
    kinds = explicit.withColumn("kind", F.lit("explicit")).unionByName(section.withColumn("kind", F.lit("section")))
    return terms.join(kinds, "ord").select("term", "kind", "ord", "lang", "rules")


def _stretches(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of GRAMS: it, the hashes of all stretches of so many characters, the texts they are in, and whether a text starts there."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    left = ends[text] - np.arange(len(codes))
    first = left == sizes[text]
    hashes = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for length in GRAMS:
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = left >= length
        yield length, hashes[whole].view(np.int64), text[whole], first[whole]
        following = np.zeros_like(hashes)
        following[:-length] = hashes[length:]
        hashes = hashes * np.uint64(0x94D049BB133111EB) + following


@pandas_udf(LongType())
def _opening(terms: pd.Series) -> pd.Series:
    """The hash of a term's first characters, as many as the longest of GRAMS that it holds."""
    held = np.array([max(n for n in GRAMS if n <= len(t)) for t in terms], np.int64)
    out = np.zeros(len(terms), np.int64)
    for length, hashes, text, first in _stretches(terms.tolist()):
        own = first & (held[text] == length)
        out[text[own]] = hashes[own]
    return pd.Series(out)


def _openings_bits(listed: DataFrame) -> np.ndarray:
    """The openings (gram) by their last FILTER_BITS; the driver joins pieces of 4 KB, at most 512, that Spark builds."""
    bit = listed.select(F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in bit.groupBy((F.col("bit") / PIECE).cast("long").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % PIECE).alias("bits")).collect():
        at = row["piece"] * (PIECE // 8)
        bits[at : at + PIECE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def term_hits(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id and term where the normalised query contains the term, as plain text and not as a token.

    Terms are met by the hash of their opening, its length a power of two, among those of all stretches of such
    lengths of the query: an equi-join, after which the whole term is looked for. Stretches that no term opens with
    stay in their task, by bits of fixed size. The join is by merging, as Spark takes stretches for no more than the
    queries are and might send them to every task.
    """
    listed = checkpointed(terms.select("term").distinct().where("term != ''").withColumn("gram", _opening("term")))
    bits = _openings_bits(listed)
    asked = queries.select("query_id", normalized(F.col("text")).alias("q")).where("q != ''")

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at : at + TOGETHER]
                met = []
                for _, hashes, text, _ in _stretches(some["q"].tolist()):
                    low = hashes & ((1 << FILTER_BITS) - 1)
                    known = (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)
                    met.append(np.unique(np.stack([text[known], hashes[known]], axis=1), axis=0))
                found = np.concatenate(met)
                yield some.iloc[found[:, 0]].assign(gram=found[:, 1])

    kinds = dict(asked.dtypes)
    met = asked.mapInPandas(stretches, f"query_id {kinds['query_id']}, q string, gram long").join(listed.hint("merge"), "gram")
    return met.where(F.contains("q", F.col("term"))).select("query_id", "term").distinct()


def glossary_ranking(queries: DataFrame, terms: DataFrame, kind: str = "explicit", hits: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, rank: the rules of the contained terms, longest term first, each at its first place. hits, if made before, as of ``term_hits``."""
    found = (term_hits(queries, terms) if hits is None else hits).join(terms.where(F.col("kind") == kind), "term")
    listed = found.select("query_id", F.struct((-F.length("term")).alias("len"), "ord", "lang").alias("by"), F.posexplode("rules").alias("pos", "doc_id"))
    first = listed.groupBy("query_id", "doc_id").agg(F.min(F.struct("by", "pos")).alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id")).alias("rank"))


def secondary_queries(queries: DataFrame, terms: DataFrame, most: int = 4) -> DataFrame:
    """query_id and text: the first contained terms joined by a space; queries without any are left out."""
    order = terms.groupBy("term").agg(F.min(F.struct("ord", "lang")).alias("first"))
    found = term_hits(queries, terms).join(order, "term").withColumn("by", F.struct((-F.length("term")).alias("len"), "first"))
    some = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("by", "term"))).where(F.col("n") <= most)
    return some.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x.term), " ").alias("text"))
