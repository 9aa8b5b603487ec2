"""Cards and rulings from raw JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACE = "struct<name:string,mana_cost:string,oracle_text:string,power:string,toughness:string,loyalty:string>"
CARD = f"id string, name string, printed_name string, mana_cost string, type_line string, oracle_text string, colors array<string>, color_identity array<string>, keywords array<string>, power string, toughness string, loyalty string, card_faces array<{FACE}>"
RULINGS = "data array<struct<source:string,published_at:string,comment:string>>"


def read_cards(raw: DataFrame) -> DataFrame:
    """The typed fields of raw card records (key, json), with a status: ok, or error where the JSON is broken or has no name.

    Texts and costs fall back to those of the faces joined (texts by a line of two strokes) where they are null or
    empty; power, toughness and loyalty to those of the first face only where null. Lists default to empty.
    """
    card = raw.select("key", F.from_json("json", CARD).alias("c")).select("key", "c.*")
    faces = F.coalesce("card_faces", F.array().cast(f"array<{FACE}>"))
    joined = lambda f, gap: F.array_join(F.transform(faces, lambda x: F.coalesce(x[f], F.lit(""))), gap)
    empty = F.array().cast("array<string>")
    first = lambda f: F.coalesce(f, F.get(faces, F.lit(0))[f])
    return card.select(
        "key", F.when(F.col("name").isNull(), "error").otherwise("ok").alias("status"), "id", "name", "printed_name", F.coalesce(F.nullif("mana_cost", F.lit("")), joined("mana_cost", "")).alias("mana_cost"), F.coalesce("type_line", F.lit("")).alias("type_line"),
        F.coalesce(F.nullif("oracle_text", F.lit("")), joined("oracle_text", "\n//\n")).alias("oracle_text"), *(F.coalesce(c, empty).alias(c) for c in ("colors", "color_identity", "keywords")), *(first(c).alias(c) for c in ("power", "toughness", "loyalty")),
    )


def with_rulings(cards: DataFrame, rulings: DataFrame) -> DataFrame:
    """Cards with their list of rulings (card_id, json), missing fields as ''; a card without any has an empty list."""
    item = "array<struct<source:string,published_at:string,comment:string>>"
    parsed = rulings.select("card_id", F.coalesce(F.from_json("json", RULINGS)["data"], F.array().cast(item)).alias("data"))
    filled = F.transform("data", lambda r: F.struct(*(F.coalesce(r[f], F.lit("")).alias(f) for f in ("source", "published_at", "comment"))))
    return cards.join(parsed.select("card_id", filled.alias("rulings")), cards["id"] == F.col("card_id"), "left").drop("card_id").withColumn("rulings", F.coalesce("rulings", F.array().cast(item)))


def find_cards(names: DataFrame, cards: DataFrame) -> DataFrame:
    """query, name, distance, status: the card whose name is the query's, or the nearest within a third of its length.

    The reference leaves the choice to a remote service; this rule is our own. Names are compared in lower case. A
    query that d slips may part from a name is cut into d + 1 pieces, of which one must stand in the name as it is,
    at most d places off; so names meet by piece and place, and none within the bound is missed. Ties go by name.
    """
    slips = F.floor(F.length("q") / 3).cast("int")
    q = names.select("query").dropna().distinct().withColumn("q", F.lower("query")).withColumn("slips", slips)
    c = cards.select("name").dropna().distinct().withColumn("c", F.lower("name"))
    cut = lambda i: F.floor(i * F.length("q") / (F.col("slips") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("slips")), lambda i: F.struct(cut(i).alias("at"), F.substr("q", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    asked = q.select("query", "q", "slips", F.inline(pieces)).where("piece != ''").withColumn("at", F.explode(F.sequence(F.col("at") - F.col("slips"), F.col("at") + F.col("slips"))))
    parts = F.transform(F.sequence(F.lit(0), F.length("c") - 1), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.struct(i.alias("at"), F.substr("c", i + 1, n).alias("piece"))))
    held = c.where("c != ''").select("name", "c", F.inline(F.array_distinct(F.flatten(parts))))
    met = asked.join(held, ["piece", "at"]).where(F.abs(F.length("q") - F.length("c")) <= F.col("slips")).select("query", "q", "slips", "name", "c").distinct()
    near = met.select("query", "name", "slips", F.levenshtein("q", "c").alias("distance")).where("distance <= slips")
    best = near.groupBy("query").agg(F.min(F.struct("distance", "name")).alias("best")).select("query", "best.name", "best.distance")
    return q.select("query").join(best, "query", "left").withColumn("status", F.when(F.col("name").isNull(), "not_found").otherwise("ok"))


def plain_term(term: Column) -> Column:
    """Whether a term begins with an ASCII character, as the names of keywords do."""
    return (F.coalesce(term, F.lit("")) != "") & (F.ascii(term) < 128)


def keyword_rules(cards: DataFrame, glossary: DataFrame) -> DataFrame:
    """key, keyword, rules: the glossary's rules for each keyword of a card, by lower case; '-' without any. The last of repeated terms counts."""
    last = glossary.withColumn("keyword", F.lower("term_en")).withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("ord")))).where("n = 1").select("keyword", F.nullif(F.array_join("rules", " "), F.lit("")).alias("rules"))
    return cards.select("key", F.explode("keywords").alias("k")).withColumn("keyword", F.lower("k")).join(last, "keyword", "left").select("key", F.col("k").alias("keyword"), F.coalesce("rules", F.lit("-")).alias("rules"))
