"""Full deliveries of a rulebook: choosing the snapshot of each date, and what changed between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_date, rule_number, same_look_udf


def chosen_deliveries(documents: DataFrame) -> DataFrame:
    """One row per language and effective date: its latest delivery, with the date's place ``seq`` among the dates.

    Of deliveries at the same moment the highest id counts; one without a time comes before all others; repeated
    header rows are one. Headers without a language, an id or a readable date name no snapshot and are left out.
    Output: delivery_id, language, effective_date, seq, n_dates. The input holds a row per delivery, not per rule.
    """
    dated = documents.select("delivery_id", "language", iso_date(F.col("effective_date")).alias("effective_date"), "delivered_at").dropna(subset=["delivery_id", "language", "effective_date"])
    latest = dated.groupBy("language", "effective_date").agg(F.max(F.struct("delivered_at", "delivery_id")).alias("last"))
    by_date = Window.partitionBy("language").orderBy("effective_date")
    return latest.select(
        F.col("last.delivery_id").alias("delivery_id"), "language", "effective_date",
        F.row_number().over(by_date).alias("seq"), F.count("*").over(Window.partitionBy("language")).alias("n_dates"),
    )


def snapshot_rows(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of the chosen deliveries: language, effective_date, seq, n_dates, number (plain), ord, text.

    A number may still occur more than once in a snapshot. Rows whose number is null or blank are no records.
    """
    rows = entries.select("delivery_id", "ord", rule_number(F.col("number")).alias("number"), "text").where("number is not null")
    return rows.join(chosen_deliveries(documents), "delivery_id").drop("delivery_id")


def snapshot_changes(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """The numbers added, removed or changed in text between consecutive effective dates of a language.

    Each row is tagged with a side and sent to the pair it closes (``new``) and the pair it opens (``old``); one
    aggregation by language, pair and number keeps, per side, the hash of the row with the lowest ``ord`` and
    classifies from the two. The partial aggregation runs before that one shuffle, so a number repeated any
    number of times costs one row per task. Texts are hashed by their looks (``same_look``); a null text is a
    text of its own, unlike an empty one. Of rows with the same ``ord`` the lowest hash counts; a null ``ord``
    comes first. Empty input gives no rows, and the first snapshot of a language none.
    Output: language, effective_date (of the later snapshot), number, change_kind (added, removed, changed).
    """
    rows = snapshot_rows(documents, entries).select(
        "language", "effective_date", "seq", "n_dates", "number", "ord",
        F.coalesce(F.unhex(F.md5(same_look_udf("text"))), F.unhex(F.lit("00"))).alias("hash"),
    )
    sides = F.array(F.struct(F.col("seq").alias("pair"), F.lit(True).alias("new")), F.struct((F.col("seq") + 1).alias("pair"), F.lit(False).alias("new")))
    tagged = rows.withColumn("side", F.explode(sides)).where("side.pair > 1 and side.pair <= n_dates")
    first = F.struct("ord", "hash")
    grouped = tagged.groupBy("language", F.col("side.pair").alias("seq"), "number").agg(
        F.min(F.when(F.col("side.new"), first))["hash"].alias("new"), F.min(F.when(~F.col("side.new"), first))["hash"].alias("old")
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    changes = grouped.select("language", "seq", "number", kind.alias("change_kind")).where("change_kind is not null")
    dates = chosen_deliveries(documents).select("language", "seq", "effective_date")
    return changes.join(dates, ["language", "seq"]).select("language", "effective_date", "number", "change_kind")
