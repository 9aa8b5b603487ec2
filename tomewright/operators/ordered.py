"""Operators that look along an order, for groups of any size.

A window over a whole group would put it in one task. Here a group is cut into stretches of its order; what one
stretch hands to the next is a row each, and only those rows meet in a window over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a stretch, in units of the order column.
STRETCH = 100_000


def forward_fill(rows: DataFrame, key: str, order: str, value: str, out: str, stretch: int = STRETCH) -> DataFrame:
    """``out``: the last non-null ``value`` at or before each row of its key, by a numeric order without ties; null before the first."""
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lasts = cut.groupBy(key, "_stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(F.col(key).alias("_key"), F.col("_stretch").alias("_to"), before.alias("_carried"))
    joined = cut.withColumn("_inside", inside).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_to")), "left")
    return joined.withColumn(out, F.coalesce("_inside", "_carried")).drop("_stretch", "_inside", "_key", "_to", "_carried")


def next_value(rows: DataFrame, key: str, order: str, value: str, out: str, stretch: int = STRETCH) -> DataFrame:
    """``out``: the ``value`` of the row that follows in its key, by a numeric order without ties; null for the last."""
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    by = Window.partitionBy(key, "_stretch").orderBy(order)
    firsts = cut.groupBy(key, "_stretch").agg(F.min(F.struct(order, value)).alias("_first"))
    after = firsts.select(F.col(key).alias("_key"), F.col("_stretch").alias("_to"), F.lead(F.col(f"_first.{value}")).over(Window.partitionBy(key).orderBy("_stretch")).alias("_after"))
    joined = cut.withColumn("_inside", F.lead(value).over(by)).withColumn("_end", F.lead(F.lit(True)).over(by).isNull())
    joined = joined.join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_to")), "left")
    return joined.withColumn(out, F.when(F.col("_end"), F.col("_after")).otherwise(F.col("_inside"))).drop("_stretch", "_inside", "_end", "_key", "_to", "_after")


def running_count(rows: DataFrame, key: str, order: str, flag: str, out: str, stretch: int = STRETCH) -> DataFrame:
    """``out``: how many rows of its key have the boolean ``flag`` (which is dropped) at or before each row, by a numeric order without ties; null flags count as false."""
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    inside = F.count_if(F.col(flag)).over(Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = cut.groupBy(key, "_stretch").agg(F.count_if(F.col(flag)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select(F.col(key).alias("_key"), F.col("_stretch").alias("_to"), before.alias("_before"))
    joined = cut.withColumn("_inside", inside).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_to")))
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_stretch", "_inside", "_key", "_to", "_before", flag)
