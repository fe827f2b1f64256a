"""Places in a total order, and windows over it, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in an order that no two rows share: rows are dealt out by ranges of the order, counted in
    each range, and a range's places begin after the counts of those before it (one row a range)."""
    ranges = materialise(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(offsets, "range").select(*df.columns, (within + F.col("offset")).cast("bigint").alias(name))


def following_sum(rows: DataFrame, value: str, ahead: int, name: str, place: str = "place", block: int = 1 << 17) -> DataFrame:
    """rows (with dense places) with the sum of a value over each and the `ahead` rows after it: blocks of places, each with the
    first rows of the next."""
    own = F.floor((F.col(place) - 1) / block)
    lead = (F.col(place) - 1) % block < ahead
    copied = rows.withColumn("block", F.explode(F.when(lead & (own > 0), F.array(own, own - 1)).otherwise(F.array(own)))).withColumn("own", F.col("block") == own)
    window = Window.partitionBy("block").orderBy(place).rowsBetween(Window.currentRow, ahead)
    return copied.withColumn(name, F.sum(value).over(window)).where("own").drop("block", "own")
