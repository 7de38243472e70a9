"""Numbers of rows in a global order, without a task that holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

#: Bits that a row's number within its range takes in Spark's increasing ids.
_WITHIN = 33


def numbered(df: DataFrame, order: list[Column], into: str, ranges: int | None = None) -> DataFrame:
    """Adds each row's place, from 0, in the order.

    Rows are dealt to ranges by sampled bounds and sorted there, in one shuffle, and written with
    their range and their place within it. Counts by range, one row a range, are prefix-summed,
    and a range's sum is added to the places within. Rows that are equal in the order meet in one
    range, so the order should tell most rows apart.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    bucket = F.shiftright("__id", _WITHIN)
    sums = dealt.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("__bucket", before.cast("long").alias("__before")))  # one row a range
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return dealt.withColumn("__bucket", bucket).join(offsets, "__bucket").withColumn(into, place).drop("__id", "__bucket", "__before")
