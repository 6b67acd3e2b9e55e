"""A total order over rows of any number, without a task that holds them all.

Rows are dealt into ranges of their keys and written with their range's number.
What a row needs to know of the rows before it (how many, or the last of them)
it learns from its own range and from one carried value for each range, so only
one row per range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialize

RANGE = "_range"


def in_ranges(rows: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """The rows, stored, with the number of their range; nulls come first."""
    return materialize(rows.repartitionByRange(*keys).withColumn(RANGE, F.spark_partition_id()), purpose)


def _before(by: list[str], order: list[str]):
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def with_total_before(ranged: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before, apart for each value of ``by``.

    ``by`` has few values; ``order`` tells all rows apart and agrees with the ranges.
    """
    sized = ranged.withColumn("_amount", amount)
    totals = sized.groupBy(*by, RANGE).agg(F.sum("_amount").alias("_in_range"))
    carried = totals.select(*by, RANGE, F.coalesce(F.sum("_in_range").over(_before(by, [RANGE])), F.lit(0)).alias("_carried"))
    own = F.coalesce(F.sum("_amount").over(_before([*by, RANGE], order)), F.lit(0))
    # One row for each range and value of ``by``.
    summed = sized.withColumn("_own", own).join(F.broadcast(carried), [*by, RANGE])
    return summed.withColumn(name, F.col("_carried") + F.col("_own")).drop("_amount", "_own", "_carried")


def with_previous(ranged: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``value`` of the row before, null for the first row."""
    lasts = ranged.groupBy(RANGE).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = lasts.select(RANGE, F.lag("_last").over(Window.partitionBy(F.lit(1)).orderBy(RANGE)).alias("_carried"))
    inside = Window.partitionBy(RANGE).orderBy(*order)
    rows = ranged.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_own", F.lag(value).over(inside))
    joined = rows.join(F.broadcast(carried), RANGE)
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own"))).drop("_first", "_own", "_carried")
