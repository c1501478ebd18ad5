"""Places in a total order, without sorting a whole table or group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, fresh, stored

#: Rows that one range holds, about.
RANGE_ROWS = 10_000


def with_sums_before(rows: DataFrame, value: str, order: list[Column], part: list[str], group: list[str], name: str) -> DataFrame:
    """rows with `name`: the sum of value over all rows of the same group that come before in the order.

    part: columns that number ranges of the order within each group, so that all rows of a lower range come before those of a higher one. A range is summed up in one task; ranges by prefix sums over their totals.
    """
    start, = fresh(rows, "start")
    totals = rows.groupBy(*group, *part).agg(F.sum(value).alias(start))
    earlier = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn(start, F.coalesce(F.sum(start).over(earlier), F.lit(0)))
    starts = bounded(stored(starts), BROADCAST_ROWS)
    inside = Window.partitionBy(*group, *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, *part]
    right = starts.select(*[F.col(k).alias(f"{start}_{i}") for i, k in enumerate(keys)], start)
    same = [F.col(k).eqNullSafe(F.col(f"{start}_{i}")) for i, k in enumerate(keys)]
    met = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(right, same)
    return met.withColumn(name, F.col(name) + F.col(start)).select(*rows.columns, name)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with `name`: their place (from 1) in the order. Ranges are cut by Spark's sampled quantiles and written, so that they hold however often a task runs."""
    n = rows.count()
    part, one, all_ = fresh(rows, "part", "one", "all_")
    dealt = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order)
    dealt = stored(dealt.withColumn(part, F.spark_partition_id())).withColumn(one, F.lit(1).cast("long")).withColumn(all_, F.lit(0))
    placed = with_sums_before(dealt, one, order, [part], [all_], name)
    return placed.withColumn(name, F.col(name) + 1).drop(part, one, all_)
