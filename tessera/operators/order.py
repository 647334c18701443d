"""Positions and running values over a global order, without sending all rows to one task.

Rows are dealt to ranges of the order, and each range is handled on its own; a second step adds what the ranges before hold.
That is one number for each range, so what the driver sees doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE, AT = "__range", "__at"


def ranged(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """df with its range (ascending) and its place there; written once, so both are fixed whatever is recomputed."""
    from tessera.sources.tables import write_shared

    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return write_shared(dealt.withColumn(RANGE, F.shiftright(place, 33)).withColumn(AT, place.bitwiseAND(F.lit((1 << 33) - 1))))


def _before(df: DataFrame, totals: dict[int, int]) -> Column:
    """The sum of the totals of all ranges before the row's own, from a constant array by the range's number."""
    sums = [0]
    for r in range(max(totals, default=0)):
        sums.append(sums[-1] + (totals.get(r) or 0))
    return F.element_at(F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>"), F.col(RANGE).cast("int") + 1)


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """df with the place (from 0) of each row in the order, which must be total."""
    rows = ranged(df, order, ranges)
    totals = {r[0]: r[1] for r in rows.groupBy(RANGE).count().collect()}
    return rows.withColumn(name, F.col(AT) + _before(rows, totals)).drop(RANGE, AT)


def running_sum(df: DataFrame, value: Column, order: Sequence[Column | str], name: str, ranges: int | None = None) -> DataFrame:
    """df with the inclusive running sum of a long over the order."""
    rows = ranged(df.withColumn("__v", value.cast("long")), order, ranges)
    totals = {r[0]: r[1] for r in rows.groupBy(RANGE).agg(F.sum("__v")).collect()}
    inside = Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum("__v").over(inside) + _before(rows, totals)).drop(RANGE, AT, "__v")
