"""Segmented scans: running values that start anew at each segment.

A control bit of 0 starts a segment, 1 continues it. Segments are a key's rows in order, or are spelled out by bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import AT, RANGE, ranged, running_sum

#: Combining operators by name; "dup" keeps the left operand.
OPERATORS: dict[str, Callable[[Column], Column]] = {
    "dup": F.first, "add": F.sum, "xor": F.bit_xor, "and": F.bit_and, "or": F.bit_or, "min": F.min, "max": F.max,
}
DIRECTIONS = ("prefix", "suffix", "full")


def control_bits(df: DataFrame, key: str, row_id: str, name: str = "c") -> DataFrame:
    """0 on the first row of each key in the order (key, row_id), 1 on others; by an aggregate and a join, so that frequent keys are no hot spot."""
    first = df.groupBy(key).agg(F.min(row_id).alias("__first"))
    hit = df.join(first, df[key].eqNullSafe(first[key]), "left").drop(first[key])
    return hit.withColumn(name, F.when(F.col(row_id) == F.col("__first"), 0).otherwise(1)).drop("__first")


def segment_ids(df: DataFrame, bits: Column, row_id: str, name: str = "seg") -> DataFrame:
    """The number of the segment of each row, where bits are given over the order of row_id."""
    return running_sum(df, F.lit(1) - bits, [row_id], name)


def segmented_scan(df: DataFrame, segment: str | list[str], row_id: str, value: Column, op: str | Callable[[Column, Column], Column] = "add", direction: str = "prefix", name: str = "y") -> DataFrame:
    """The reduction of the values from the segment's start (prefix), to its end (suffix), or of all (full).

    Rows are dealt by ranges of the order (segment, row_id) and scanned there; a segment that lies in several ranges gets what its rows in
    the others add, one value for each range. So a segment of any size is spread over tasks.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    keys = [segment] if isinstance(segment, str) else segment
    if direction == "full" and not callable(op) and op != "dup":  # summed before the shuffle, then joined
        total = df.groupBy(*keys).agg(OPERATORS[op](value).alias(name))
        return df.join(total, keys)
    rows = ranged(df.withColumn("__x", value), [*keys, row_id])
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    inside = {"prefix": (start, 0), "suffix": (0, end), "full": (start, end)}[direction]
    outside = {"prefix": [(start, -1)], "suffix": [(1, end)], "full": [(start, -1), (1, end)]}[direction]

    def over(column: str, window, frame) -> Column:
        w = window.rowsBetween(*frame)
        if not callable(op):
            return OPERATORS[op](column).over(w)
        found = F.collect_list(column).over(w)  # any associative operator, folded in order
        return F.when(F.size(found) > 0, F.reduce(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.element_at(found, F.lit(1)), op))

    named = {"add": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b), "and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "min": F.least, "max": F.greatest, "dup": lambda a, b: a}
    join_two = op if callable(op) else named[op]
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join_two(a, b))
    # keys that begin a range are the only ones that can lie in several: one or two rows for each range
    edges = rows.where(F.col(AT) == 0).select(*[F.col(k).alias(f"__e_{k}") for k in keys]).distinct()
    same = lambda prefix: F.forall(F.array(*[F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]), lambda x: x) if len(keys) > 1 else F.col(keys[0]).eqNullSafe(F.col(f"{prefix}{keys[0]}"))
    last = rows.join(F.broadcast(edges), same("__e_"), "left_semi").withColumn("__local", over("__x", Window.partitionBy(RANGE, *keys).orderBy(AT), (start, end)))
    totals = last.groupBy(RANGE, *keys).agg(F.first("__local").alias("__t"))
    carry = totals.select(F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__c_{k}") for k in keys], *[over("__t", Window.partitionBy(*keys).orderBy(RANGE), f).alias(f"__o{i}") for i, f in enumerate(outside)])
    local = rows.withColumn(name, over("__x", Window.partitionBy(RANGE, *keys).orderBy(AT), inside))
    out = local.join(F.broadcast(carry), (F.col(RANGE) == F.col("__r")) & same("__c_"), "left")
    y, first, later = F.col(name), F.col("__o0"), F.col("__o1") if direction == "full" else None
    y = both(y, first) if direction == "suffix" else both(first, y)
    y = both(y, later) if direction == "full" else y
    return out.withColumn(name, y).select(*df.columns, name)


def bit_segments_scan(df: DataFrame, bits: Column, row_id: str, value: Column, op: str = "add", direction: str = "prefix", name: str = "y") -> DataFrame:
    """A segmented scan where control bits delimit the segments."""
    rows = segment_ids(df, bits, row_id, "__seg")
    return segmented_scan(rows, "__seg", row_id, value, op, direction, name).drop("__seg")
