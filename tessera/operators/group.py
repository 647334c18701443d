"""Grouped sums and counts over one key.

Compact: a row for each group of active rows. Padded: every row stays; a group's result stands on its first row, which alone
counts; active and inactive rows never share a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bits import WIDE, wrap
from tessera.operators.order import AT, RANGE, ranged
from tessera.plans.schema import ColumnInfo, Kind, Schema
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable

COUNT = "Count"
#: Reductions by name; a callable (state, value) -> state over Columns is folded in row order.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "bit_xor": F.bit_xor, "bit_and": F.bit_and, "bit_or": F.bit_or,
}
WRAPS = (None, "declared", "bytes")


def _width(c: ColumnInfo, rule: str | None) -> int:
    return 64 if rule is None else c.bits if rule == "declared" else 8 * c.n_bytes


def _reduced(c: ColumnInfo, rule: str | None, reduce: str) -> Column:
    if reduce != "sum":
        return REDUCERS[reduce](F.col(c.name))
    if rule is None:
        return F.sum(F.col(c.name).cast("long"))
    return F.sum(F.col(c.name).cast(WIDE))


def group_sum(table: FlagTable, key: str, sums: Sequence[str], compact: bool = True, include_inactive: bool = False, wrap_rule: str | None = None, reduce: str | Callable = "sum", count: str = COUNT) -> FlagTable:
    """Sums (or another reduction) of columns and the number of rows for each key.

    wrap_rule: None sums without wrapping, "declared" wraps at the column's width, "bytes" at its width in whole
    bytes. include_inactive: all rows are summed and the first row of a group decides whether the group counts.
    """
    if wrap_rule not in WRAPS:
        raise ValueError(f"wrap_rule must be one of {WRAPS}")
    k = table.schema[key]
    infos = [table.schema[n] for n in sums]
    if any(c.kind != Kind.INT for c in infos):
        raise TypeError("only whole numbers are reduced")
    schema = Schema((k, *(ColumnInfo(c.name, Kind.INT, _width(c, wrap_rule)) for c in infos), ColumnInfo(count, Kind.INT, 64)))
    if callable(reduce):
        return _folded(table, k, infos, schema, reduce, count)
    done = lambda c, v: wrap(v, _width(c, wrap_rule)) if wrap_rule and reduce == "sum" else v
    if compact:
        rows = table.df if include_inactive else table.df.where(ACTIVE)
        flag = F.min_by(ACTIVE, ROW_ID).alias(ACTIVE) if include_inactive else F.lit(True).alias(ACTIVE)
        out = rows.groupBy(key).agg(*[_reduced(c, wrap_rule, reduce).alias(c.name) for c in infos], F.count("*").alias(count), F.min(ROW_ID).alias(ROW_ID), flag)
        out = out.select(key, *[done(c, F.col(c.name)).alias(c.name) for c in infos], count, ROW_ID, ACTIVE)
        return FlagTable(out.where(ACTIVE), schema)
    # a group's result comes by an aggregate and a join, so a frequent key is summed before it is shuffled
    by = [key] if include_inactive else [key, ACTIVE]
    result = table.df.groupBy(*by).agg(*[_reduced(c, wrap_rule, reduce).alias(f"__s_{c.name}") for c in infos], F.count("*").alias("__n"), F.min(ROW_ID).alias("__first"))
    joined = table.df.join(result, by)
    first = (F.col(ROW_ID) == F.col("__first")) & F.col(ACTIVE)
    return FlagTable(joined.select(key, *[done(c, F.col(f"__s_{c.name}")).alias(c.name) for c in infos], F.col("__n").alias(count), ROW_ID, first.alias(ACTIVE)), schema)


def _folded(table: FlagTable, k: ColumnInfo, infos: list[ColumnInfo], schema: Schema, reduce: Callable, count: str) -> FlagTable:
    """A custom associative reduction in row order: within each range of the order (key, row id), then over a key's ranges."""
    names = [c.name for c in infos]

    def fold(df: DataFrame, by: list[str], order: str, *others: Column) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(order, *names))).alias("__rows")
        step = lambda name: lambda state, row: reduce(state, row[name])
        folded = [F.reduce(F.slice("__rows", 2, F.size("__rows")), F.element_at("__rows", 1)[n], step(n)).alias(n) for n in names]
        kept = df.groupBy(*by).agg(rows, *others)
        return kept.select(*folded, *[c for c in kept.columns if c != "__rows"])

    rows = ranged(table.df.where(ACTIVE), [k.name, ROW_ID])
    parts = fold(rows, [k.name, RANGE], AT, F.count("*").alias(count), F.min(ROW_ID).alias(ROW_ID))
    got = fold(parts, [k.name], RANGE, F.sum(count).alias(count), F.min(ROW_ID).alias(ROW_ID))
    return FlagTable(got.select(k.name, *names, count, ROW_ID, F.lit(True).alias(ACTIVE)), schema)


def group_average(table: FlagTable, key: str, columns: Sequence[str]):
    """Averages of the active rows of each key."""
    return table.df.where(ACTIVE).groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def first_of_group(table: FlagTable, key: str) -> FlagTable:
    """Only the first active row of each key stays active."""
    rank = F.row_number().over(Window.partitionBy(key, ACTIVE).orderBy(ROW_ID))
    return table.with_df(table.df.withColumn(ACTIVE, F.col(ACTIVE) & (rank == 1)))
