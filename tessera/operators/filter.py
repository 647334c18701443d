"""Filters: a predicate joins the activity flag (padded), or its rows remain (compact)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.gates import Builder
from tessera.plans.table import ACTIVE, FlagTable

Predicate = Column | str | Builder | Callable[..., Column]


def predicate(table: FlagTable, pred: Predicate, inputs: Sequence[str] | None = None) -> Column:
    """The Column of a predicate: itself, SQL text, a gate list, or a callable over the input columns."""
    if isinstance(pred, Builder):
        return pred.compile()
    if isinstance(pred, str):
        return F.expr(pred)
    if isinstance(pred, Column):
        return pred
    return pred(*[F.col(table.schema[n].name) for n in (inputs or table.schema.names)])


def where(table: FlagTable, pred: Predicate, compact: bool = False, inputs: Sequence[str] | None = None) -> FlagTable:
    """Rows count if they did and the predicate holds; a null result doesn't. Compact filters reach the scan."""
    holds = predicate(table, pred, inputs)
    if compact:  # a filter drops null results itself; wrapping them would keep it from the scan
        return table.with_df(table.df.where(F.col(ACTIVE) & holds))
    return table.with_df(table.df.withColumn(ACTIVE, F.col(ACTIVE) & F.coalesce(holds, F.lit(False))))
