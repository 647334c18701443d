"""Joins of a left table, unique in its key, to a right table.

The padded result has exactly the rows of the right table under their ids: right columns as they were, left
columns of the match or zeros, and a flag that tells whether there was one. Catalyst picks the physical join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.schema import ColumnInfo, Schema
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable


@dataclass(frozen=True)
class JoinSpec:
    """Keys and the columns of the result, in order, as (side, name) with side "l" or "r"."""

    left_key: str
    right_key: str
    select: tuple[tuple[str, str], ...]

    def check(self, left: FlagTable, right: FlagTable) -> None:
        a, b = left.schema[self.left_key], right.schema[self.right_key]
        if (a.kind, a.bits) != (b.kind, b.bits):
            raise TypeError(f"keys differ in type: {a} and {b}")
        for side, name in self.select:
            {"l": left, "r": right}[side].schema[name]

    def schema(self, left: FlagTable, right: FlagTable) -> Schema:
        return Schema(tuple({"l": left, "r": right}[s].schema[n] for s, n in self.select))


def _usable(table: FlagTable, ignore_active: bool) -> DataFrame:
    return table.df if ignore_active else table.df.where(ACTIVE)


def _unique(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Rows of distinct keys: the first by row id, or an error in the plan, or as declared."""
    if rule == "assume":
        return df
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.min_by(F.struct(*others), ROW_ID).alias("__row"), F.count("*").alias("__n"))
    if rule == "check":
        bad = F.raise_error(F.concat(F.lit("duplicate key on the left: "), F.col(key).cast("string")))
        grouped = grouped.where(F.when(F.col("__n") > 1, bad.cast("boolean")).otherwise(F.lit(True)))
    elif rule != "first":
        raise ValueError("left_keys must be first, check or assume")
    return grouped.select(key, "__row.*")


def om_join(left: FlagTable, right: FlagTable, spec: JoinSpec, compact: bool = False, left_keys: str = "first", ignore_active: bool = False) -> FlagTable:
    """One-to-many equi-join.

    left_keys: of several left rows with a key the first by row id matches ("first"), or the plan fails
    ("check"), or uniqueness is taken as declared and costs no aggregate ("assume"). Inactive rows don't match and stay
    inactive, unless ignore_active.
    """
    spec.check(left, right)
    schema = spec.schema(left, right)
    wanted = list(dict.fromkeys([spec.left_key, *(n for s, n in spec.select if s == "l")]))
    rows = _usable(left, ignore_active).select(*wanted, ROW_ID)
    rows = _unique(rows, spec.left_key, left_keys).select(*[F.col(n).alias(f"__l_{n}") for n in wanted], F.lit(True).alias("__hit"))
    r = right.df if not compact else _usable(right, ignore_active)
    usable = F.lit(True) if ignore_active or compact else F.col(ACTIVE)
    on = (F.col(spec.right_key) == F.col(f"__l_{spec.left_key}")) & usable
    joined = r.join(rows, on, "inner" if compact else "left")
    out = []
    for (side, name), info in zip(spec.select, schema.columns):
        column = F.col(name) if side == "r" else F.coalesce(F.col(f"__l_{name}"), F.lit(info.zero()).cast(left.df.schema[name].dataType))
        out.append(column.alias(name))
    return FlagTable(joined.select(*out, ROW_ID, F.coalesce("__hit", F.lit(False)).alias(ACTIVE)), schema)


def one_to_one(left: FlagTable, right: FlagTable, spec: JoinSpec, compact: bool = False) -> FlagTable:
    """The join of two tables that are both unique in their keys; the plan fails where they aren't."""
    r = right.with_df(_unique(right.df.where(ACTIVE), spec.right_key, "check")) if compact else right
    return om_join(left, r, spec, compact, "check")


def left_join(left: FlagTable, right: FlagTable, spec: JoinSpec) -> FlagTable:
    """All left rows, with the first right match or zeros."""
    turned = JoinSpec(spec.right_key, spec.left_key, tuple(({"l": "r", "r": "l"}[s], n) for s, n in spec.select))
    return om_join(right, left, turned)


def duplicate_keys(table: FlagTable, key: str) -> DataFrame:
    """Keys of more than one active row, and how many."""
    return table.df.where(ACTIVE).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def semi_join(right: FlagTable, left: FlagTable, right_key: str, left_key: str) -> FlagTable:
    """Right rows with a match."""
    keys = left.df.where(ACTIVE).select(F.col(left_key).alias("__k"))
    return right.with_df(right.df.where(ACTIVE).join(keys, F.col(right_key) == F.col("__k"), "left_semi"))


def anti_join(right: FlagTable, left: FlagTable, right_key: str, left_key: str) -> FlagTable:
    """Right rows without a match."""
    keys = left.df.where(ACTIVE).select(F.col(left_key).alias("__k"))
    return right.with_df(right.df.where(ACTIVE).join(keys, F.col(right_key) == F.col("__k"), "left_anti"))


def right_outer_join(left: FlagTable, right: FlagTable, spec: JoinSpec) -> DataFrame:
    """The padded join with nulls in place of zeros."""
    out = om_join(left, right, spec)
    cols = [F.when(F.col(ACTIVE), F.col(n)).alias(n) if s == "l" else F.col(n) for s, n in spec.select]
    return out.df.select(*cols)


def right_union(left: FlagTable, right: FlagTable, left_key: str, right_key: str, columns: list[tuple[str, str]]) -> FlagTable:
    """All left rows, then right rows whose key no left row has. columns: (left name, right name); the left names stay."""
    if any((left.schema[a].kind, left.schema[a].bits) != (right.schema[b].kind, right.schema[b].bits) for a, b in columns):
        raise TypeError("columns of a union need one type")
    schema = Schema(tuple(ColumnInfo(a, left.schema[a].kind, left.schema[a].bits) for a, _ in columns))
    rest = anti_join(right, left, right_key, left_key).df
    # the side is a part of the id, so that ids of any kind stay apart, and left rows come first
    kinds = [t.df.schema[ROW_ID].dataType for t in (left, right)]
    ids = lambda side: F.struct(F.lit(side).alias("side"), *[(F.col(ROW_ID) if i == side else F.lit(None).cast(k)).alias(n) for i, (n, k) in enumerate(zip(("left", "right"), kinds))]).alias(ROW_ID)
    first = left.df.where(ACTIVE).select(*[a for a, _ in columns], ids(0), ACTIVE)
    second = rest.select(*[F.col(b).alias(a) for a, b in columns], ids(1), ACTIVE)
    return FlagTable(first.unionByName(second), schema)
