"""Stable sorts, in the unsigned little-endian order of fixed-width values or the natural one, and the passes of a radix sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import unsigned
from tessera.operators.order import positions
from tessera.plans.schema import ColumnInfo, Kind
from tessera.plans.table import ROW_ID, FlagTable

ORDERS = ("unsigned_le", "natural")


def sort_key(c: ColumnInfo, order: str = "unsigned_le") -> list[Column]:
    """Columns whose natural order is the order of the values' bits.

    A string compares from its last byte, and zero bytes follow a shorter one: by length, then reversed.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    col = F.col(c.name)
    if order == "natural" or c.kind == Kind.BOOLEAN:
        return [col]
    if c.kind == Kind.INT and c.bits <= 126:
        return [unsigned(col, c.bits)]
    if c.kind == Kind.STRING:
        return [F.length(col), F.reverse(col)]
    return [F.reverse(F.split(F.regexp_replace(F.hex(col), "(..)", "$1,"), ","))]


def sorted_positions(table: FlagTable, columns: Sequence[str], order: str = "unsigned_le", name: str = "pos") -> DataFrame:
    """The rows with their place in the stable order by the columns (the first is the primary one)."""
    keys = [k for n in columns for k in sort_key(table.schema[n], order)]
    return positions(table.df, [*keys, F.col(ROW_ID)], name)


def sort_table(table: FlagTable, order: str = "unsigned_le") -> FlagTable:
    """The table under row ids by the order of all its columns."""
    rows = sorted_positions(table, table.schema.names, order, "__pos")
    return table.with_df(rows.drop(ROW_ID).withColumnRenamed("__pos", ROW_ID))


def sort_permutation(table: FlagTable, columns: Sequence[str], order: str = "unsigned_le", inverse: bool = False) -> DataFrame:
    """(i, pi): at place i of the order stands row pi; or, if inverse, row i has place pi."""
    rows = sorted_positions(table, columns, order, "__pos")
    return rows.select(F.col(ROW_ID).alias("i"), F.col("__pos").alias("pi")) if inverse else rows.select(F.col("__pos").alias("i"), F.col(ROW_ID).alias("pi"))


def digit(value: Column, begin: int, size: int) -> Column:
    """The bits from begin on, at most 8 of them."""
    if not 0 < size <= 8:
        raise ValueError("a digit has 1 to 8 bits")
    return F.shiftrightunsigned(value.cast("long"), begin).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("int")


def one_hot(value: Column, n: int, prefix: str = "f") -> list[Column]:
    """For each of n values a column that is 1 where it is the value."""
    return [F.when(value == j, 1).otherwise(0).alias(f"{prefix}{j}") for j in range(n)]


def hadamard_sum(flags: Sequence[Column], values: Sequence[Column]) -> Column:
    """The sum of the values whose flags are set: with one-hot flags, the value that belongs to the row's digit."""
    out = F.lit(0).cast("long")
    for f, v in zip(flags, values, strict=True):
        out = out + f.cast("long") * v.cast("long")
    return out


def digit_pass(df: DataFrame, value: Column, row_id: str, name: str = "dst") -> DataFrame:
    """The place of each row after one stable pass by a digit: the rows of smaller digits, and those before it of its own."""
    return positions(df.withColumn("__digit", value), ["__digit", row_id], name).drop("__digit")


def radix_sort(df: DataFrame, value: str, bits: int, row_id: str, digit_bits: int = 8, name: str = "pos") -> DataFrame:
    """Places by least-significant-digit passes; the same as ``positions`` by the unsigned value, which is one pass."""
    out, at = df, row_id
    for k, begin in enumerate(range(0, bits, digit_bits)):
        to = f"__pass{k}"
        out = digit_pass(out, digit(F.col(value), begin, min(digit_bits, bits - begin)), at, to)
        out = out.drop(at) if k else out
        at = to
    return out.withColumnRenamed(at, name)
