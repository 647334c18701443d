"""Splitting tables into two shares and combining them again. A data transformation; it keeps nothing secret.

Masks are hashes of seed, row id and column, never rand(), so recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.schema import ColumnInfo, Kind
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable

_MODULUS = 1 << 32


def _mask(seed: int, number: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(ROW_ID), F.lit(number))


def _mask_bytes(seed: int, number: int, size: Column) -> Column:
    """As many mask bytes (in hex) as the value has: digests by running number."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda i: F.sha2(F.concat_ws(":", F.lit(seed), F.col(ROW_ID), F.lit(number), i), 256))
    return F.substring(F.concat_ws("", blocks), F.lit(1), (size * 2).cast("int"))


def _xor_hex(a: Column, b: Column) -> Column:
    """The exclusive or of two hex texts of one length, seven bytes at a time."""
    at = F.sequence(F.lit(1), F.length(a), F.lit(14))
    word = lambda s, i: F.conv(F.substring(s, i, F.lit(14)), 16, 10).cast("long")
    one = lambda i: F.lpad(F.hex(word(a, i).bitwiseXOR(word(b, i))), F.length(F.substring(a, i, F.lit(14))), F.lit("0"))
    return F.when(F.length(a) == 0, F.lit("")).otherwise(F.concat_ws("", F.transform(at, one)))


def _split(c: ColumnInfo, seed: int, number: int) -> tuple[Column, Column]:
    col = F.col(c.name)
    if c.kind == Kind.INT and c.bits <= 64:
        m = _mask(seed, number)
        return m, col.cast("long").bitwiseXOR(m)
    if c.kind == Kind.BOOLEAN:
        m = _mask(seed, number) < 0
        return m, col != m
    data = F.hex(col.cast("binary") if c.kind == Kind.STRING else col)
    m = _mask_bytes(seed, number, F.length(data) / 2)
    return F.unhex(m), F.unhex(_xor_hex(data, F.upper(m)))


def share(table: FlagTable, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables whose exclusive or is the table, flags included. A share alone looks random but is a hash of known values."""
    if any(c.kind == Kind.INT and c.bits > 64 for c in table.schema.columns):
        raise TypeError("whole numbers of more than 64 bits aren't shared")
    parts = [_split(c, seed, i) for i, c in enumerate(table.schema.columns)]
    flag = _mask(seed, -1) < 0
    names = table.schema.names
    first = table.df.select(*[p[0].alias(n) for p, n in zip(parts, names)], ROW_ID, flag.alias(ACTIVE))
    second = table.df.select(*[p[1].alias(n) for p, n in zip(parts, names)], ROW_ID, (F.col(ACTIVE) != flag).alias(ACTIVE))
    return first, second


def reveal(first: DataFrame, second: DataFrame, table: FlagTable, remove_inactive: bool = True) -> FlagTable:
    """The table (whose schema is given by ``table``) that two shares stand for."""
    a, b = first.alias("__s0"), second.alias("__s1")
    both = a.join(b, F.col(f"__s0.{ROW_ID}") == F.col(f"__s1.{ROW_ID}"))
    out = []
    for c in table.schema.columns:
        x, y = F.col(f"__s0.{c.name}"), F.col(f"__s1.{c.name}")
        if c.kind == Kind.INT:
            v = x.bitwiseXOR(y)
        elif c.kind == Kind.BOOLEAN:
            v = x != y
        else:
            v = F.unhex(_xor_hex(F.hex(x), F.hex(y)))
            v = v.cast("string") if c.kind == Kind.STRING else v
        out.append(v.alias(c.name))
    df = both.select(*out, F.col(f"__s0.{ROW_ID}").alias(ROW_ID), (F.col(f"__s0.{ACTIVE}") != F.col(f"__s1.{ACTIVE}")).alias(ACTIVE))
    return FlagTable(df.where(ACTIVE) if remove_inactive else df, table.schema)


def share_u32(value: Column, row_id: Column, seed: int = 0) -> tuple[Column, Column]:
    """Two residues modulo 2^32 whose sum is the value's."""
    m = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(_MODULUS))
    return m, F.pmod(value.cast("long") - m, F.lit(_MODULUS))


def reveal_u32(a: Column, b: Column) -> Column:
    return F.pmod(a + b, F.lit(_MODULUS))
