"""Typed columns of declared width.

Four kinds of columns exist; the width in bits is part of the type and travels in the field metadata of the Spark schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

#: Limits of the binary format.
MAX_NAME_BYTES, MAX_BITS = 512, 1 << 14


class Kind(IntEnum):
    INT = 0
    BOOLEAN = 1
    STRING = 2
    BIN = 3


@dataclass(frozen=True)
class ColumnInfo:
    """Name, kind and width in bits of a column."""

    name: str
    kind: Kind
    bits: int

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= MAX_BITS:
            raise ValueError(f"{self.name}: width must be 1 to {MAX_BITS} bits")
        if self.kind == Kind.STRING and self.bits % 8:
            raise ValueError(f"{self.name}: the width of a string is a multiple of 8")
        if self.kind == Kind.BOOLEAN and self.bits != 1:
            raise ValueError(f"{self.name}: a boolean has 1 bit")

    @property
    def n_bytes(self) -> int:
        return -(-self.bits // 8)

    def data_type(self) -> T.DataType:
        if self.kind == Kind.INT:
            return T.LongType() if self.bits <= 64 else T.DecimalType(38, 0) if self.bits <= 126 else T.BinaryType()
        return {Kind.BOOLEAN: T.BooleanType(), Kind.STRING: T.StringType(), Kind.BIN: T.BinaryType()}[self.kind]

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type(), False, {"kind": self.kind.name, "bits": self.bits})

    def zero(self):
        """The value that unmatched rows carry."""
        if self.kind == Kind.INT:
            return bytes(self.n_bytes) if self.bits > 126 else 0
        return {Kind.BOOLEAN: False, Kind.STRING: "", Kind.BIN: bytes(self.n_bytes)}[self.kind]


_DEFAULT_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def infer(f: T.StructField) -> ColumnInfo:
    """The column of a Spark field: from its metadata if there, else the width of its type."""
    if "kind" in f.metadata:
        return ColumnInfo(f.name, Kind[f.metadata["kind"]], f.metadata["bits"])
    name = f.dataType.simpleString()
    if name in _DEFAULT_BITS:
        return ColumnInfo(f.name, Kind.INT, _DEFAULT_BITS[name])
    if name.startswith("decimal") and name.endswith(",0)"):
        return ColumnInfo(f.name, Kind.INT, 126)
    if name == "boolean":
        return ColumnInfo(f.name, Kind.BOOLEAN, 1)
    if name == "string":
        return ColumnInfo(f.name, Kind.STRING, 256)
    if name == "binary":
        return ColumnInfo(f.name, Kind.BIN, 64)
    raise TypeError(f"{f.name}: no kind of column for {name}")


@dataclass(frozen=True)
class Schema:
    """Ordered columns with distinct names."""

    columns: tuple[ColumnInfo, ...] = field(default=())

    def __post_init__(self) -> None:
        if len(set(self.names)) != len(self.columns):
            raise ValueError(f"column names repeat: {self.names}")

    @staticmethod
    def of(*columns: ColumnInfo | tuple[str, Kind, int]) -> Schema:
        return Schema(tuple(c if isinstance(c, ColumnInfo) else ColumnInfo(*c) for c in columns))

    @staticmethod
    def from_struct(struct: T.StructType, skip: tuple[str, ...] = ()) -> Schema:
        return Schema(tuple(infer(f) for f in struct if f.name not in skip))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, key: int | str) -> ColumnInfo:
        if isinstance(key, int):
            return self.columns[key]
        for c in self.columns:
            if c.name == key:
                return c
        raise KeyError(f"no column {key!r} among {self.names}")

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])
