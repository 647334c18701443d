"""The binary format: counts of columns and rows, each column's name, kind and width, then the columns' bytes in turn.

All numbers are little-endian; counts, lengths and widths have 8 bytes, a kind has 1. A value takes its width in whole bytes. A file
is one piece by design, so it is meant for exchange; Parquet is the native format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.schema import MAX_BITS, MAX_NAME_BYTES, ColumnInfo, Kind, Schema
from tessera.plans.table import ROW_ID, FlagTable


def encode_value(c: ColumnInfo, value) -> bytes:
    if c.kind == Kind.INT:
        return bytes(value) if isinstance(value, (bytes, bytearray)) else (int(value) % (1 << (8 * c.n_bytes))).to_bytes(c.n_bytes, "little")
    data = bytes([bool(value)]) if c.kind == Kind.BOOLEAN else value.encode() if c.kind == Kind.STRING else bytes(value)
    if len(data) > c.n_bytes:
        raise ValueError(f"{c.name}: {value!r} has more than {c.bits} bits")
    return data.ljust(c.n_bytes, b"\0")


def decode_value(c: ColumnInfo, data: bytes):
    if c.kind == Kind.INT:
        if c.bits > 126:
            return data
        value = int.from_bytes(data, "little")
        return value - (1 << 64) if c.bits <= 64 and value >= 1 << 63 else value
    if c.kind == Kind.BOOLEAN:
        return bool(data[0] & 1)
    return data.rstrip(b"\0").decode() if c.kind == Kind.STRING else data


def encode_header(schema: Schema, rows: int) -> bytes:
    out = [struct.pack("<QQ", len(schema), rows)]
    for c in schema.columns:
        name = c.name.encode()
        if len(name) > MAX_NAME_BYTES:
            raise ValueError(f"{c.name} is too long a name")
        out.append(struct.pack("<Q", len(name)) + name + struct.pack("<BQ", int(c.kind), c.bits))
    return b"".join(out)


def encode(schema: Schema, rows: list[tuple]) -> bytes:
    return encode_header(schema, len(rows)) + b"".join(encode_value(c, r[i]) for i, c in enumerate(schema.columns) for r in rows)


def decode_schema(data: bytes) -> tuple[Schema, int, int]:
    """The schema, the number of rows, and where the values start."""
    cols, rows = struct.unpack_from("<QQ", data)
    at, infos = 16, []
    for _ in range(cols):
        (size,) = struct.unpack_from("<Q", data, at)
        if size > MAX_NAME_BYTES:
            raise ValueError("a name is too long")
        name = data[at + 8 : at + 8 + size].decode()
        kind, bits = struct.unpack_from("<BQ", data, at + 8 + size)
        if kind > max(Kind) or bits > MAX_BITS:
            raise ValueError(f"{name}: kind {kind} of {bits} bits")
        infos.append(ColumnInfo(name, Kind(kind), bits))
        at += 17 + size
    return Schema(tuple(infos)), rows, at


def decode_rows(data: bytes) -> Iterator[tuple]:
    schema, rows, at = decode_schema(data)
    starts = []
    for c in schema.columns:
        starts.append(at)
        at += rows * c.n_bytes
    if at > len(data):
        raise ValueError("the file ends early")
    for i in range(rows):
        yield tuple(decode_value(c, data[s + i * c.n_bytes : s + (i + 1) * c.n_bytes]) for c, s in zip(schema.columns, starts))


def write(table: FlagTable, path: str) -> None:
    """One file at any path that Spark can write to.

    Tasks encode the values of a column in ranges of the row order; the driver passes those on one range at a time.
    """
    from tessera.operators.order import AT, RANGE, ranged

    spark = table.df.sparkSession
    rows = ranged(table.df.select(*table.schema.names, ROW_ID), [ROW_ID])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(encode_header(table.schema, rows.count())))
        for c in table.schema.columns:
            parts = rows.select(RANGE, AT, c.name).groupBy(RANGE).applyInPandas(_encoded(c, RANGE, AT), f"{RANGE} long, data binary")
            for r in parts.orderBy(RANGE).toLocalIterator():
                out.write(bytearray(r["data"]))
    finally:
        out.close()


def _encoded(c: ColumnInfo, by: str, at: str):
    def run(pdf):
        import pandas as pd

        data = b"".join(encode_value(c, v) for v in pdf.sort_values(at)[c.name])
        return pd.DataFrame({by: pdf[by].iloc[:1], "data": [data]})

    return run


def read(spark: SparkSession, path: str) -> FlagTable:
    """A table from one file; a task decodes it, the driver sees only its header."""
    from pyspark.sql import types as T

    file = spark.read.format("binaryFile").load(path)
    top = (MAX_NAME_BYTES + 17) * 256 + 16
    schema, _, _ = decode_schema(bytes(file.select(F.substring("content", 1, top).alias("c")).first()["c"]))
    out = T.StructType([*schema.struct().fields, T.StructField(ROW_ID, T.LongType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                held = []
                for i, row in enumerate(decode_rows(bytes(data))):
                    held.append((*row, i))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=out.names)
                        held = []
                yield pd.DataFrame(held, columns=out.names)

    return FlagTable(file.select("content").mapInPandas(run, out).withColumn("is_active", F.lit(True)), schema)
