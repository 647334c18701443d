"""The text format: a line "columns rows", a line "name kind bits" for each column, then a line for each row.

A value ends with a blank, a string with a semicolon (which its data can't hold). Whole numbers are written as the unsigned value
of their bits when under 64 of them; bits are lower-case hex. A file's lines stay together on reading (the header counts them), so
it is meant for exchange; Parquet is the native format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bits import low_bits
from tessera.plans.schema import ColumnInfo, Kind, Schema
from tessera.plans.table import ROW_ID, FlagTable


def header(schema: Schema, rows: int) -> list[str]:
    return [f"{len(schema)} {rows}", *(f"{c.name} {int(c.kind)} {c.bits}" for c in schema.columns)]


def _field(c: ColumnInfo) -> Column:
    col = F.col(c.name)
    if c.kind == Kind.INT:
        if c.bits > 64:
            raise ValueError(f"{c.name}: whole numbers of more than 64 bits have no text form")
        return F.concat(low_bits(col.cast("long"), c.bits).cast("string"), F.lit(" "))
    if c.kind == Kind.BOOLEAN:
        return F.concat(col.cast("int").cast("string"), F.lit(" "))
    if c.kind == Kind.STRING:
        bad = F.raise_error(F.concat(F.lit(f"{c.name}: a string holds a semicolon: "), col)).cast("string")
        return F.concat(F.when(col.contains(";"), bad).otherwise(col), F.lit(";"))
    return F.concat(F.lower(F.hex(col)), F.lit(" "))


def lines(table: FlagTable) -> DataFrame:
    """(n, value): the lines of the rows, numbered by row id."""
    return table.df.select(F.col(ROW_ID).alias("n"), F.concat(*[_field(c) for c in table.schema.columns]).alias("value"))


def write(table: FlagTable, path: str) -> None:
    """A folder of text parts that, in name order, make up the file."""
    spark = table.df.sparkSession
    rows = lines(table)
    head = header(table.schema, table.rows())
    top = spark.createDataFrame([(0, i, v) for i, v in enumerate(head)], "k int, n long, value string")
    everything = top.unionByName(rows.withColumn("k", F.lit(1)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    everything.repartitionByRange(n, "k", "n").sortWithinPartitions("k", "n").select("value").write.text(path)


def parse(c: ColumnInfo, text: str):
    """The value of a field's text, checked strictly."""
    if c.kind == Kind.INT:
        if c.bits > 64 or str(int(text)) != text:
            raise ValueError(f"{c.name}: {text!r} is no whole number of at most 64 bits")
        value = int(text)
        if not -(1 << (c.bits - 1)) <= value < 1 << c.bits:
            raise ValueError(f"{c.name}: {text} has more than {c.bits} bits")
        return value - (1 << 64) if value >= 1 << 63 else value
    if c.kind == Kind.BOOLEAN:
        if text not in ("0", "1"):
            raise ValueError(f"{c.name}: {text!r} is no boolean")
        return text == "1"
    if c.kind == Kind.STRING:
        if 8 * len(text.encode()) > c.bits:
            raise ValueError(f"{c.name}: {text!r} is longer than {c.bits} bits")
        return text
    data = bytes.fromhex(text)
    if len(data) != c.n_bytes:
        raise ValueError(f"{c.name}: {text!r} hasn't {c.bits} bits")
    return data


def _number(text: str) -> int:
    if str(int(text)) != text:
        raise ValueError(f"{text!r} is no count")
    return int(text)


def parse_header(top: list[str]) -> tuple[Schema, int]:
    cols, rows = (_number(t) for t in top[0].split(" "))
    infos = []
    for line in top[1 : cols + 1]:
        name, kind, bits = line.split(" ")
        infos.append(ColumnInfo(name, Kind(_number(kind)), _number(bits)))
    return Schema(tuple(infos)), rows


def parse_line(schema: Schema, line: str) -> list:
    out, at = [], 0
    for c in schema.columns:
        to = line.index(";" if c.kind == Kind.STRING else " ", at)
        out.append(parse(c, line[at:to]))
        at = to + 1
    if at != len(line):
        raise ValueError(f"more than {len(schema)} values: {line!r}")
    return out


def _group(c: ColumnInfo) -> str:
    """The pattern of a column's field, one group."""
    if c.kind == Kind.INT and c.bits > 64:
        raise ValueError(f"{c.name}: whole numbers of more than 64 bits have no text form")
    return {Kind.INT: "(0|-?[1-9][0-9]*) ", Kind.BOOLEAN: "([01]) ", Kind.STRING: "([^;]*);", Kind.BIN: f"([0-9A-Fa-f]{{{2 * c.n_bytes}}}) "}[c.kind]


def _parsed(c: ColumnInfo, text: Column) -> Column:
    """The value of a field that fits its pattern; an error where it doesn't fit its width."""
    bad = lambda kind: F.raise_error(F.concat(F.lit(f"{c.name}: more than {c.bits} bits: "), text)).cast(kind)
    if c.kind == Kind.INT:
        v = text.cast("decimal(38,0)")
        low, high = (F.lit(str(n)).cast("decimal(38,0)") for n in (-(1 << (c.bits - 1)), (1 << c.bits) - 1))
        wide = F.lit(str(1 << 64)).cast("decimal(38,0)")
        fits = F.when(v >= F.lit(str(1 << 63)).cast("decimal(38,0)"), v - wide).otherwise(v).cast("long")
        return F.when(F.length(text) > 21, bad("long")).when((v < low) | (v > high), bad("long")).otherwise(fits)
    if c.kind == Kind.BOOLEAN:
        return text == "1"
    if c.kind == Kind.STRING:
        return F.when(F.octet_length(text) * 8 > c.bits, bad("string")).otherwise(text)
    return F.unhex(text)


def read(spark: SparkSession, path: str) -> FlagTable:
    """A table from a text file or folder of parts. The header is read by the driver; rows are parsed where they are, by patterns in the JVM."""
    from tessera.operators.order import positions

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    numbered = positions(text, ["f", "m"], "n")
    top = {r["n"]: r["value"] for r in numbered.where("n < 256").collect()}
    count = _number(top[0].split(" ")[0]) + 1
    if count > 256:
        top = {r["n"]: r["value"] for r in numbered.where(F.col("n") < count).collect()}
    schema, rows = parse_header([top[i] for i in range(min(count, len(top)))])
    lines_ = numbered.where(F.col("n") >= count)
    if lines_.count() != rows:
        raise ValueError(f"the header tells of {rows} rows")
    pattern = "^" + "".join(_group(c) for c in schema.columns) + "$"
    line = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a row: "), F.col("value"))).cast("string"))
    fields = lines_.select((F.col("n") - count).alias(ROW_ID), line.alias("value"))
    values = [_parsed(c, F.regexp_extract("value", pattern, i + 1)).alias(c.name) for i, c in enumerate(schema.columns)]
    return FlagTable(fields.select(*values, ROW_ID, F.lit(True).alias("is_active")), schema)
