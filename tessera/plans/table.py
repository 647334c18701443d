"""Flag-carrying tables: a DataFrame with a row id and an activity flag.

Every operator returns rows that its input determines and marks those that count (padded), or only those
that count (compact). Row order is the order of ``__row_id``, which is a column derived from data, never from the physical plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.schema import ColumnInfo, Schema

ROW_ID, ACTIVE = "__row_id", "is_active"


@dataclass(frozen=True)
class FlagTable:
    """df has the schema's columns, ROW_ID (unique: a long, or a struct of a composite id) and ACTIVE (boolean)."""

    df: DataFrame
    schema: Schema

    # construction

    @staticmethod
    def of(df: DataFrame, row_id: Column | str | Sequence[str], active: Column | None = None, schema: Schema | None = None) -> FlagTable:
        """A table over the columns of ``df``; row_id: a whole number, or several columns, unique for each row. Without ``active`` all rows count."""
        schema = schema or Schema.from_struct(df.schema, (ROW_ID, ACTIVE))
        key = F.col(row_id).cast("long") if isinstance(row_id, str) else row_id.cast("long") if isinstance(row_id, Column) else F.struct(*row_id)
        flag = F.lit(True) if active is None else F.coalesce(active.cast("boolean"), F.lit(False))
        return FlagTable(df.select(*schema.names, key.alias(ROW_ID), flag.alias(ACTIVE)), schema)

    @staticmethod
    def zeros(spark: SparkSession, rows: int, schema: Schema) -> FlagTable:
        """``rows`` rows of zeros, all active."""
        df = spark.range(rows).select(*[F.lit(c.zero()).cast(c.data_type()).alias(c.name) for c in schema.columns], F.col("id").alias(ROW_ID), F.lit(True).alias(ACTIVE))
        return FlagTable(df, schema)

    @staticmethod
    def from_rows(spark: SparkSession, rows: Sequence[Sequence], schema: Schema, active: Sequence[bool] | None = None) -> FlagTable:
        flags = [True] * len(rows) if active is None else list(active)
        struct = schema.struct().add(ROW_ID, "long", False).add(ACTIVE, "boolean", False)
        return FlagTable(spark.createDataFrame([(*r, i, bool(f)) for i, (r, f) in enumerate(zip(rows, flags, strict=True))], struct), schema)

    # introspection

    def column_info(self) -> list[ColumnInfo]:
        return list(self.schema.columns)

    def rows(self) -> int:
        return self.df.count()

    def cols(self) -> int:
        return len(self.schema)

    def __getitem__(self, key: int | str) -> Column:
        return self.df[self.schema[key].name]

    # shape

    def with_df(self, df: DataFrame, schema: Schema | None = None) -> FlagTable:
        schema = schema or self.schema
        return FlagTable(df.select(*schema.names, ROW_ID, ACTIVE), schema)

    def select(self, *names: str) -> FlagTable:
        return self.with_df(self.df, Schema(tuple(self.schema[n] for n in names)))

    def resize(self, n: int) -> FlagTable:
        """The first n rows of a table whose row ids count from 0, filled up with zero rows (active, as new rows have no flag of their own)."""
        kept = self.df.where((F.col(ROW_ID) >= 0) & (F.col(ROW_ID) < n))
        ids = self.df.sparkSession.range(n).withColumnRenamed("id", ROW_ID)
        out = ids.join(kept, ROW_ID, "left")
        zero = [F.coalesce(F.col(c.name), F.lit(c.zero()).cast(self.df.schema[c.name].dataType)).alias(c.name) for c in self.schema.columns]
        return FlagTable(out.select(*zero, ROW_ID, F.coalesce(ACTIVE, F.lit(True)).alias(ACTIVE)), self.schema)

    def permute(self, perm: DataFrame, inverse: bool = False) -> FlagTable:
        """Rows moved by a permutation (i, pi): row i of the result is row pi[i], or row pi[i] is row i if inverse."""
        source, target = ("i", "pi") if inverse else ("pi", "i")
        moved = self.df.join(perm.select(F.col(source).alias(ROW_ID), F.col(target).alias("__to")), ROW_ID)
        return self.with_df(moved.drop(ROW_ID).withColumnRenamed("__to", ROW_ID))

    # rows that count

    def extract(self) -> FlagTable:
        """Only active rows, in order; all of them active."""
        return self.with_df(self.df.where(ACTIVE))

    def extract_shuffled(self, seed: int = 0) -> FlagTable:
        """Only active rows under new ids in an order that the seed decides (a hash of the row id, so a recomputed task agrees)."""
        return self.with_df(self.df.where(ACTIVE).withColumn(ROW_ID, F.struct(F.xxhash64(ROW_ID, F.lit(seed)).alias("place"), F.col(ROW_ID).alias("was"))))

    def rows_between(self, first: int, count: int | None = None) -> FlagTable:
        """``count`` rows (without it, all) from row id ``first`` on, of a table whose row ids count from 0, under ids from 0."""
        n = self.rows()
        count = n - first if count is None else count
        if not 0 <= first < n or first + count > n:
            raise ValueError(f"rows {first} to {first + count} of a table of {n}")
        at = F.col(ROW_ID)
        return self.with_df(self.df.where((at >= first) & (at < first + count)).withColumn(ROW_ID, at - first))

    def reshape(self, name: str, bits: int) -> FlagTable:
        """The table with a column declared at another width, within the bytes that the column has."""
        c = self.schema[name]
        if bits > 8 * c.n_bytes:
            raise ValueError(f"{name} has {c.n_bytes} bytes")
        return FlagTable(self.df, Schema(tuple(ColumnInfo(k.name, k.kind, bits) if k.name == name else k for k in self.schema.columns)))

    def compact(self) -> DataFrame:
        """The columns of the active rows."""
        return self.df.where(ACTIVE).select(*self.schema.names)

    def padded(self) -> DataFrame:
        """The columns of all rows and the flag as 0 or 1."""
        return self.df.select(*self.schema.names, F.col(ACTIVE).cast("int").alias(ACTIVE))

    def zip_columns(self, name: str = "row") -> DataFrame:
        """All columns in one struct."""
        return self.df.select(F.struct(*self.schema.names).alias(name), ROW_ID, ACTIVE)

    def unzip_columns(self, zipped: DataFrame, name: str = "row") -> FlagTable:
        return self.with_df(zipped.select(f"{name}.*", ROW_ID, ACTIVE))

    def equals(self, other: FlagTable) -> bool:
        """Same column names and widths and same rows in order; flags aren't compared."""
        mine, theirs = ([(c.name, c.bits) for c in t.schema.columns] for t in (self, other))
        if mine != theirs:
            return False
        cols = [*self.schema.names, ROW_ID]
        a, b = self.df.select(*cols), other.df.select(*cols)
        return difference(a, b).isEmpty()

    def show(self, n: int = 20) -> None:
        """Row number, flag and columns of the first rows."""
        self.df.select(ROW_ID, F.col(ACTIVE).cast("int"), *self.schema.names).orderBy(ROW_ID).show(n, truncate=False)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    count = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return count.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
