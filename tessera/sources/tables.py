"""Parquet tables: the native source and sink, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.schema import Schema
from tessera.plans.table import ACTIVE, ROW_ID, FlagTable


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine, a temporary folder becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_shared(df: DataFrame) -> DataFrame:
    """The same rows, written and reread: their lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(table: FlagTable, path: str) -> None:
    """Row ids and flags travel as columns, widths and kinds in the fields' metadata."""
    df = table.df
    for c in table.schema.columns:
        df = df.withMetadata(c.name, {"kind": c.kind.name, "bits": c.bits})
    df.write.parquet(path)


def load(spark: SparkSession, path: str) -> FlagTable:
    df = spark.read.parquet(path)
    return FlagTable(df, Schema.from_struct(df.schema, (ROW_ID, ACTIVE)))
