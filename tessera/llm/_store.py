"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a file, where a table's rows are known about.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on one machine (tests), a new temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scope(spark: SparkSession):
    """Tables that are written inside are deleted at the end, but for those that ``keep`` (yielded) was called with."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folder(f) for f in df.inputFiles())
        return df

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in made:
            if _folder(f"{path}/x") not in kept:
                _delete(spark, path)


def _folder(file: str) -> str:
    """The table's own name: its files' paths differ by scheme and slashes from the path it was written to."""
    return file.rsplit("/", 2)[1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_lock, _writing = Lock(), {"now": 0, "before": "false"}


@contextmanager
def _cleaning(spark: SparkSession):
    """Sets CLEANUP while tables are written; of writes at the same time the last to end restores it."""
    with _lock:
        if not _writing["now"]:
            _writing["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["now"] -= 1
            if not _writing["now"]:
                spark.conf.set(CLEANUP, _writing["before"])


def checkpoint(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it: it cuts lineage and outlives lost executors.

    rows: about how many it has at most. Then its files follow from that, not from the partitions that the plan ends in: on a local
    folder each file costs an executor several processes (chmod), and each of them shares the pages of the JVM until it runs.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(n_parts(rows, FILE_ROWS, 2 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    with _cleaning(spark):  # the shuffle files of the plan aren't needed once its rows are written
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a checkpointed table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in path:
            _delete(df.sparkSession, path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def n_parts(amount: float, each: float, least: int = 1) -> int:
    return max(least, int(-(-amount // each)))
