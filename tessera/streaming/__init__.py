"""The same operators on unbounded tables: filters and joins to a static table row by row, group sums as running updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_where(stream: DataFrame, pred: Column, compact: bool = True) -> DataFrame:
    holds = F.coalesce(pred, F.lit(False))
    return stream.where(holds) if compact else stream.withColumn("is_active", holds)


def stream_join(stream: DataFrame, static: DataFrame, key: str, static_key: str, compact: bool = True) -> DataFrame:
    """Stream rows (the right side) with their match in a static table that is unique in its key."""
    rows = static.withColumnRenamed(static_key, "__k").withColumn("__hit", F.lit(True))
    joined = stream.join(rows, F.col(key) == F.col("__k"), "inner" if compact else "left")
    flag = F.coalesce("__hit", F.lit(False))
    return joined.withColumn("is_active", flag).drop("__k", "__hit")


def stream_group_sum(stream: DataFrame, key: str, sums: list[str], count: str = "Count") -> DataFrame:
    """Running sums and counts; write with output mode update or complete."""
    return stream.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias(count))


def stream_window_sum(stream: DataFrame, time: str, length: str, late: str, key: str, value: str) -> DataFrame:
    """Sums by key and time window; rows later than the watermark are dropped and closed windows leave the state."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, length), key).agg(F.sum(value).alias(value), F.count("*").alias("Count"))


def to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of what is there now, into a Parquet table that executors write.

    complete: each batch writes the whole result anew, so the table is that of the last one.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    out = f"{path}/rows"
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream to the end of what is there now, into a table in memory (for tests)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    return query
