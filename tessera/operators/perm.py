"""Permutations as DataFrames (i, pi) of longs from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.order import positions


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("pi"))


def random(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A permutation that the seed decides: the order of hashed indices."""
    rows = spark.range(n).withColumn("h", F.xxhash64("id", F.lit(seed)))
    return positions(rows, ["h", "id"], "i").select("i", F.col("id").alias("pi"))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """result[i] = b[a[i]]."""
    return a.select("i", F.col("pi").alias("__m")).join(b.select(F.col("i").alias("__m"), "pi"), "__m").select("i", "pi")


def inverse(p: DataFrame) -> DataFrame:
    return p.select(F.col("pi").alias("i"), F.col("i").alias("pi"))


def apply(p: DataFrame, data: DataFrame, index: str = "i", inverted: bool = False) -> DataFrame:
    """dst[i] = src[pi[i]], or dst[pi[i]] = src[i] if inverted; data has its place in ``index``."""
    source, target = ("i", "pi") if inverted else ("pi", "i")
    moves = p.select(F.col(source).alias(index), F.col(target).alias("__to"))
    return data.join(moves, index).drop(index).withColumnRenamed("__to", index).select(*data.columns)


def is_permutation(p: DataFrame) -> bool:
    """Both columns hold 0 to n - 1, each once."""
    n = p.count()
    for c in ("i", "pi"):
        if n and (tuple(p.agg(F.min(c), F.max(c)).first()) != (0, n - 1) or not p.groupBy(c).count().where("count > 1").isEmpty()):
            return False
    return True


def shared_is_permutation(first: DataFrame, second: DataFrame) -> bool:
    """Whether two shares (i, pi) of which the exclusive or is meant do stand for a permutation."""
    return is_permutation(reveal(first, second))


def reveal(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, pi) that two shares stand for; pi is null where one of them has no such place."""
    both = first.join(second.withColumnRenamed("pi", "__other"), "i", "full")
    return both.select("i", F.col("pi").bitwiseXOR(F.col("__other")).alias("pi"))


def split(p: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two shares (i, pi) whose exclusive or is the permutation; the mask is a hash of seed and place."""
    mask = F.xxhash64(F.lit(seed), "i")
    return p.select("i", mask.alias("pi")), p.select("i", F.col("pi").bitwiseXOR(mask).alias("pi"))


def apply_shared(first: DataFrame, second: DataFrame, data: DataFrame, index: str = "i", inverted: bool = False) -> DataFrame:
    """A permutation held as two, second after first, applied in turn (in reverse if inverted)."""
    order = (second, first) if inverted else (first, second)
    out = data
    for p in order:
        out = apply(p, out, index, inverted)
    return out
