"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: slot
``(offset + j * skip) mod size`` is its j-th choice, with offset and skip taken from its name. Shards
take turns; on its turn a shard claims the first slot of its order that is still free (a shard of weight
w has w turns a round). The filled table is a fixed function of names, weights and size: it has
``size`` entries whatever the data, so it is broadcast, and a row finds its shard by one lookup. When a
shard joins or leaves, few slots change owner beyond those it gains or loses.

Defined cases: equal keys (repeated rows) share a slot; a null key hashes as the text ``<null>``; only a key, never a text, is hashed, of
whatever length; an empty table gives an empty result; other columns pass through, and columns already called ``slot`` or
``shard`` are replaced (the key too, after it was hashed, if it has that name).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters of the registered query. The size is prime and over 100 times the shards.
N_SHARDS, TABLE_SIZE = 256, 65537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """The owner (index into ``shards``) of every slot."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards need distinct names and positive weights")
    if not is_prime(size) or size < sum(weights):
        raise ValueError("the table size must be a prime not under the sum of weights")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for i, w in enumerate(weights):
            for _ in range(w):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as rows (slot, shard); one row for each entry of a literal, made by Spark alone."""
    literal = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(literal).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("<null>")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle: the table of ``size`` rows is broadcast."""
    table = table_frame(df.sparkSession, fill_table(shards, size, weights))
    rows = df.withColumn("slot", slot_of(df[key], size)).drop("shard")
    return rows.join(F.broadcast(table), "slot")


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def oracle() -> str:
    """The same placement in DuckDB; the filled table is a parameter of the query, as in Spark."""
    owners = ",".join(map(str, fill_table(shard_names())))
    return f"""WITH t AS (SELECT [{owners}] AS owners),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '<null>')), 1, 15)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM d, t"""
