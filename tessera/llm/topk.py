"""Exact top-k search by MaxScore over a sharded index of integer vectors.

A query's terms are the dimensions of its vector. A shard of the index holds one posting array for each
dimension and the least and greatest value in it, so that a query knows the most that each term can add to
any score in the shard. Terms are ordered by how far their bounds reach apart. The *non-essential* terms are the longest tail whose
bounds together stay below the current k-th best score: a row that gets nothing from the other terms can't enter
on them alone. The postings of the essential terms are traversed for all rows; the others are probed, group
by group, only for rows whose partial score plus the bounds still outstanding reaches the k-th best.
Shards are searched in batches of rows under a rising k-th best score, and their k best are merged by score, ties to
the smaller id; rows that tie with the k-th best stay competitive, so results are exact.

Queries are searched in groups of about ``QUERY_BLOCK``, each broadcast to all shards; a group is bounded
whatever the data, goes over the whole index, and is written before the next begins, so neither plan nor driver grows with the number of groups.

Defined cases: vectors that are null or hold a null or non-finite component, and null ids, take no part;
shorter vectors are filled up with zeros; a repeated row is a candidate each time; a query's own id is no
candidate; a query id with several different vectors is one query, with the k best scores of them all; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _arrays as A
from tessera.llm._store import checkpoint, drop

K, SCALE, QUERY_EVERY = 10, 1024, 100
QUERY_BLOCK, SHARD_ROWS, BATCH_ROWS, PROBE = 4096, 16384, 4096, 8


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the components times ``scale``, rounded down, of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def competitive(postings: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose score is at least ``threshold``, and their scores.

    postings: values by dimension (rows of the array) and row of the batch; low, high: bounds of each dimension.
    """
    most, least = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
    order = np.argsort(least - most, kind="stable")
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # what terms from a place on can add
    essential = max(PROBE, int(np.argmax(rest < threshold))) if rest[-1] < threshold else len(order)
    terms = order[:essential]
    score = query[terms] @ postings[terms]
    rows = np.flatnonzero(score + rest[essential] >= threshold)
    score = score[rows]
    for at in range(essential, len(order), PROBE):
        if not len(rows):
            break
        terms = order[at : at + PROBE]
        score = score + query[terms] @ postings[np.ix_(terms, rows)]
        stay = score + rest[min(at + PROBE, len(order))] >= threshold
        rows, score = rows[stay], score[stay]
    return rows, score


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0))] * n

    def threshold(self, q: int) -> float:
        ids, scores = self.found[q]
        return scores[-1] if len(ids) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[q][0], ids]), np.concatenate([self.found[q][1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = ids[order], scores[order]


def _searched(shared, dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = Best(len(ids), k)
        top = float(np.abs(queries).max(initial=1))
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = _matrix(part.column(1), dims)
                exact = top * float(np.abs(x).max(initial=1)) * max(dims, 1) < 2**53
                postings = np.ascontiguousarray(x.T.astype(np.float64) if exact else x.T)
                low, high = postings.min(1), postings.max(1)
                for q in range(len(ids)):
                    query = queries[q].astype(postings.dtype)
                    rows, score = competitive(postings, low, high, query, best.threshold(q))
                    other = own[rows] != ids[q]
                    if other.any():
                        best.add(q, own[rows[other]], score[other])
        n = [len(found[0]) for found in best.found]
        if sum(n):
            yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([f[0] for f in best.found])), pa.array(np.concatenate([f[1] for f in best.found]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each of ``queries`` (both: vec_id, v)."""
    spark = vectors.sparkSession
    A.tune(spark)
    stats = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    n, dims = stats[0], max(stats[1] or 0, 1)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    index = checkpoint(vectors.repartition(max(1, -(-n // SHARD_ROWS))), "index")
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).distinct().toArrow()
        ids = rows["vec_id"].to_numpy().astype(np.int64)
        shared = spark.sparkContext.broadcast((ids, _matrix(rows["v"], max(dims, 1))[:, :dims] if len(ids) else np.zeros((0, dims), np.int64)))
        part = checkpoint(index.mapInArrow(_searched(shared, dims, k), "query_id long, vec_id long, score long"), "best")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    drop(index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = f"""WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
