"""The queries of this subpackage, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, near_dedup, packing, pieces, quality, recompression, sharding, suffix_dedup, token_counts, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_pieces": pieces.op2_pieces,
        "op3_topk": topk.op3_topk,
        "op4_langid": langid.op4_langid,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_packing": packing.op6_packing,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_quality": quality.op9_quality,
        "op10_substring_dedup": recompression.op10_substring_dedup,
        "quality_base_counts": quality.quality_base_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": topk.ORACLE,
        "op5_suffix_dedup": suffix_dedup.ORACLE,
        "op7_near_dedup": near_dedup.ORACLE,
        "op8_sharding": sharding.oracle(),
        "op10_substring_dedup": recompression.ORACLE,
        "quality_base_counts": quality.BASE_SQL,
    }
