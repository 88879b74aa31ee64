"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosaic.llm import best_fit_packing, decontaminate, exact_dedup, histogram_shard, jaccard_join, language_id, license_scan, quality, secret_scan, token_count


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_best_fit_packing": best_fit_packing.op2_best_fit_packing,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_token_counts": token_count.op7_token_counts,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_language_id": language_id.op9_language_id,
        "op10_histogram_sharding": histogram_shard.op10_histogram_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op5_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
        "op6_license_scan": license_scan.oracle_sql(),
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    }
