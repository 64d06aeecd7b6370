"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import (
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    sharding,
    token_store,
    url_filters,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_language_id": language_id.op2_language_id,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op10_mixing": mixing.op10_mixing,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_url_filters": url_filters.op6_url_filters,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_sharding": sharding.op8_sharding,
        "op9_quality_rules": quality_rules.op9_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_join": ngram_join.OP4_SQL,
        "op8_sharding": sharding.OP8_SQL,
        "op6_url_filters": url_filters.OP6_SQL,
        "op9_quality_rules": quality_rules.OP9_SQL,
    }
