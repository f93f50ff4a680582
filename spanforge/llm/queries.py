"""Queries and SQL of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, line_dedup, mixing, near_dup, pii, quality, secrets, token_counts, token_store, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(table_name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, table_name))


def queries() -> dict[str, Query]:
    return {
        "op1_near_dup": _over("documents", near_dup.op1_query),
        "op2_pii": _over("documents", pii.op2_query),
        "op3_secrets": _over("documents", secrets.op3_query),
        "op4_line_dedup": _over("documents", line_dedup.op4_query),
        "op5_token_counts": _over("documents", token_counts.op5_query),
        "op6_url_filter": lambda spark, sf_dir: url_filter.op6_query(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
        "op7_quality": _over("documents", quality.op7_query),
        "op8_decontamination": lambda spark, sf_dir: decontam.op8_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op9_mixing": _over("documents", mixing.op9_query),
        "op10_token_files": _over("documents", token_store.op10_query),
    }


def oracle_sql() -> dict[str, str]:
    """The rest is not expressible in SQL and tested against plain Python versions."""
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op6_url_filter": url_filter.OP6_SQL, "op8_decontamination": decontam.OP8_SQL, "op9_mixing": mixing.OP9_SQL}
