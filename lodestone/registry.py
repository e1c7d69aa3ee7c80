"""The engine's own queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import catalogue


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each benchmark passage by BM25."""
    return catalogue.bm25_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(catalogue.SQL)
