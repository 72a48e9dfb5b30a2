"""The catalogue of registered queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warrantlake.plans import catalogue


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.QUERIES["ag07_metric_row"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in catalogue.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in catalogue.QUERIES.items() if sql}
