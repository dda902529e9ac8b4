"""Readers of the standard tables. Every path goes through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir` (a file or a folder of Parquet parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
