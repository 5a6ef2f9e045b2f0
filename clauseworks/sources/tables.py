"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; a file or a folder of files, columns pruned by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")
