"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder with one Parquet file or folder for each table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
