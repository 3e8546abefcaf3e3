"""New identity files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.introspection import whoami


def watch_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming ``whoami`` rows of files that arrive in a folder; stateless, so no watermark is needed."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return whoami(files.select(F.col("_metadata.file_path").alias("root"), F.col("value").alias("text")))
