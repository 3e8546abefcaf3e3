"""Source trees: one identity file for each root."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ancestry import ancestors, nearest_roots
from .files import probe


def nearest_root(start: str, name: str) -> str | None:
    """Nearest folder at or above ``start`` that holds a regular file ``name``; None if there is none."""
    at = Path(start).resolve()
    return next((str(p) for p in (at, *at.parents) if (p / name).is_file()), None)


def locate(starts: DataFrame, name: str) -> DataFrame:
    """(start, root) for each distinct start of starts (start): the nearest folder at or above it with a regular file ``name``, null if there is none.

    Every folder on the way is looked at once, whatever the number of starts below it.
    """
    folders = starts.select(F.explode(ancestors(F.col("start"))).alias("root")).distinct()
    held = probe(folders.withColumn("path", F.lit(name))).where("found").select("root")
    return nearest_roots(starts, held)


def read_identity_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(root, text) of the files that path patterns match: each file is one row, read whole; bytes that are not UTF-8 are an error.

    Patterns are those of Spark's readers; ``scan`` takes places literally and goes on past what it can't read.
    """
    return spark.read.format("binaryFile").load(paths).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("root"), F.validate_utf8(F.col("content").cast("string")).alias("text")
    )
