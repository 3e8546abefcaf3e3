"""Results and errors written by one job, to two places that appear together or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS, ERRORS = "results", "errors"
_KEY, _RESULT, _ERROR = "sink", "result", "error"


def write_split(frame: DataFrame, error: Column, result: Column, folder: str) -> None:
    """Write each row of a frame to one of two sinks below a new folder, in one pass.

    Rows where the struct ``error`` is null give the struct ``result`` to the
    sink of results, all others their error to the sink of errors. Tasks write to
    a draft beside the folder; once all rows are written it takes the folder's
    name by one rename. A job that fails leaves neither sink, nor the draft; a
    folder that exists is an error, before and after the job. The rename is one
    step in HDFS and local folders; a store that copies on rename shows a folder
    half full for a while.
    """
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, draft = path(folder), path(f"{folder.rstrip('/')}.{uuid.uuid4().hex}.draft")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(folder)
    rows = frame.select(error.alias(_ERROR), result.alias(_RESULT))
    failed = F.col(_ERROR).isNotNull()
    rows = rows.select(F.when(failed, ERRORS).otherwise(RESULTS).alias(_KEY), F.when(failed, F.col(_ERROR)).alias(_ERROR), F.when(~failed, F.col(_RESULT)).alias(_RESULT))
    try:
        rows.write.partitionBy(_KEY).parquet(draft.toString())
        if fs.exists(final) or not fs.rename(draft, final):
            raise FileExistsError(folder)
    finally:
        fs.delete(draft, True)


def read_sink(spark: SparkSession, folder: str, which: str, schema: str) -> DataFrame:
    """Rows of one sink, results or errors, with the columns of a schema in DDL; only that sink's files are read."""
    column = {RESULTS: _RESULT, ERRORS: _ERROR}[which]
    rows = spark.read.schema(f"{column} struct<{schema}>, {_KEY} string").parquet(folder)
    return rows.where(F.col(_KEY) == which).select(f"{column}.*")
