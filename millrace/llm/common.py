"""What the operators share: tables between their steps, fold numbers, names and Arrow text access."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, shared_folder

#: Bytes of text that one step of a Python task works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


#: While a table is written: shuffles are deleted with the job that made them, and Arrow batches are cut by bytes, since 10,000 documents may be large.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Folders of the tables that the operator at work has written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Folder of the table written last.
_last: ContextVar[str | None] = ContextVar("last", default=None)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(frame: DataFrame) -> DataFrame:
    """The frame itself; from here on its session cuts Arrow batches by bytes."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"])
    return frame


def materialize(frame: DataFrame) -> DataFrame:
    """The rows of a frame, written to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    path = shared_folder(frame.sparkSession)
    if _written.get() is not None:
        _written.get().append(path)
    _last.set(path)
    with settings(frame.sparkSession, SETTINGS):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written too, after which the tables between its steps are deleted."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        own: list[str] = []
        outer = _written.set(own)
        try:
            with settings(docs.sparkSession, SETTINGS):
                out = operator(docs, *args, **kwargs)
                _written.reset(outer)
                outer = None
                return materialize(out)
        finally:
            if outer is not None:
                _written.reset(outer)
            delete(docs.sparkSession, own)

    return run


def written(stage: Callable[..., DataFrame], spark: SparkSession, docs: DataFrame, *args) -> DataFrame:
    """The written result of a stage over docs; all tables that the stage wrote on its way are deleted, and docs too if a stage has written it."""
    own: list[str] = []
    outer = _written.set(own)
    try:
        out = stage(spark, docs, *args)
        _written.reset(outer)
        outer = None
        out = materialize(out)
        out._millrace_folder = _last.get()
        own.extend(filter(None, [getattr(docs, "_millrace_folder", None)]))
        return out
    finally:
        if outer is not None:
            _written.reset(outer)
        delete(spark, own)


def fresh(frame: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def text_column(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, a null text as empty."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column without nulls, and len+1 offsets, without copying."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into row ranges with about ``limit`` bytes in the column ``text``; no row is cut."""
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
