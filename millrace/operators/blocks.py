"""First block of key/value lines in a text.

The whole rule runs inside a row with array expressions: no explode, no window,
no shuffle, so a billion files need as many map tasks and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_key, default_if_empty, split_lines, strip_space


def first_block(lines: Column, openers: tuple[str, ...]) -> Column:
    """Lines from the first one that starts with an opener up to, but without, the second such line.

    No opener gives an empty array.
    """
    opens = lambda x: F.exists(F.array(*map(F.lit, openers)), lambda o: x.startswith(o))
    at = F.filter(F.transform(lines, lambda x, i: F.when(opens(x), i + 1).otherwise(0)), lambda i: i > 0)
    start = F.get(at, F.lit(0))
    end = F.coalesce(F.get(at, F.lit(1)), F.size(lines) + 1)
    return F.when(start.isNull(), F.slice(lines, 1, 0)).otherwise(F.slice(lines, start, end - start))


def last_value(block: Column, key: str) -> Column:
    """Value of the last line of a block that starts with ``key:``; null if there is none."""
    hits = F.filter(block, lambda x: x.startswith(f"{key}:"))
    return after_key(F.try_element_at(hits, F.lit(-1)), key)


def identity(files: DataFrame, version: str, default_nick: str) -> DataFrame:
    """(root, nick, version, backend, model) of files (root, text).

    A null text stands for a missing file: it gets the default nick and two
    ``unknown``. A block without value for a key gets ``unknown`` there.
    """
    blocks = files.select("root", F.transform(split_lines(F.col("text")), strip_space).alias("lines")).select(
        "root", first_block(F.col("lines"), ("suffix:", "- suffix:")).alias("block")
    )
    return blocks.select(
        "root",
        default_if_empty(after_key(F.get("block", F.lit(0)), "suffix"), default_nick).alias("nick"),
        F.lit(version).alias("version"),
        default_if_empty(last_value(F.col("block"), "backend"), "unknown").alias("backend"),
        default_if_empty(last_value(F.col("block"), "model"), "unknown").alias("model"),
    )
