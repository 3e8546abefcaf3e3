"""Folds over rows, each with the value that no rows give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(passed: Column) -> Column:
    """Whether all rows pass; true for none. Null does not count."""
    return F.coalesce(F.bool_and(passed), F.lit(True))


def some(passed: Column) -> Column:
    """Whether any row passes; false for none."""
    return F.coalesce(F.bool_or(passed), F.lit(False))


def first_by(order: list[str], *columns: str) -> Column:
    """A struct of the columns of the first row in this order; one row for each group and task is shuffled."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def last_by(order: list[str], *columns: str) -> Column:
    """A struct of the columns of the last row in this order."""
    return F.max_by(F.struct(*columns), F.struct(*order))


def sorted_join(values: Column, separator: str = ", ") -> Column:
    """The values of a group in order, joined; for groups that fit a row, as keys of a dimension do."""
    return F.array_join(F.array_sort(F.collect_list(values)), separator)


def appended(*frames: DataFrame) -> DataFrame:
    """Rows of the frames with their place in the row of frames as ``ord``, from 1."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("ord"), *f.columns) for k, f in enumerate(frames, 1)])


def with_any(frame: DataFrame, found: DataFrame, on: Column) -> DataFrame:
    """Rows that have a match; a row's first match settles it."""
    return frame.join(found, on, "left_semi")
