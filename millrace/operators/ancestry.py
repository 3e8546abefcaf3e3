"""The nearest ancestor that a table of folders holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A folder above very many starts is met in so many tasks.
SALTS = 16
_HEAD = "^((?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?)"


def ancestors(path: Column) -> Column:
    """The folders from the top down to the path itself; doubled slashes and single dots count for nothing, a scheme and host stay in front."""
    head = F.regexp_extract(path, _HEAD, 1)
    parts = F.filter(F.split(F.regexp_replace(path, _HEAD, ""), "/"), lambda x: (x != "") & (x != "."))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(head, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def plain_path(path: Column) -> Column:
    """The path as ``ancestors`` writes it."""
    return F.element_at(ancestors(path), -1)


def nearest_roots(starts: DataFrame, roots: DataFrame) -> DataFrame:
    """(start, root) for each distinct start of starts (start): the deepest root of roots (root) at or above it, null if there is none.

    Every start meets its ancestors by equality. A folder at the top is an
    ancestor of all starts, so folders are dealt out by the start's hash, and
    roots are repeated for each share; most starts leave the join with few rows.
    Both joins are by sorting: paths pack so well in files that the engine takes
    millions of them for few enough to send whole through the driver.
    A null start has no root; null and repeated roots change nothing.
    """
    start = starts.select("start").distinct()
    share = F.pmod(F.xxhash64("start"), F.lit(SALTS)).cast("int")
    up = start.where("start is not null").select("start", share.alias("share"), F.posexplode(ancestors(F.col("start"))).alias("depth", "root"))
    held = roots.where("root is not null").select(plain_path(F.col("root")).alias("root")).distinct()
    held = held.select("root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    deepest = up.join(held.hint("merge"), ["root", "share"]).groupBy("start").agg(F.max_by("root", "depth").alias("root"))
    return start.join(deepest.hint("merge"), "start", "left")
