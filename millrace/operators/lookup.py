"""Lookups in small dimensions and in the topic catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

ERROR = "struct<code:int,message:string,remediation:string>"
HINT = "run 'millrace explain' for the start page"


class TopicNotFound(LookupError):
    """No entry for a topic path."""


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed dimension, null if missing; exact and case-sensitive. The dimension is a literal of the plan."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def lookup_default(table: dict[str, str], key: Column, default: str) -> Column:
    """As ``lookup``, with a default."""
    return F.coalesce(lookup(table, key), F.lit(default))


def topic(topics: DataFrame, path: list[str]) -> DataFrame:
    """The row of topics (path array<string>, …) with this path; no row if there is none, and no job before one is asked for."""
    want = F.array(*map(F.lit, path)) if path else F.expr("cast(array() as array<string>)")
    return topics.where(F.col("path") == want).limit(1)


def resolve(topics: DataFrame, path: list[str]) -> Row:
    """As ``topic``, read in one job; TopicNotFound if there is no such row."""
    row = topic(topics, path).first()
    if row is None:
        raise TopicNotFound(missing(path))
    return row


def missing(path: list[str]) -> str:
    return f"no explain entry for: {' '.join(path) or '<root>'}"


def known_paths(topics: DataFrame) -> DataFrame:
    """(ord, path) of topics (ord, path, …), in the order in which they are listed."""
    return topics.select("ord", "path").orderBy("ord")


def answered(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """requests (path array<string>, …) with ``found``, a struct of the topic's other columns, and ``error``.

    One of the two is null: a request without an entry, a null one too, gets an
    error record with code, message and remediation. Every request is answered,
    repeated ones each. Paths of topics are unique, and their number is that of
    pages, so the engine sends the catalogue to the requests as long as its size
    allows, and joins by path beyond that. Nothing runs before rows are asked for.
    """
    pages = topics.select(F.col("path").alias("_page"), F.struct(*[c for c in topics.columns if c != "path"]).alias("found"))
    said = F.concat(F.lit("no explain entry for: "), F.coalesce(F.nullif(F.array_join("path", " "), F.lit("")), F.lit("<root>")))
    error = F.when(F.col("_page").isNull(), F.struct(F.lit(1).alias("code"), said.alias("message"), F.lit(HINT).alias("remediation")).cast(ERROR))
    return requests.join(pages, F.col("path") == F.col("_page"), "left").withColumn("error", error).drop("_page")
