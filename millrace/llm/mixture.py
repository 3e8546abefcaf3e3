"""Sources mixed to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal size. The golden ratio's multiples, taken
modulo one, are mapped through the cumulative targets to a source for each slot,
so every stretch of the mix is near the weights. The k-th slot of a source takes
its k-th block: the documents of a source, shuffled by a digest, lie end to end
and are cut into blocks of equal words; after the last block the next pass over
the source begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, tidy

WORD = "[^\\x20\\x09-\\x0D]+"
#: Slots of a mix, at most; a block has as many words as that takes, at least one.
SLOTS = 1 << 18
#: 2^32 divided by the golden ratio, the nearest odd number: fixed value.
GOLDEN = 2654435769
#: Points and cumulative targets are whole numbers below this.
UNIT = 1 << 32
#: Cells in which points meet the sources whose stretch of the unit covers them.
CELLS = 1 << 10
#: Rows of one source that are put in order together, on average.
GROUP_ROWS = 10_000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, key): words of each text, and the digest by which a source is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, number, source_size, n_docs, target, low, high) of each source in sizes (source, size).

    Weights are dealt out in the order of code points, nulls last, again and
    again. All words are shared by weight, up to ``most`` times a source's own; the
    level of water that fills these vessels is the greatest of the levels found
    when the fullest are closed one after another. low and high bound a source's
    stretch of UNIT. One row for each source, which one task puts in order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name, everything = W.orderBy(F.asc_nulls_last("source")), W.partitionBy(F.lit(0))
    per = per.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1).cast("long"))
    closed = everything.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(closed), F.lit(0))
    per = per.withColumn("level", left.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(closed), F.lit(0))))
    per = per.withColumn("target", F.least(F.max("level").over(everything) * F.col("weight"), (most * F.col("source_size")).cast("double")))
    per = per.withColumn("high", F.when(F.sum("source_size").over(everything) > 0, F.round(F.sum("target").over(everything.orderBy("number")) / F.sum("source_size").over(everything) * UNIT).cast("long")).otherwise(0))
    return per.select("source", "number", "source_size", "n_docs", "target", F.lag("high", 1, 0).over(everything.orderBy("number")).alias("low"), "high")


def schedule(per: DataFrame, total: int, most: int, slots: int) -> DataFrame:
    """(slot, number, pass, block): the block of a source that each slot takes; a slot beyond the last pass stays empty and is left out."""
    block = block_words(total, slots)
    span = UNIT // CELLS
    stretches = per.where("high > low").select("number", "source_size", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / span), F.floor((F.col("high") - 1) / span))).alias("cell"))
    points = per.sparkSession.range(-(-total // block)).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % UNIT).alias("point")).withColumn("cell", F.floor(F.col("point") / span))
    named = points.join(stretches, "cell").where("point >= low and point < high")
    rank = F.row_number().over(W.partitionBy("number").orderBy("slot")) - 1  # at most SLOTS rows in all
    blocks = F.ceil(F.col("source_size") / block)
    return named.withColumn("rank", rank).select("slot", "number", F.floor(F.col("rank") / blocks).alias("pass"), (F.col("rank") % blocks).alias("block")).where(F.col("pass") < most)


def block_words(total: int, slots: int) -> int:
    """Words of a block, so that no more than ``slots`` of them hold all words."""
    return max(1, -(-total // slots))


def laid_out(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, key) with the source's columns and ``start``, the words of the source before each row.

    A source is put in order in groups of about GROUP_ROWS rows by digest, so a
    source with most of the rows is as many groups as that takes.
    """
    known = rows.join(per, rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    groups = F.floor(F.col("n_docs") / GROUP_ROWS) + 1
    known = known.withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * groups, 32))
    sums = known.groupBy("number", "part").agg(F.sum("size").alias("inside"))
    ahead = W.partitionBy("number").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("number", "part", F.coalesce(F.sum("inside").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("number", "part").orderBy("key", F.asc_nulls_last("doc_id")).rowsBetween(W.unboundedPreceding, -1)
    return known.join(sums, ["number", "part"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))


def _prepared(docs: DataFrame, weights: Sequence[int], most: int, slots: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(placed rows, schedule, words of a block)."""
    rows = materialize(sized(docs, seed))
    per = materialize(targets(rows, weights, most))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    return laid_out(rows, per), schedule(per, total, most, slots), block_words(total, slots)


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """Each row of placed once for each block that it reaches into, with first (word of the text) and n_words there."""
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    return cut.withColumn("n_words", high - low).withColumn("first", low - F.col("start"))


@tidy
def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, slots: int = SLOTS, seed: int = 2024) -> DataFrame:
    """The mix itself: (slot, place, doc_id, source, pass, first, n_words), the words of texts that fill each slot.

    place orders the pieces of a slot. Edge cases are those of ``mixture``.
    """
    placed, slotted, block = _prepared(docs, weights, most, slots, seed)
    pieces = _pieces(placed, block).join(slotted, ["number", "block"])
    place = (F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block).alias("place")
    return pieces.select("slot", place, "doc_id", "source", "pass", "first", "n_words")


@tidy
def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, slots: int = SLOTS, seed: int = 2024) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs (doc_id, text, source, …).

    size counts the words of the text, taken those that the mix takes, again for
    every pass; no row is taken more than ``most`` times. A source's taken words
    are within a few slots of its target, and a slot is 1 / ``slots`` of the mix.

    Null and empty texts have no words and are taken 0 times. Null sources are one
    source, the last. Null ids and repeated rows are rows like any other; equal
    rows are taken in any order. A long text reaches into as many blocks as it
    fills. Other columns are not read. An empty table gives no rows.
    """
    placed, slotted, block = _prepared(docs, weights, most, slots, seed)
    placed = materialize(placed)
    taken = slotted.groupBy("number", "block").agg(F.count("*").alias("times"))
    counted = _pieces(placed, block).join(taken, ["number", "block"], "left").groupBy("number", "start").agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = placed.where("size > 0").join(counted, ["number", "start"]).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
