"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers. The product of an anchor with very many rows is taken
one bit-plane of the rows' components at a time, the most significant first.
After each plane the planes that are left bound every score from both sides;
pairs whose bounds can't reach what the anchor still needs are dropped, and once
few are left only those go on.

Anchors are a stated part of the rows and are searched against all rows in
blocks: a block of anchors of bounded size is broadcast, all rows pass by in
batches, and each task hands on no more than its best few for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, tidy

#: Components times 256 are cut to this many on either side, so that products of 2,048 components fit 64 bits.
MOST = 1 << 26
#: Rows and anchors whose scores are held at once.
ROWS, ANCHORS = 1024, 1024
#: Anchors are broadcast in blocks of so many at most, and of so many components.
BLOCK_ANCHORS, BLOCK_COMPONENTS = 1 << 15, 1 << 22
#: Go on with single pairs once fewer than one in so many is left.
SPARSE = 32
#: Stands for a null id, which comes last.
NO_ID = np.iinfo(np.int64).max
#: Below and above every score.
LOW, HIGH = -(1 << 62), 1 << 62


def whole(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, q): the rows that take part, with labels moved and whole components."""
    usable = "label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    q = F.transform("embedding", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x.cast("double"))) * 256))).cast("int"))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return rows.where(usable).select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), q.alias("q"))


def padded(q: pa.Array, width: int) -> np.ndarray:
    """Vectors of any length as one matrix of a given width; what is missing is 0, what is beyond is cut."""
    offsets = q.offsets.to_numpy()
    flat, sizes = q.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes)[at < width], at[at < width]] = flat[at < width]
    return out


class Planes:
    """Batches of rows against anchors (n x width), plane by plane."""

    def __init__(self, anchors: np.ndarray):
        self.anchors = anchors
        self.up, self.down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
        self.most = int(np.abs(anchors).max(initial=0))

    def pairs(self, q: np.ndarray, may: np.ndarray, least: np.ndarray, greatest: np.ndarray, group: slice, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of pairs allowed by ``may`` (rows x anchors of the group) whose score lies between the anchor's least and greatest.

        With ``keep``, an anchor's least rises to the keep-th greatest lower bound of the batch.
        """
        a = self.anchors[group]
        bits = int(max(q.max(initial=0), -q.min(initial=0) - 1)).bit_length()
        bound = q.shape[1] * (1 << bits) * max(1, self.most)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # exact in each case
        wide, up, down = a.T.astype(kind), self.up[group], self.down[group]
        plane = lambda j, r=slice(None): ((q[r] >> j) & 1).astype(kind)
        part = plane(bits) @ wide * kind(-(1 << bits))  # the sign's plane counts against the rest
        for j in range(bits - 1, -1, -1):
            part += plane(j) @ wide * kind(1 << j)
            rest = (1 << j) - 1
            if keep and len(q) > keep:
                low = np.where(may, part, kind(-(1 << 62) if kind == np.int64 else -np.inf)) + (rest * down).astype(kind)
                best = np.partition(low, len(q) - keep, axis=0)[len(q) - keep]
                least = np.maximum(least, np.where(np.isfinite(best.astype(np.float64)), np.maximum(best.astype(np.float64), -(2.0**62)), -(2.0**62)).astype(np.int64)) if kind != np.int64 else np.maximum(least, best)
            may = may & (part >= (least - rest * up).astype(kind)) & (part <= (greatest - rest * down).astype(kind))
            if j and np.count_nonzero(may) * SPARSE < may.size:
                break
        r, c = np.nonzero(may)
        score = part[r, c]
        for k in range(j - 1, -1, -1) if bits else ():
            score = score + np.einsum("ij,ij->i", plane(k, r), a[c].astype(kind)) * kind(1 << k)
            rest = (1 << k) - 1
            on = (score >= (least[c] - rest * up[c]).astype(kind)) & (score <= (greatest[c] - rest * down[c]).astype(kind))
            r, c, score = r[on], c[on], score[on]
        return r, c + group.start, score.astype(np.int64)


class Best:
    """The best few rows of each slot: greater scores first, smaller ids first among equals."""

    def __init__(self, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.slot = self.score = self.id = self.row = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        s, v, i, r = (np.concatenate(p) for p in zip((self.slot, self.score, self.id, self.row), (slot, score, id, row)))
        order = np.lexsort((r, i, -v, s))
        s = s[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        on = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)])) < self.keep
        order = order[on]
        self.slot, self.score, self.id, self.row = s[on], v[order], i[order], r[order]

    def least(self, otherwise: np.ndarray) -> np.ndarray:
        """Score of the last row of each full slot, or ``otherwise``."""
        out = otherwise.copy()
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.slots) == self.keep)
        last = np.searchsorted(self.slot, full, "right") - 1
        out[full] = np.maximum(out[full], self.score[last])
        return out


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(q, row, id, label) of at most ROWS rows at a time; a null id is NO_ID, which comes last."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            b = batch.slice(low, ROWS)
            yield padded(b["q"], width), b["row"].to_numpy(), b["vec_id"].fill_null(NO_ID).to_numpy(), b["label"].to_numpy()


def _positives(block, n: int):
    """Best n rows of the label of each anchor of a broadcast block, other than the anchor."""

    def run(batches):
        q, rows, _, labels = block.value
        best = Best(len(q), n)
        for values, row, id, label in _batches(batches, q.shape[1]):
            for one in np.unique(label):  # only rows and anchors of one label meet
                at, who = np.flatnonzero(label == one), np.flatnonzero(labels == one)
                if not len(who):
                    continue
                few = Planes(q[who])
                for low in range(0, len(who), ANCHORS):
                    group = slice(low, min(low + ANCHORS, len(who)))
                    mine = who[group]
                    least = best.least(np.full(len(q), LOW))[mine]
                    r, c, score = few.pairs(values[at], row[at][:, None] != rows[mine][None, :], least, np.full(len(mine), HIGH), group, n)
                    best.add(who[c], score, id[at][r], row[at][r])
        yield pa.RecordBatch.from_arrays([pa.array(rows[best.slot]), pa.array(best.score), pa.array(best.id), pa.array(best.row)], ["anchor", "score", "id", "row"])

    return run


def _negatives(block, n: int):
    """Best n rows of other labels between the bounds of each (anchor, positive) of a broadcast block."""

    def run(batches):
        (q, _, _, labels), (anchor, low_bound, high_bound) = block.value
        # slots are pairs of anchor and positive, in the order of their anchors
        planes, best = Planes(q), Best(len(anchor), n)
        starts = np.searchsorted(anchor, np.arange(len(q) + 1))
        some = np.flatnonzero(np.diff(starts))
        top = np.full(len(q), LOW)
        if len(some):
            top[some] = np.maximum.reduceat(high_bound, starts[some])
        for values, row, id, label in _batches(batches, q.shape[1]):
            for low in range(0, len(q), ANCHORS):
                group = slice(low, min(low + ANCHORS, len(q)))
                floor = best.least(low_bound)
                least = np.full(len(q), HIGH)
                if len(some):
                    least[some] = np.minimum.reduceat(floor, starts[some])
                r, c, score = planes.pairs(values, label[:, None] != labels[group][None, :], least[group], top[group], group)
                times = starts[c + 1] - starts[c]
                slot = np.repeat(starts[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                r, score = np.repeat(r, times), np.repeat(score, times)
                on = (score >= floor[slot]) & (score <= high_bound[slot])
                best.add(slot[on], score[on], id[r[on]], row[r[on]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id), pa.array(best.row)], ["slot", "score", "id", "row"])

    return run


def _top(found: DataFrame, key: str, n: int) -> DataFrame:
    """The n best of each key, with their rank; a key has n rows of each task at most."""
    order = W.partitionBy(key).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _anchor_blocks(spark: SparkSession, anchors: DataFrame, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(q, row, id, label) of the anchors, one bounded block after another."""
    size = max(1, min(BLOCK_ANCHORS, BLOCK_COMPONENTS // width))
    parts = -(-anchors.count() // size)
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    for k in range(parts):
        rows = pa.Table.from_batches(anchors.where(part == k).sort("row").toArrow().to_batches())  # about ``size`` anchors
        q = padded(rows["q"].combine_chunks(), width)
        yield q, rows["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_numpy()


@tidy
def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label, …).

    Rows with a null label or vector, or a null or non-finite component, take no
    part. Anchors have a vec_id divisible by ``every``; their positives are the
    ``positives`` best other rows of their label, and the negatives of each are the
    ``negatives`` best rows of other labels with low * positive <= 100 * negative
    <= high * positive. Greater scores come first, then smaller ids, null ids last.

    Repeated rows each take part, as anchors too. Vectors of different length
    meet as if the shorter one ended in zeros, and an empty vector scores 0. A
    component times 256 is cut to 2^26 on either side. Other columns are not
    read. Without anchors or rows there are no rows.
    """
    spark = rows.sparkSession
    # equal shares of rows for the tasks: as many as the session runs at once, and no more than 131,072 rows in one
    table = materialize(whole(rows))
    shares = max(spark.sparkContext.defaultParallelism, -(-table.count() // (1 << 17)))
    table = materialize(table.repartition(shares))
    anchors = materialize(table.where(F.col("vec_id") % every == 0))
    width = max(1, anchors.agg(F.max(F.size("q"))).first()[0] or 0)
    parts = []
    for q, row, id, label in _anchor_blocks(spark, anchors, width):
        block = spark.sparkContext.broadcast((q, row, id, label))
        best = materialize(_top(table.mapInArrow(_positives(block, positives), "anchor long, score long, id long, row long"), "anchor", positives))
        chosen = best.sort("anchor", "rank").toArrow()  # at most ``positives`` rows for each anchor of the block
        anchor, score = np.searchsorted(row, chosen["anchor"].to_numpy()), chosen["score"].to_numpy()
        bounds = (anchor, -(-low * score // 100), high * score // 100)
        pair = spark.sparkContext.broadcast(((q, row, id, label), bounds))
        found = _top(table.mapInArrow(_negatives(pair, negatives), "slot long, score long, id long, row long"), "slot", negatives)
        slots = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": id[anchor], "positive_id": chosen["id"], "positive_score": score}), "slot long, anchor_id long, positive_id long, positive_score long")
        done = found.join(slots, "slot").select("anchor_id", F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(NO_ID)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        parts.append(materialize(done))
        block.unpersist()
        pair.unpersist()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
