"""Repeated strings of 100 bytes, found by prefix-free parsing.

A trigger is a string of ``TRIGGER`` bytes whose rolling hash is the least among
those of some 100-byte string, so every 100-byte string holds one, and equal
strings hold the same one at the same place. Triggers cut each document into
phrases, which begin and end with one. A suffix is ordered by the rest of its
phrase, up to and with the trigger at its end, and then by what the parse goes on
with: suffixes meet under their trigger, first as whole contexts (everything that
a 100-byte string around this trigger can see), which stand for all suffixes of
the phrase at once. Where a trigger has several contexts, the suffixes of each
context's first occurrence meet in blocks under the core that a block's strings
share, and where one core has several blocks, one by one, 100 bytes deep. Equal
neighbours in that order are repeats, and all but the first in the corpus go.

Most triggers occur once and are dropped after one shuffle of a few numbers for
every 35 bytes of text. Equal contexts of one task are settled there, so copies
cost little, and triggers that are frequent in a sample of bounded size are dealt
out by context instead of by trigger, so a common line does not meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, steps, text_bytes, text_column, tidy
from .words import mix, prefix_hashes, range_hashes

LENGTH, TRIGGER = 100, 32
REACH = LENGTH - TRIGGER
#: Bits for a place in a step; a step is one document at least.
PLACE = 28
#: Documents of the sample, and the share of them from which a trigger counts as frequent; so at most a few thousand are.
SAMPLE, FREQUENT = 2000, 0.02
STEP = 1 << 20
BLOCK = 8
LOWEST = -(1 << 63)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each phrase: row, place of its trigger, first and last start of the strings that hold it as their least, trigger hash and context hash.

    Places count from the start of the row.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    if len(data) >> PLACE:
        raise ValueError(f"a text has more than {1 << PLACE} bytes")
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - TRIGGER + 1)
    grams = range_hashes(prefix, at, at + TRIGGER)
    low = np.uint64((1 << PLACE) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH + 1:
        least = np.minimum(least[: len(least) - (REACH + 1 - width)], least[REACH + 1 - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - LENGTH + 1))
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(np.maximum(0, np.diff(offsets) - LENGTH + 1))[:-1])), np.maximum(0, np.diff(offsets) - LENGTH + 1))
    if not len(start):
        return none, none, none, none, none, none
    trigger = (least[start] & low).astype(np.int64)
    new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    row, trigger, a, b = row[first], trigger[first], start[first], start[last]
    left, right = np.maximum(offsets[row], trigger - REACH), np.minimum(offsets[row + 1], trigger + LENGTH)
    context = mix(range_hashes(prefix, left, right) + (trigger - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = offsets[row]
    return row, trigger - base, a - base, b - base, grams[trigger].view(np.int64), context.view(np.int64)


def _packed(trigger: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number that sorts by trigger and keeps the starts, which lie at most REACH before it."""
    return (trigger << 14) | ((trigger - first) << 7) | (trigger - last)


def _settled(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True for rows that have the keys of an earlier row; order: sorts rows by place in the corpus."""
    at = np.lexsort((order, *keys))
    same = np.ones(len(at) - 1, bool) if len(at) else np.zeros(0, bool)
    for k in keys:
        same &= k[at[1:]] == k[at[:-1]]
    out = np.zeros(len(at), bool)
    out[at[1:]] = same
    return out


def _corpus_rank(batch: pa.RecordBatch) -> np.ndarray:
    """Rank of each row of a batch by document."""
    return np.argsort(np.lexsort((batch.column("dup").to_numpy(), batch.column("d").to_numpy())))


def _parse(frequent):
    def run(batches):
        """A row for each phrase, with what it is dealt out by: its trigger, its context for a frequent one, or anything if it is settled."""
        hot = frequent.value
        for batch in steps(batches, STEP):
            row, trigger, first, last, h, c = phrases(*text_bytes(batch.column("text")))
            d, dup = batch.column("d").to_numpy()[row], batch.column("dup").to_numpy()[row]
            pos = _packed(trigger, first, last)
            gone = _settled((_corpus_rank(batch)[row] << 32) + trigger, h, c)
            often = np.isin(h, hot)
            key = np.where(gone, mix((d * 31 + pos).view(np.uint64)).view(np.int64), np.where(often, h ^ (c * 3), h))
            state = np.where(gone, 2, often.astype(np.int64)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, c, d, dup, pos, state)], ["key", "c", "d", "dup", "pos", "state"])

    return run


def _frequent(docs: DataFrame) -> np.ndarray:
    """Triggers of more than a share of sampled documents, sorted."""

    def run(batches):
        for batch in steps(batches, STEP):
            row, _, _, _, h, _ = phrases(*text_bytes(batch.column("text")))
            both = np.unique(np.stack((row, h)), axis=1)
            values, n = np.unique(both[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    total = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("d"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / total)) + 1).select("text")
    got = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, int(FREQUENT * min(SAMPLE, total)))).toArrow()
    return np.sort(got["h"].to_numpy()) if got.num_rows else np.zeros(0, np.int64)


def _strings(batches):
    """A row for each block of a document's phrases ``p``: ``BLOCK`` neighbouring 100-byte strings around a core that all of them share.

    Blocks are counted back from the trigger, so equal strings stand at equal
    places of blocks with equal cores. A row has the hash of the core, one of
    all its strings, the first start with its distance from the trigger, and the
    strings' own hashes; it is settled if an earlier row of the step has the same.
    """
    for batch in steps(batches, STEP):
        data, offsets = text_bytes(batch.column("text"))
        prefix = prefix_hashes(data)
        lists = batch.column("p")
        pos = lists.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        trigger = pos >> 14
        first, last = trigger - ((pos >> 7) & 127), trigger - (pos & 127)
        n = last - first + 1
        start = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        phrase = np.repeat(np.arange(len(n)), n)
        back = trigger[phrase] - start
        block = back // BLOCK
        at = np.flatnonzero(np.concatenate(([True], (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1])))) if len(start) else np.zeros(0, np.int64)
        whole = start + offsets[row[phrase]]
        strings = range_hashes(prefix, whole, whole + LENGTH)
        nearest = (trigger[phrase] + offsets[row[phrase]] - block * BLOCK)[at]
        core = mix(range_hashes(prefix, nearest, nearest + LENGTH - BLOCK + 1) + block[at].astype(np.uint64))
        every = np.add.reduceat(mix(strings + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at) if len(at) else np.zeros(0, np.uint64)
        row, start, back = row[phrase][at], start[at], back[at]
        size = np.diff(np.concatenate((at, [len(strings)])))
        gone = _settled((_corpus_rank(batch)[row] << 32) + start, core, every)
        d, dup = batch.column("d").to_numpy()[row], batch.column("dup").to_numpy()[row]
        core = np.where(gone, mix((d * 31 + start).view(np.uint64)), core)
        kept = strings[np.repeat(~gone, size)].view(np.int64)
        hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(gone, 0, size)))), pa.int32()), pa.array(kept))
        plain = [core.view(np.int64), every.view(np.int64), d, dup, start << 11 | back << 4 | size, gone]
        yield pa.RecordBatch.from_arrays([*map(pa.array, plain), hashes], ["core", "every", "d", "dup", "pos", "gone", "strings"])


def _cut(batches):
    """Counts and digest of each document without the bytes of its ranges, which are pairs of first and last start."""
    for batch in steps(batches):
        rows = []
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        for i, ranges in enumerate(batch.column("ranges")):
            low, high = int(offsets[i]), int(offsets[i + 1])
            n, removed, spans, kept = high - low, 0, 0, raw[low:high]
            if ranges.is_valid and len(ranges):
                change = np.zeros(n + 1, np.int64)
                values = ranges.values
                first, last = values.field(0).to_numpy(), values.field(1).to_numpy()
                np.add.at(change, first, 1)
                np.add.at(change, last + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = data[low:high][~gone].tobytes()
            rows.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if "with_text" in batch.schema.names else None))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, d, dup, text): documents in corpus order by d and dup. Rows that share a doc_id follow one another by their text, null ids come first."""
    rows = text_column(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("d", F.coalesce("doc_id", F.lit(LOWEST)))
    total, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total == distinct:
        return rows.withColumn("dup", F.lit(0).cast("long"))
    return materialize(rows.withColumn("dup", (F.row_number().over(W.partitionBy("d").orderBy("text")) - 1).cast("long")))


@tidy
def repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of docs (doc_id, text, …).

    A byte goes if a 100-byte string over it also starts earlier: in a smaller
    doc_id, or before in the same document. Null texts count as empty. Null ids
    come before all others; rows that share an id are documents of their own, in
    the order of their texts. ``kept`` has the bytes that stay. A text beyond
    256 MiB is an error. Other columns are not read. An empty table gives no rows.
    """
    rows = _numbered(docs)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows))
    place = "d long, dup long"
    parsed = rows.select("d", "dup", "text").mapInArrow(_parse(frequent), f"key long, c long, {place}, pos long, state tinyint")
    # state 0: dealt by trigger; 1: by trigger and context; 2: settled
    group = W.partitionBy("key")
    ranked = parsed.withColumn("first", F.row_number().over(W.partitionBy("key", "c").orderBy("d", "dup", "pos")) == 1)
    ranked = ranked.withColumn("several", (F.min("c").over(group) != F.max("c").over(group)) | (F.max("state").over(group) == 1))
    told = materialize(ranked.select("d", "dup", "pos", (~F.col("first") | (F.col("state") == 2)).alias("gone"), "several").where("gone or several"))
    trigger = F.shiftright("pos", 14)
    ranges = told.where("gone").select("d", "dup", (trigger - F.shiftright("pos", 7).bitwiseAND(127)).cast("int").alias("a"), (trigger - F.col("pos").bitwiseAND(127)).cast("int").alias("b"))
    open_ = told.where("not gone").groupBy("d", "dup").agg(F.array_sort(F.collect_list("pos")).alias("p"))  # phrases of one document
    blocks = rows.select("d", "dup", "text").join(open_.hint("merge"), ["d", "dup"]).mapInArrow(_strings, f"core long, every long, {place}, pos long, gone boolean, strings array<long>")
    core = W.partitionBy("core")
    start, size = F.shiftright("pos", 11), F.col("pos").bitwiseAND(15)
    blocks = blocks.withColumn("first", F.row_number().over(W.partitionBy("core", "every").orderBy("d", "dup", "pos")) == 1).withColumn("several", F.min("every").over(core) != F.max("every").over(core))
    blocks = materialize(blocks.where("gone or not first or several").withColumn("strings", F.when(~F.col("gone") & F.col("first"), F.col("strings"))))
    equal = blocks.where("gone or not first").select("d", "dup", start.cast("int").alias("a"), (start + size - 1).cast("int").alias("b"))
    single = blocks.where("not gone and first").select("core", "d", "dup", "pos", F.posexplode("strings").alias("i", "string"))
    single = single.select("core", "string", (F.shiftright("pos", 4).bitwiseAND(127) - F.col("i")).alias("back"), "d", "dup", (start + F.col("i")).cast("int").alias("start"))
    later = single.withColumn("r", F.row_number().over(W.partitionBy("core", "string", "back").orderBy("d", "dup", "start"))).where("r > 1").select("d", "dup", F.col("start").alias("a"), F.col("start").alias("b"))
    gone = ranges.unionByName(equal).unionByName(later).groupBy("d", "dup").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # ranges of one document
    joined = rows.join(gone.hint("merge"), ["d", "dup"], "left").select("doc_id", "text", "ranges", *([F.lit(1).alias("with_text")] if with_text else []))
    out = joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
