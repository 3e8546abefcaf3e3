"""Best-fit packing of tokenized documents, planned on lengths alone.

Piece lengths are whole numbers up to the capacity, so the number of pieces of
each length is a table with at most as many rows as the capacity, whatever the
size of the corpus. The plan is made on that table: pieces above a third of the
capacity first, longest first, at most two to a sequence by greedy matching,
then the smaller ones, each into the fullest sequence that has room. The plan
is a few ranges of ranks for each length, joined to the pieces by length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, steps, text_column, tidy

CAPACITY = 2048
#: Words of a generation of what a worker remembers, about 200 bytes each; a step of text may add its own words once.
REMEMBERED = 100_000
RANKED_TOGETHER = 10_000


def _class(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(prefix))


#: How the vocabulary file cuts a text into words, for code points below U+0250.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
#: Texts with other code points, letters whose lower case is another one, control signs or special tokens go to the tokenizer whole.
_OWN = "".join(re.escape(chr(c)) for c in range(0xA1, 0x250) if max(map(ord, chr(c).lower())) < 0x250)
_ODD = re.compile(rf"[^\t\n\r\x20-\x7e{_OWN}]|<\|startoftext\|>|<\|endoftext\|>")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers; words are encoded once and remembered.

    Words stand in a young and an old generation: the young one becomes the old
    one when it is full, and a word that is met again is young again, so frequent
    words stay and rare ones go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        """Encode words, many in one text: white space between them keeps them apart, and the last token of each word is marked as such."""
        for low in range(0, len(words), 4096):
            some = words[low : low + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            raw = ids.tobytes()
            self.young.update(zip(some, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [None if _ODD.search(t) else _WORD.findall(t.lower()) for t in texts]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        new = set().union(*filter(None, words)).difference(self.young)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        self._learn(list(new - again))
        get = self.young.__getitem__
        return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then 0, cut only beyond the capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(tokenizer)
        for batch in steps(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[low : low + 4 * capacity]
                    rows.append((doc_id, k, low // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return text_column(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, n, per_bin, sequence, offset) for counts of pieces by length.

    Pieces of that length with rank first … first + n - 1 go to sequences from
    ``sequence`` on, ``per_bin`` to each, from ``offset`` on. Sequences with the
    same room are kept as ranges, and the best fit is the least room that
    suffices: filling one sequence with pieces of one length until no more fit is
    what best fit does piece by piece.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_rooms, fresh, out = 0, 0, []

    def give(gap, base, n):
        nonlocal open_rooms
        if n:
            room[gap].append((base, n))
            open_rooms |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        large = 3 * length > capacity
        while left:
            fits = open_rooms >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                base, bins = room[gap].pop()
                if not room[gap]:
                    open_rooms &= ~(1 << gap)
            else:
                gap, base, bins = capacity, fresh, -(-left // (capacity // length))
                fresh += bins
            per = min(gap // length, 2) if large else gap // length
            full = min(bins, left // per)
            if full:
                out.append((length, rank, full * per, per, base, capacity - gap))
                give(gap - per * length, base, full)
                rank, left, base, bins = rank + full * per, left - full * per, base + full, bins - full
            if bins and left and left < per:
                out.append((length, rank, left, left, base, capacity - gap))
                give(gap - left * length, base, 1)
                rank, left, base, bins = rank + left, 0, base + 1, bins - 1
            give(gap, base, bins)
    return out


@tidy
def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece with its place.

    A null text is an empty one and gives one piece with the id 0 alone. Repeated
    rows and null ids are packed like any other row. Other columns are ignored.
    An empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, with_ids))
    total = cut.count()
    parts = total // RANKED_TOGETHER + 1
    dealt = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    groups = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = groups.select("length", "_part", (F.sum("n").over(W.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    planned = cut.sparkSession.createDataFrame(rows, "length long, first long, n long, per long, base long, at long")
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")
    # at most a few ranges for each length, so the plan has a fixed bound
    here = (ranked["length"] == planned["length"]) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(planned), here).withColumn("_i", F.col("_rank") - F.col("first"))
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("base") + F.floor(F.col("_i") / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(F.col("_i"), F.col("per")) * ranked["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
