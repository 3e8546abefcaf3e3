"""Documents drawn towards the word runs of a target by importance resampling.

One scan of a document keeps a ring of running CRC states, one for each of the
last n starts: a word opens a state of its own and extends the others by a blank
and itself, and every state on the way names the bucket of a run of words. The
counts of all buckets, over all documents and over the target, give each bucket
a gain; a document's mean gain plus Gumbel noise from its id is its score, and
the highest scores are the sample.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import STEP_BYTES, materialize, text_bytes, text_column, tidy

#: Digits, letters and all bytes beyond ASCII make words; A-Z count as a-z, and every other byte as a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
FEATURES = ["n_words", "n_features", "weight", "score"]


class Ring:
    """Running CRC states of the last n starts of a document."""

    def __init__(self, n: int):
        self.n, self.open = n, []  # open[k]: state of the run of k + 1 words that ends at the last word

    def feed(self, words: list[bytes]) -> list[np.ndarray]:
        """States of all runs of 1 to n words that end within these words, by length."""
        out = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        longer = [b" " + w for w in words] if self.n > 1 else []
        for k in range(1, self.n):
            before = [*self.open[k - 1 : k], *out[-1][:-1].tolist()]
            ends = longer[len(longer) - len(before) :]
            out.append(np.fromiter(map(zlib.crc32, ends, before), np.uint32, len(before)))
        self.open = [int(s[-1]) for s in out if len(s)]
        return out


def word_steps(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about STEP_BYTES of it at a time."""
    flat, low = text.translate(_WORDS), 0
    while low < len(flat):
        high = flat.find(b" ", low + STEP_BYTES)
        high = len(flat) if high < 0 else high
        words = flat[low:high].split()
        if words:
            yield words
        low = high


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[low:high].tobytes()


def bucket_counts(docs: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many runs of words of all texts fall into each bucket; each task gives at most one row for each bucket."""

    def run(batches):
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                ring = Ring(n)
                for words in word_steps(text):
                    for states in ring.feed(words):
                        held.append(states)
                        size += len(states)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held) % np.uint32(buckets), minlength=buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in text_column(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much more often each bucket is met in the target, one added to every count."""
    many, wanted, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (many + n)) / float((s + 1) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: str, seed: int) -> int:
    """A thousand times a Gumbel variate that the id fixes."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def features(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """docs (…, id string, text string) with n_words, n_features, weight and score instead of id and text."""
    size = np.uint32(len(gain))
    kept = docs.columns[:-2]

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(len(kept)).to_pylist(), _texts(batch.column(len(kept) + 1))):
                ring, words, many, total = Ring(n), 0, 0, 0
                for some in word_steps(data):
                    words += len(some)
                    for states in ring.feed(some):
                        many += len(states)
                        total += int(gain[states % size].sum())
                weight = total // many if many else 0
                rows.append((words, many, weight, weight + noise(i, seed)))
            numbers = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *numbers], [*kept, *FEATURES])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-2], *[T.StructField(c, T.LongType()) for c in FEATURES]]))


@tidy
def importance(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs (doc_id, text, …); target has a column text.

    rank counts from 1 for the ``percent`` of the rows with ``least_words`` words
    that score highest, smaller ids first among equals, and is null for the rest.
    With ``whole`` a struct ``row`` holds all columns of docs, whatever their names.

    Null and empty texts have no words: weight 0, no rank. Null ids count as
    empty text in the noise and come last among equal scores; repeated rows have
    a rank each. Texts may be of any length: they are scanned piece by piece. An
    empty target only adds the same to all gains of equal counts; an empty docs
    gives no rows. Scores are whole thousandths of logarithms of 64-bit counts,
    so there are some 200,000 different ones at most, whatever the number of rows.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scored = materialize(features(docs.select("doc_id", *row, empty("doc_id").alias("id"), empty("text").alias("text")), gain, n, seed))
    enough = F.col("n_words") >= least_words
    levels = scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).select("score", F.sum("n").over(W.orderBy(F.desc("score"))).alias("upto"), "n")
    wanted = scored.where(enough).count() * percent // 100
    levels = levels.select("score", (F.col("upto") - F.col("n")).alias("before")).where(F.col("before") < wanted)
    cut = levels.agg(F.min("score")).first()[0]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chosen = enough & (F.col("score") >= cut)
    among = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    ranked = scored.where(chosen).join(F.broadcast(levels), "score").withColumn("rank", F.col("before") + F.row_number().over(among)).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that ``importance`` draws, with their own columns."""
    return importance(docs, target, whole=True, **options).where("rank is not null").select("row.*")
