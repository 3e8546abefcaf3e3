"""Document quality: random-indexing word vectors, pooled, then a two-layer network.

Every word and every word shape (letters, digits and signs with runs made one;
a word that repeats the one before has a shape of its own) has a sparse random
index vector. A word's vector is its own index vector plus
the sum of its neighbours' over all documents, each scaled to length one.
Word vectors are kept for a fixed number of hash buckets, so the model has a
fixed size. A document is the mean vector of its words beside that of its
shapes. The network is trained on the driver on at most ``MAX_TRAIN`` labelled
rows; a fifth of them only sets the temperature that calibrates the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, fold, lean, materialize, steps, text_bytes, text_column
from .words import LOWER, prefix_hashes, range_hashes, word_ranges

#: The bound of the labelled sample; rows are taken by a hash of their id.
MAX_TRAIN = 6000
BUCKETS, SHAPES, WIDTH, NONZERO, REACH = 1 << 15, 1 << 12, 64, 8, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.003, 1e-3
THRESHOLD = 0.7
#: A word takes about 500 bytes while it is looked up.
POOL_BYTES = STEP_BYTES // 4
#: Words with a neighbour that a task gathers before it adds them up, and different ones of these that are added at once.
PAIRS, PAIR_BLOCK = 1 << 22, 1 << 15
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse vectors of -1, 0 and 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, WIDTH), np.int8)
    at = rng.random((n, WIDTH)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), 1)
    return out


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, its start and end, and its row."""
    start, end, row = word_ranges(data, offsets)
    return (range_hashes(prefix_hashes(LOWER[data]), start, end) % np.uint64(BUCKETS)).astype(np.int64), start, end, row


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its shape, and its row."""
    words, start, end, row = word_buckets(data, offsets)
    kinds = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[start] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    shapes = range_hashes(prefix_hashes(kinds[keep]), at[start], at[end]) % np.uint64(SHAPES - 1) + np.uint64(1)
    shapes[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])] = 0  # a word said again has a form of its own
    return words, shapes.astype(np.int64), row


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def neighbours(words: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """A number for each word and neighbour within reach in its row, the word's bucket in its high bits."""
    out = []
    for k in range(1, REACH + 1):
        same = row[k:] == row[:-k]
        left, right = words[:-k][same].astype(np.uint32), words[k:][same].astype(np.uint32)
        out += [left * np.uint32(BUCKETS) + right, right * np.uint32(BUCKETS) + left]
    return out


def add_neighbours(pairs: list[np.ndarray], index: np.ndarray, total: np.ndarray) -> None:
    """Add the neighbour's index vector to each word's sum, once for each different pair with the number of times it is met."""
    places = np.nonzero(index)[1].reshape(-1, NONZERO)
    signs = np.take_along_axis(index, places, 1).astype(np.float64)
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    for low in range(0, len(pair), PAIR_BLOCK):
        own, near = np.divmod(pair[low : low + PAIR_BLOCK].astype(np.int64), BUCKETS)
        first, last = own[0], own[-1] + 1
        at = places.take(near, 0)
        at += ((own - first) * WIDTH)[:, None]
        n = signs.take(near, 0)
        n *= times[low : low + PAIR_BLOCK, None]
        total[first:last] += np.bincount(at.ravel(), n.ravel(), (last - first) * WIDTH).reshape(-1, WIDTH).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sum of the neighbours' index vectors for each bucket, over docs (text); whole numbers, so any order of addition gives the same."""

    def run(batches):
        index = index_vectors(BUCKETS, 1)
        total = np.zeros((BUCKETS, WIDTH), np.int64)
        held, n = [], 0
        for batch in steps(batches):
            words, _, _, row = word_buckets(*text_bytes(batch.column("text")))
            new = neighbours(words, row)
            held, n = held + new, n + sum(map(len, new))
            if n > PAIRS:
                add_neighbours(held, index, total)
                held, n = [], 0
        if n:
            add_neighbours(held, index, total)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(total[used, k]) for k in range(WIDTH))], ["bucket", *(f"v{k}" for k in range(WIDTH))])

    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"v{k} long" for k in range(WIDTH)))
    sums = parts.groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)]).toArrow()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    out[sums["bucket"].to_numpy()] = np.stack([sums[f"v{k}"].to_numpy() for k in range(WIDTH)], 1) if sums.num_rows else 0
    return out


def pooled(text: pa.Array, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, log of the number of words; zeros without words."""
    codes, forms, row = word_codes(*text_bytes(text))
    out = np.zeros((len(text), 2 * WIDTH + 1), np.float32)
    if len(row):
        rows, first, count = np.unique(row, return_index=True, return_counts=True)
        out[rows, :WIDTH] = np.add.reduceat(words[codes], first, 0) / count[:, None]
        out[rows, WIDTH:-1] = np.add.reduceat(shapes[forms], first, 0) / count[:, None]
        out[rows, -1] = np.log1p(count)
    return out


@dataclass
class QualityModel:
    words: np.ndarray
    shapes: np.ndarray
    layers: tuple | None
    prior: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.maximum(((x - mean) / scale) @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray) -> tuple:
    """Layers after Adam steps over mini-batches, in an order fixed by a seed."""
    rng = np.random.Generator(np.random.PCG64(7))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), np.float32(0)]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for low in range(0, len(z), 128):
            a, t = z[order[low : low + 128]], y[order[low : low + 128]]
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [a.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return (mean, scale, *p)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel:
    """Model of ``labels`` (doc_id, quality) on documents whose fold of four is not 2; word vectors, which need no label, of all documents.

    Null labels, and ids with contradictory ones, teach nothing. Without both
    classes every score is the share of label 1, or 0.5 without any label.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    rows = text_column(docs, F.col("doc_id").cast("long").alias("doc_id")).where(fold(F.col("doc_id"), 4) != 2)
    ids = rows.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(max_train)
    sample = materialize(rows.join(F.broadcast(ids), "doc_id")).repartition(8, "doc_id")  # max_train ids at most
    context = _unit(context_vectors(text_column(docs)))
    words, shapes = _unit(index_vectors(BUCKETS, 1).astype(np.float32)) + context, _unit(index_vectors(SHAPES, 2).astype(np.float32))
    shared = sample.sparkSession.sparkContext.broadcast((words, shapes))

    def run(batches):
        for batch in steps(batches, POOL_BYTES):
            x = pooled(batch.column("text"), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.float32()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    got = sample.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality float, x array<float>").orderBy(F.xxhash64("doc_id")).toArrow()  # at most max_train rows
    shared.unpersist()
    y = got["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel(words, shapes, None, float(y.mean()) if len(y) else 0.5)
    x = np.stack(got["x"].to_pylist()).astype(np.float32)
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    model = QualityModel(words, shapes, _train(x[~aside], y[~aside]), float(y.mean()))
    if aside.any():
        logits = model.logits(x[aside]).astype(np.float64)
        loss = lambda t: np.logaddexp(0, np.where(y[aside] > 0, -logits, logits) / t).mean()
        model.temperature = float(min(np.exp(np.linspace(-1.5, 2, 71)), key=loss))
    return model


def score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every text; a null or empty text has the score of no words."""
    shared = lean(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        m = shared.value
        found = [m.scores(pooled(part.column("text"), m.words, m.shapes)) for part in steps([batch], POOL_BYTES)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, run(F.coalesce(F.col("text"), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text, …).

    A null text counts as empty, and an empty one has the score of no words. Rows
    are scored one by one, so repeated rows and ties have equal scores, and null
    ids are never held out. Very long texts are a step of their own. Of labels
    only doc_id and quality are read, of docs only doc_id and text, whatever else
    is there. An empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
