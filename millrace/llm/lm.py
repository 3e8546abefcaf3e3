"""Language-model scores by logistic mixing of hashed-context bit predictors.

Words that training has twice or more, the ``FREQUENT`` most frequent ones at most,
form a list; ``running`` predicts them, and an escape for all others, from the
tokens before, bit by bit. An escaped token has its exact share among those beyond
the list, however rare it is, and the share of its spelling: its bytes and a blank,
eight binary decisions to a byte. Counts of both outcomes under five hashed
contexts (all bytes of the word so far, the last four within a gate, the last two,
three and five) make predictions; gated weights, learnt online in the logistic
domain, combine them, and an adaptive probability map refines the result. A gate
is a cluster of documents; that of a token follows from the tokens before it.

Everything that is counted is counted over all training documents on the
cluster: token counts go through one shuffle, every distinct token outside the
list is spelt once, and documents meet these figures in a join. The tables of
running text grow with the number of distinct tokens up to ``MOST_SIZE``; those of
the spelling have a fixed size. Weights, gates and maps are learnt from all training
documents too: each task learns from its own rows, and what the tasks have learnt is
merged by what each has seen.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, steps, text_bytes, text_column, tidy
from .mixing import APM_BINS, LEVELS, bin_of, learn, merged, no_curve, opinion, refined_logs, squash, step_of
from .running import END, ORDERS, RunningModel, count, numbered, unpacked, without_own
from .words import cut_words, mix, prefix_hashes, range_hashes

#: Gates, the width of what they are found by, and the centres that a task keeps of its documents.
GATES, GATE_WIDTH, CENTRES = 6, 512, 24
FREQUENT = 100_000
#: Slots of each predictor's table, as powers of two: the word so far, four bytes in a gate, two, three and five bytes.
SIZES = (20, 20, 18, 19, 20)
#: The tables that all gates share.
SHARED = (0, 2, 3, 4)
BLOCK = 1 << 16
#: Words of the first step of learning to spell, of the largest one, and of the task that learns from them.
MIX_LEAST, MIX_BATCH, MIX_TASK = 128, 4096, 250_000
#: Slots of the tables of running text, as powers of two: sixteen slots for each distinct token between these bounds.
LEAST_SIZE, MOST_SIZE = 14, 22
#: Tokens of one step of scoring, and of counting, in a Python task; a longer text is a step of its own.
TOKEN_STEP, COUNT_STEP = 1 << 19, 1 << 20
#: Bytes of text of one step of numbering, whose look-up is made anew for each.
NUMBER_STEP = 4 << 20
#: Words that a task holds before it passes their counts on.
HELD = 1 << 22


# gates


def gate_features(words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed counts of the words of each text."""
    data, offsets = text_bytes(words)
    code = (range_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) % np.uint64(GATE_WIDTH)).astype(np.int64)
    code += np.repeat(np.arange(len(sizes)) * GATE_WIDTH, sizes)
    x = np.sqrt(np.bincount(code, minlength=len(sizes) * GATE_WIDTH).reshape(len(sizes), GATE_WIDTH))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def sums_by(own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each of k groups."""
    return (own == np.arange(k)[:, None]).astype(x.dtype) @ x


def fit_gates(train: DataFrame) -> np.ndarray:
    """Centres of k-means by cosine over all texts: each task keeps the sums of its texts about a few moving centres, and those are grouped, the best of ten starts."""

    def run(batches):
        sums = None
        for batch in steps(batches):
            x = gate_features(*cut_words(batch.column("text"))).astype(np.float32)
            if sums is None:
                sums, centre = np.zeros((CENTRES, GATE_WIDTH), np.float32), x[np.linspace(0, len(x) - 1, CENTRES).astype(np.int64)]
                for _ in range(4):
                    found = sums_by((x @ centre.T).argmax(1), x, CENTRES)
                    centre = np.where(found.any(1, keepdims=True), unit(found), centre)
            sums += sums_by((x @ centre.T).argmax(1), x, CENTRES)
            centre = np.where(sums.any(1, keepdims=True), unit(sums), centre)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in sums[sums.any(1)]], pa.binary())], ["x"])

    got = train.select("text").mapInArrow(run, "x binary").toArrow()  # at most CENTRES rows of each task, put in order here
    if not got.num_rows:
        return np.zeros((GATES, GATE_WIDTH))
    sums = np.stack([np.frombuffer(b, np.float32) for b in sorted(got["x"].to_pylist())]).astype(np.float64)
    x, best = unit(sums), (-1.0, np.zeros((GATES, GATE_WIDTH)))
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(10):
        c = x[rng.permutation(len(x))[:GATES]]
        c = np.concatenate((c, np.zeros((GATES - len(c), GATE_WIDTH))))
        for _ in range(12):
            found = sums_by((x @ c.T).argmax(1), sums, GATES)
            c = np.where(found.any(1, keepdims=True), unit(found), c)
        best = max(best, (float((sums @ c.T)[np.arange(len(x)), (x @ c.T).argmax(1)].sum()), c), key=lambda r: r[0])
    return best[1]


# bit predictors


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All bytes with their blanks, the word of each, and the context hash of each byte for every predictor (the gated one without its gate)."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length)
    start = np.repeat(end - length, length)
    at = np.arange(len(data))
    prefix = range_hashes(prefix_hashes(data), start, at)
    back = [np.where(at - k >= start, np.roll(data, k), 0).astype(np.uint64) << np.uint64(8 * k - 8) for k in range(1, 6)]
    last = lambda k: mix(sum(back[:k]) + np.uint64(k << 56))
    return data, np.repeat(np.arange(len(words)), length), [prefix, last(4), last(2), last(3), last(5)]


def gated(context: np.ndarray, gate) -> np.ndarray:
    return context ^ (np.atleast_1d(np.asarray(gate, np.uint64)) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def bases(contexts: list[np.ndarray], data: np.ndarray, half: int, tables) -> list[np.ndarray]:
    """First of the sixteen slots of each mixed context for one half of its byte, from the high bits of a product; bits of the half before count to the context."""
    above = (data >> np.uint8(4)).astype(np.uint64) + np.uint64(16) if half else np.zeros(len(data), np.uint64)
    above *= np.uint64(0xD6E8FEB86659FD93)
    return [(((c + above) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIZES[t])).astype(np.int64) for c, t in zip(contexts, tables, strict=True)]


def node_and_bit(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of the k-th bit among the fifteen of its half, and the bit."""
    half = (data >> np.uint8(4) if k < 4 else data & np.uint8(15)).astype(np.int64)
    return (1 << k % 4) | half >> (4 - k % 4), half >> (3 - k % 4) & 1


def count_tables(words: list[bytes], counts: np.ndarray, into: list[np.ndarray]) -> None:
    """Add the outcomes of training words to tables of two counts a slot: each word once, and once for each gate where it has a count.

    Listed words are predicted from the words before them, so what is spelt is mostly rare or
    new, and new words are like distinct words, not like running text.
    """
    data, word, contexts = spell(words)
    of_word, gate = np.nonzero(counts > 0)
    of_word, gate = of_word[order := np.argsort(gate, kind="stable")], gate[order]
    # places of the bytes of each word under each of its gates
    length = np.bincount(word, minlength=len(words))
    n = length[of_word]
    places = np.arange(n.sum()) + np.repeat((np.cumsum(length) - length)[of_word] - (np.cumsum(n) - n), n)
    contexts[1] = gated(contexts[1][places], np.repeat(gate, n))
    flat = [t.reshape(-1) for t in into]
    for k in range(8):
        node, bit = node_and_bit(data, k)
        if k % 4 == 0:
            first = bases([contexts[t] for t in SHARED], data, k // 4, SHARED)
            own = bases(contexts[1:2], data[places], k // 4, [1])[0]
        for t, base in zip(SHARED, first, strict=True):
            np.add.at(flat[t], (base ^ node) * 2 + bit, 1)
        np.add.at(flat[1], (own ^ node[places]) * 2 + bit[places], 1)


@dataclass
class Mixer:
    """Weights by (gate, confidence of the prefix), and the probability map by place of the bit in its byte."""

    weights: np.ndarray
    apm: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        apm = np.repeat(squash(np.linspace(-8, 8, APM_BINS))[None], 8, 0)
        return cls(np.full((GATES, LEVELS, len(SIZES) + 1), 0.3), apm)


@dataclass
class BitModel:
    """Opinions and confidences of all slots, with the mixer."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    mixer: Mixer

    def log10(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: log10 of its probability under every gate."""
        out = np.zeros((len(words), GATES))
        if not words:
            return out
        data, word, contexts = spell(words)
        # words that begin alike share their first bytes: all contexts follow from the word so far
        key = contexts[0] ^ mix(data.astype(np.uint64) + np.uint64(1))
        _, first, run = np.unique(key, return_index=True, return_inverse=True)
        data, contexts = data[first], [c[first] for c in contexts]
        contexts = [contexts[t] for t in SHARED] + [gated(contexts[1], g) for g in range(GATES)]
        weights = self.mixer.weights.astype(np.float32)
        both = [0, 2, 3, 4, 5]  # the predictors that all gates share, and the constant
        logs = refined_logs(self.mixer.apm, 1e-5).reshape(8, -1)
        total = np.zeros((GATES, len(data)))
        x = np.ones((len(data), 5), np.float32)
        for k in range(8):
            node, bit = node_and_bit(data, k)
            if k % 4 == 0:
                first = bases(contexts, data, k // 4, [*SHARED, *[1] * GATES])
            for place, t in enumerate(SHARED):
                at = first[place] ^ node
                x[:, place] = self.tables[t][0].take(at)
                if t == 0:
                    level = self.tables[0][1].take(at).astype(np.int64)
            z = np.empty((len(data), GATES), np.float32)
            for v in range(LEVELS):
                own = np.flatnonzero(level == v)
                z[own] = x[own] @ weights[:, v, both].T
            for g in range(GATES):
                own = self.tables[1][0].take(first[len(SHARED) + g] ^ node) * weights[g, :, 1].take(level)
                total[g] += logs[k].take(2 * step_of(z[:, g] + own) + bit)
        for g in range(GATES):
            out[:, g] = np.bincount(word, total[g][run], len(words)) / np.log(10)
        return out


def learn_spelling(mixer: Mixer, curve: np.ndarray, minus: list[np.ndarray], words: list[bytes], gates: np.ndarray, met: np.ndarray, known: int) -> int:
    """Teach a mixer words in their order; each word's own count is taken out of what it meets. Zeros and ones by bin of the map are added up; gives the number of words known."""
    weights, low = mixer.weights.reshape(GATES * LEVELS, -1), 0
    while low < len(words):
        part = slice(low, low + min(MIX_BATCH, max(MIX_LEAST, known // 8)))
        data, word, contexts = spell(words[part])
        gate = gates[part][word]
        contexts[1] = gated(contexts[1], gate)
        for k in range(8):
            node, bit = node_and_bit(data, k)
            if k % 4 == 0:
                first = bases(contexts, data, k // 4, range(len(SIZES)))
            x = [unpacked(table.take((base ^ node) * 2 + bit)) for table, base in zip(minus, first, strict=True)]
            order, z = learn(weights, curve, [own for own, _ in x], (gate * LEVELS + x[0][1]).astype(np.uint8), bit)
            met[k] += np.bincount(2 * bin_of(z) + bit.take(order), minlength=2 * APM_BINS).reshape(APM_BINS, 2)
        known += len(words[part])
        low = part.stop
    return known


def with_map(mixer: Mixer, met: np.ndarray) -> Mixer:
    mixer.apm = (8 * mixer.apm + met[..., 1]) / (8 + met.sum(-1))
    return mixer


def fit_mixer(tables: list[np.ndarray], words: list[bytes], gates: np.ndarray) -> Mixer:
    """Mixer learnt online on words at hand."""
    mixer, met = Mixer.new(), np.zeros((8, APM_BINS, 2))
    learn_spelling(mixer, no_curve(mixer.weights.reshape(GATES * LEVELS, -1)), [without_own(t).reshape(-1) for t in tables], words, gates, met, 0)
    return with_map(mixer, met)


def fit_spelling(words: DataFrame, tables: list[np.ndarray]) -> Mixer:
    """Mixer learnt online on all distinct training words (word, t0 …), each under the gate where it is most frequent: by each task on its own, merged by what each knows."""
    names = [f"t{g}" for g in range(GATES)]
    held = words.sparkSession.sparkContext.broadcast([without_own(t).reshape(-1) for t in tables])

    def run(batches):
        mixer, met, known = Mixer.new(), np.zeros((8, APM_BINS, 2)), 0
        curve = no_curve(mixer.weights.reshape(GATES * LEVELS, -1))
        for batch in batches:
            best = np.stack([batch.column(c).to_numpy() for c in names], 1).argmax(1)
            known = learn_spelling(mixer, curve, held.value, batch.column("word").to_pylist(), best, met, known)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (mixer.weights, curve, met)], ["w", "v", "m"])

    # in the order of a hash, so that the weights do not depend on which task ended first
    got = words.select("word", *names).sortWithinPartitions(F.xxhash64("word")).mapInArrow(run, "w binary, v binary, m binary").collect()  # one row of each task
    held.unpersist()
    mixer = Mixer.new()
    if got:
        got.sort(key=lambda r: bytes(r["w"]))
        cells, width = GATES * LEVELS, len(SIZES) + 1
        read = lambda name, *shape: np.array([np.frombuffer(r[name], np.float64).reshape(shape) for r in got])
        mixer.weights = merged(read("w", cells, width), read("v", cells, width, width)).reshape(mixer.weights.shape)
        mixer = with_map(mixer, read("m", 8, APM_BINS, 2).sum(0))
    return mixer


# the corpus


def count_tokens(docs: DataFrame, gates: np.ndarray) -> DataFrame:
    """(word, t0 … , docs0 …): training counts by gate of every token of all documents; the word null counts documents."""
    names = [f"t{g}" for g in range(GATES)]

    def run(batches):
        held, own, ends = [], [], np.zeros(GATES, np.int64)

        def flush():
            met = pc.dictionary_encode(pa.concat_arrays(held))
            n = len(met.dictionary)
            # those of documents that teach nothing stand behind the last gate
            rows = np.bincount(np.concatenate(own) * n + met.indices.to_numpy(), minlength=(GATES + 1) * n).reshape(GATES + 1, n)[:GATES]
            rows = np.concatenate((rows, ends[:, None]), 1)
            words = pa.concat_arrays([met.dictionary, pa.array([END], met.dictionary.type)]).cast(pa.binary())
            held.clear(), own.clear(), ends.fill(0)
            return pa.RecordBatch.from_arrays([words, *map(pa.array, rows)], ["word", *names])

        for batch in steps(batches):
            words, sizes = cut_words(batch.column("text"))
            gate = np.where(batch.column("train").to_numpy(zero_copy_only=False), (gate_features(words, sizes) @ gates.T).argmax(1), GATES)
            ends += np.bincount(gate, minlength=GATES + 1)[:GATES]
            held.append(words)
            own.append(np.repeat(gate, sizes))
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    parts = docs.select("text", "train").mapInArrow(run, "word binary, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def squeezed(part: np.ndarray) -> bytes:
    """Counts in the least width that holds them, which the first byte names, packed."""
    part = part.astype(np.min_scalar_type(part.max()))
    return bytes([part.itemsize]) + pa.Codec("zstd", 1).compress(part.tobytes(), asbytes=True)


def spread(packed: bytes, block: int) -> np.ndarray:
    """The counts of a block of slots."""
    return np.frombuffer(pa.Codec("zstd").decompress(packed[1:], 2 * block * packed[0], asbytes=True), f"u{packed[0]}").reshape(-1, 2)


def sum_tables(counts: DataFrame) -> list[np.ndarray]:
    """Tables of outcomes over all training tokens: each task adds up its own, and the blocks of all tasks are added as they stream by."""
    names = [f"t{g}" for g in range(GATES)]

    def row(t: int, low: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([low], pa.int32()), pa.array([squeezed(part)], pa.binary())], ["t", "low", "n"])

    def run(batches):
        tables = [np.zeros((1 << s, 2), np.int64) for s in SIZES]
        for batch in batches:
            n = np.stack([batch.column(c).to_numpy() for c in names], 1)
            for low in range(0, batch.num_rows, 8192):
                count_tables(batch.column("word").slice(low, 8192).to_pylist(), n[low : low + 8192], tables)
        for t, table in enumerate(tables):
            for low in range(0, len(table), BLOCK):
                if table[low : low + BLOCK].any():
                    yield row(t, low, table[low : low + BLOCK])

    def add(batches):
        key, total = None, np.zeros((BLOCK, 2), np.int64)
        for batch in batches:
            for t, low, n in zip(*(batch.column(c) for c in ("t", "low", "n")), strict=True):
                if (t.as_py(), low.as_py()) != key:
                    if key:
                        yield row(*key, total)
                    key, total = (t.as_py(), low.as_py()), np.zeros((BLOCK, 2), np.int64)
                total += spread(n.as_py(), BLOCK)
        if key:
            yield row(*key, total)

    used = counts.where(" + ".join(names) + " > 0").where(F.col("word") != F.lit(b" "))
    parts = used.mapInArrow(run, "t int, low int, n binary").repartition(F.col("t"), F.col("low")).sortWithinPartitions("t", "low")
    out = [np.zeros((1 << s, 2), np.float32) for s in SIZES]
    for r in parts.mapInArrow(add, "t int, low int, n binary").toLocalIterator():  # fixed: one row for each block of a table
        out[r.t][r.low : r.low + BLOCK] = spread(r.n, BLOCK)
    return out


def numbered_tokens(rows: DataFrame, model: RunningModel) -> DataFrame:
    """(doc_id, train, n_bytes, n_tokens, symbols, hashes): the symbols of all tokens of each row, and the hashes of those that are escapes, as arrays in bytes.

    Texts are cut into words here for all later steps.
    """
    held = rows.sparkSession.sparkContext.broadcast((pa.array(list(model.number), pa.binary()), model.escape))

    def run(batches):
        listed, escape = held.value
        for batch in steps(batches, NUMBER_STEP):
            words, symbols, sizes = numbered(batch.column("text"), listed, escape)
            at = np.flatnonzero(symbols == escape)
            # each text has one token more than words
            beyond = words.take(pa.array(at - np.searchsorted(np.cumsum(sizes), at, "right"))).to_pylist()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, beyond, repeat(42)), np.uint64, len(at))
            ends = np.cumsum(sizes)
            cut = lambda x, bounds: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            bounds = np.concatenate(([0], ends))
            columns = [pa.array(np.diff(text_bytes(batch.column("text"))[1])), pa.array(sizes), cut(symbols.astype(np.int32), bounds), cut(hashes, np.searchsorted(at, bounds))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), *columns], ["doc_id", "train", "n_bytes", "n_tokens", "symbols", "hashes"])

    kind = dict(rows.dtypes)["doc_id"]
    out = materialize(rows.select("doc_id", "text", "train").mapInArrow(run, f"doc_id {kind}, train boolean, n_bytes long, n_tokens long, symbols binary, hashes binary"))
    held.unpersist()
    return out


def token_steps(batches, limit: int = TOKEN_STEP):
    """Batches cut into row ranges of about ``limit`` tokens, with the symbols of all rows and their sizes; no row is cut."""
    for batch in batches:
        ends, low = np.cumsum(batch.column("n_tokens").to_numpy()), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
            part = batch.slice(low, high - low)
            yield part, np.frombuffer(b"".join(part.column("symbols").to_pylist()), np.int32).astype(np.int64), part.column("n_tokens").to_numpy()
            low = high


def running_tables(rows: DataFrame, model: RunningModel) -> list[np.ndarray]:
    """Outcomes under the contexts of running text over all training rows of ``numbered_tokens``: each task adds up its own, and blocks are added as they stream by."""
    size, shape, most = model.size, (1 << model.size, 2), np.iinfo(np.uint16).max
    block = min(BLOCK, shape[0])
    held = rows.sparkSession.sparkContext.broadcast(model.code)

    def row(t: int, low: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([low], pa.int32()), pa.array([squeezed(part)], pa.binary())], ["t", "low", "n"])

    def run(batches):
        code = held.value
        tables = [np.zeros(shape, np.uint32) for _ in range(ORDERS)]
        for _, symbols, sizes in token_steps(batches, COUNT_STEP):
            count(code, symbols, sizes, size, tables)
        for t, table in enumerate(tables):
            for low in range(0, len(table), block):
                if table[low : low + block].any():
                    yield row(t, low, table[low : low + block])

    def add(batches):
        key, total = None, np.zeros((block, 2), np.int64)
        small = lambda n: (n / np.maximum(1, n.max(1, keepdims=True) / most)).astype(np.uint16)
        for batch in batches:
            for t, low, n in zip(*(batch.column(c).to_pylist() for c in ("t", "low", "n")), strict=True):
                if (t, low) != key:
                    if key:
                        yield row(*key, small(total))
                    key, total = (t, low), np.zeros((block, 2), np.int64)
                total += spread(n, block)
        if key:
            yield row(*key, small(total))

    parts = rows.select("n_tokens", "symbols").mapInArrow(run, "t int, low int, n binary").repartition(F.col("t"), F.col("low")).sortWithinPartitions("t", "low")
    out = [np.zeros(shape, np.uint16) for _ in range(ORDERS)]
    for r in materialize(parts.mapInArrow(add, "t int, low int, n binary")).toLocalIterator():  # fixed: one row for each block of a table
        out[r.t][r.low : r.low + block] = spread(r.n, block)
    held.unpersist()
    return out


def fit_running(rows: DataFrame, model: RunningModel, twice: np.ndarray) -> RunningModel:
    """The model with weights and map learnt online on all rows of ``numbered_tokens``, by each task on its own, and merged by what each knows.

    Words of the list that all training documents have ``twice`` are escapes there:
    without the text at hand they would not be in the list.
    """
    held = rows.sparkSession.sparkContext.broadcast((replace(model, number={}, tables=[]), [without_own(t) for t in model.tables], np.flatnonzero(twice)))

    def run(batches):
        own, minus, few = held.value
        instead = np.arange(own.escape + 1)
        instead[few] = own.escape
        found = own.learn(((instead.take(symbols), sizes) for _, symbols, sizes in token_steps(batches)), minus)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in found], ["w", "v", "h", "m"])

    got = rows.select("n_tokens", "symbols").mapInArrow(run, "w binary, v binary, h binary, m binary").collect()  # one row of each task
    got.sort(key=lambda r: bytes(r["w"]))
    read = lambda name, shape: np.array([np.frombuffer(r[name], np.float64).reshape(shape) for r in got]).reshape(-1, *shape)
    weights = merged(read("w", model.weights.shape), read("v", (*model.weights.shape, model.weights.shape[1]))).astype(np.float32) if got else model.weights
    hits, met = read("h", model.apm.shape).sum(0), read("m", model.apm.shape).sum(0)
    held.unpersist()
    return model.with_opinions(weights, (8 * model.apm + hits) / (8 + met))


@tidy
def scores(docs: DataFrame, folds: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs (doc_id, text, …).

    Documents whose fold is 2 are scored but teach nothing. A null text is an
    empty one: its only token is its end. Repeated rows count, and are scored,
    each for itself. Without training documents every base score is 0. Very long
    texts are a step of their own. Other columns are not read. An empty table
    gives no rows. Tokens meet their counts by 64-bit hash.
    """
    names = [f"t{g}" for g in range(GATES)]
    rows = text_column(docs, "doc_id").withColumn("train", fold(F.col("doc_id"), folds) != 2)
    gates = fit_gates(rows.where("train"))
    counts = materialize(count_tokens(rows, gates))
    total = " + ".join(names)
    is_end = F.col("word") == F.lit(END)
    sums = counts.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], *[F.count_if(F.expr(f"{total} = 1 and {x} = 1")).alias(f"once{g}") for g, x in enumerate(names)],
        *[F.coalesce(F.sum(F.when(is_end, F.col(x))), F.lit(0)).alias(f"end{g}") for g, x in enumerate(names)], F.count_if(F.expr(f"{total} > 0")).alias("v"), F.count("*").alias("m"),
    ).first()
    n, v = sum(sums[g] for g in names), sums["v"]
    parts = max(6, sums["m"] // 1_000_000)
    tables = sum_tables(counts.coalesce(parts))
    mixer = fit_spelling(counts.where(~is_end).where(f"{total} > 0").coalesce(max(1, v // MIX_TASK)), tables)
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(BitModel([opinion(t[:, 0].astype(np.float64), t[:, 1].astype(np.float64)) for t in tables], mixer))
    del tables
    # the list: words that occur twice at least, so that those that occur once stand for what new text has of new words
    # only words from the least frequent level that is needed on are sorted, so few rows of each task go to the one that merges
    known = counts.where(~is_end).where(f"{total} > 1")
    level = F.floor(16 * F.log2(F.expr(total))).cast("int")
    levels = sorted(((r.level, r["count"]) for r in known.groupBy(level.alias("level")).count().collect()), reverse=True)  # sixteen to an octave
    need, least = FREQUENT, 0
    for least, size in levels:
        need -= size
        if need <= 0:
            break
    dear = known.where(level >= least).orderBy(F.expr(total).desc(), "word").limit(FREQUENT)
    frequent = dear.toArrow()  # at most FREQUENT rows
    by_gate = np.array([sums[c] for c in names], np.float64)
    end = np.array([[sums[f"end{g}"] for g in range(GATES)]], np.float64)
    listed = np.concatenate((np.stack([frequent[c].to_numpy() for c in names], 1).astype(np.float64).reshape(-1, GATES), end))
    keys = [*frequent["word"].to_pylist(), END]
    size = min(MOST_SIZE, max(LEAST_SIZE, (16 * v).bit_length()))
    model = RunningModel.new(keys, np.concatenate((listed, by_gate - listed.sum(0, keepdims=True))), (end[0] + 1) / (end.sum() + GATES), size)
    tokens = numbered_tokens(rows, model)
    model.tables = running_tables(tokens.where("train"), model)
    model = fit_running(tokens.where("train"), model, np.append(listed.sum(1)[:-1] == 2, [False, False]))
    top = context.broadcast((replace(model, number={}), np.log10(listed.sum(1) + 1), bool(end.any())))
    # what new text has of new tokens, by gate: the share of tokens that all gates together have seen once
    ones = np.array([sums[f"once{g}"] for g in range(GATES)], np.float64)
    lam = 1 - np.minimum(1, (ones + 1) / (by_gate + 2))

    def mixed_share(n: np.ndarray) -> np.ndarray:
        """Shares of tokens by gate, each with a part of that in all gates."""
        return 0.95 * n / np.maximum(by_gate, 1) + 0.05 * n.sum(1, keepdims=True) / max(by_gate.sum(), 1)

    # what an escaped token is: its exact share, and its spelling, of all that is not in the list
    beyond = np.log10(lam * np.maximum(0, 1 - mixed_share(listed).sum(0)) + (1 - lam))
    lps = [f"lp{g}" for g in range(GATES)]
    signed = lambda h: h - ((h >> 63) << 64)

    def token_figures(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 16384):
                words = batch.column("word").slice(low, 16384).to_pylist()
                n = np.stack([batch.column(x).slice(low, 16384).to_numpy() for x in names], 1).astype(np.float64)
                got = np.log10(lam * mixed_share(n) + (1 - lam) * 10 ** bits.value.log10(words) + 1e-300) - beyond
                yield pa.RecordBatch.from_arrays([pa.array([signed(xxhash.xxh64_intdigest(w, 42)) for w in words], pa.int64()), pa.array(n.sum(1).astype(np.int64)), *(pa.array(got[:, g]) for g in range(GATES))], ["h", "c", *lps])

    wanted = counts.join(F.broadcast(dear.select("word")), "word", "left_anti").where(~is_end)  # FREQUENT words at most
    figures = wanted.select("word", *names).mapInArrow(token_figures, "h long, c long, " + ", ".join(f"{x} double" for x in lps))
    figures = figures.select("h", "c", F.array(*lps).alias("lp"))

    def listed_part(batches):
        own, logs, ends = top.value
        logs, known = np.append(logs, 0.0), np.append(np.ones(own.escape - 1, np.int64), [ends, 0])
        for batch, symbols, sizes in token_steps(batches):
            share, gate = own.log_shares(symbols, sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(symbols == own.escape)
            h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            at = at[order := np.lexsort((h, gate[at], row[at]))]
            h, g, own_row = h[order], gate[at], row[at]
            new = np.ones(len(at), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (own_row[1:] != own_row[:-1])
            first = np.flatnonzero(new)
            fields = {"h": h[first], "g": g[first].astype(np.int32), "k": np.diff(np.append(first, len(at)))}
            bounds = np.searchsorted(own_row[first], np.arange(len(sizes) + 1))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([*map(pa.array, fields.values())], [*fields]))
            sums_ = [np.bincount(row, x, len(sizes)) for x in (known[symbols], logs[symbols], share / np.log(10))]
            cols = [pa.array(sums_[0].astype(np.int64)), pa.array(sums_[1]), pa.array(sums_[2])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "n_tokens")), *cols, rare], ["doc_id", "n_bytes", "n_tokens", "n_known", "logs", "lp", "rare"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, n_known long, logs double, lp double, rare array<struct<h:long,g:int,k:long>>"
    part = materialize(tokens.select("doc_id", "n_bytes", "n_tokens", "symbols", "hashes").mapInArrow(listed_part, schema).withColumn("_row", F.monotonically_increasing_id()))
    met = part.select("_row", F.inline("rare")).join(figures, "h")
    added = met.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("a_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("a_logs"), F.sum(F.col("k") * F.element_at("lp", F.col("g") + 1)).alias("a_lp"))
    both = part.drop("rare").join(added, "_row", "left")
    plus = lambda x: F.col(x) + F.coalesce(f"a_{x[2:] if x == 'n_known' else x}", F.lit(0))
    return both.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 2).alias("held_out"), "n_tokens", plus("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (plus("logs") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), plus("lp").alias("score"),
        (-plus("lp") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
