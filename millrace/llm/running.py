"""Bit predictors over running text.

The tokens of a list, and an escape for all others, are the leaves of a prefix
code, so a token is as many binary decisions as its code has bits. Each decision
is predicted from exact counts at its node, in the gate and in all gates, and from
hashed contexts of the last token and of the last two. Weights chosen by the gate
and by what both contexts have seen combine the predictions in the logistic domain,
and a probability map by depth refines the result. The gate of a token is the most
likely one given the tokens of its document before it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .mixing import APM_BINS, GRID, LEVELS, bin_of, learn, no_curve, opinion, refined_logs, squash, step_of, stretch
from .words import cut_words, mix

#: The last token of every document; no word holds a blank.
END = b" "
ORDERS, INPUTS = 2, 5
DEPTH_BITS = 4
DEPTHS = 1 << DEPTH_BITS
#: Tokens of one step, of what a step of learning reads at once, and of that step: few at first, then one in so many that were seen.
BLOCK, READ, LEARN, MOST_LEARN, LEARN_PART = 1 << 13, 1 << 11, 128, 1 << 15, 8
#: Steps of an opinion of a slot on either side of 0, up to 9; the level stands above them.
SCALE, LEVEL_BIT = 4095, 13
_NODE, _SPREAD = np.uint32(0x6659FD93), np.uint32(0x9E3779B1)


@dataclass
class Code:
    """Nodes and bits on the way to each symbol, the root first."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    #: Node, depth and bit in one number, from the high bits.
    packed: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Code:
        """The code of least length for two symbols or more of these weights; ties by number."""
        n = len(weights)
        heap = [(float(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[i, j]], side[j] = node, 1
            heapq.heappush(heap, (a + b, node))
        at = own = np.arange(n)
        ways = []
        while len(at):
            ways.append((own, np.full(len(own), -len(ways)), parent[at] - n, side[at]))
            at = parent[at]
            own, at = own[at != 2 * n - 2], at[at != 2 * n - 2]
        own, up, node, bit = (np.concatenate(c) for c in zip(*ways, strict=True))
        node = grouped(parent[n:] - n, side[n:]).take(node)
        order = np.lexsort((up, own))
        length = np.bincount(own, minlength=n)
        first = np.cumsum(length) - length
        depth = np.minimum(np.arange(len(own)) - np.repeat(first, length), DEPTHS - 1)
        node, bit = node[order].astype(np.int32), bit[order]
        return cls(first, length, node, bit, depth.astype(np.uint8), node * np.int32(2 * DEPTHS) + (depth * 2 + bit).astype(np.int32))

    def ways(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of decisions of every token, and the places of all of them in the arrays of the code."""
        n = self.length.take(symbols)
        begin = np.cumsum(n)
        total = int(begin[-1]) if len(n) else 0
        return n, np.arange(total) + np.repeat(self.first.take(symbols) - (begin - n), n)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of every decision, and its place in the arrays of the code."""
        n = self.length[symbols]
        own = np.repeat(np.arange(len(symbols)), n)
        return own, np.arange(len(own)) + (self.first[symbols] - (np.cumsum(n) - n))[own]

    def counts(self, by_gate: np.ndarray) -> np.ndarray:
        """(node, bit, gate): sums of the counts of symbols by gate."""
        out = np.zeros((len(self.length) - 1, 2, by_gate.shape[1]))
        np.add.at(out, (self.node, self.bit), np.repeat(by_gate, self.length, 0))
        return out


def grouped(parent: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Numbers of the nodes of a tree, whose root comes last and every parent after its children: those of four levels below one of their nodes stand together, so that one way meets few groups of sixteen."""
    n = len(parent)
    parent, side = parent.tolist(), side.tolist()
    top, local, depth = [0] * n, [1] * n, [0] * n
    top[-1] = n - 1
    for i in range(n - 2, -1, -1):
        up = parent[i]
        depth[i] = depth[up] + 1
        if depth[i] % 4:
            top[i], local[i] = top[up], 2 * local[up] + side[i]
        else:
            top[i] = i
    out = np.empty(n, np.int64)
    out[np.lexsort((local, -np.array(top)))] = np.arange(n)
    return out


def numbered(texts, listed, escape: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, the symbols of their tokens, and the number of tokens of each text; ``listed`` has the words of the list in order, its end last."""
    texts, listed = (x if isinstance(x, pa.Array) else pa.array(list(x), pa.binary()) for x in (texts, listed))
    words, sizes = cut_words(texts)
    found = pc.index_in(words, listed.cast(words.type)).fill_null(escape).to_numpy()
    out = np.full(len(found) + len(sizes), len(listed) - 1, np.int64)
    out[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes)] = found
    return words, out, sizes + 1


def before(symbols: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last symbol and the one before it within the text; ``start`` stands before its first."""
    first = np.cumsum(sizes) - sizes
    one, two = np.full(len(symbols), start, np.int64), np.full(len(symbols), start, np.int64)
    one[1:] = symbols[:-1]
    one[first] = start
    two[1:] = one[:-1]
    two[first] = start
    return one, two


def hashed(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last symbol and of the last two."""
    last = mix(one.astype(np.uint64) + np.uint64(1))
    return [x.astype(np.uint32) for x in (last, mix(last ^ ((two.astype(np.uint64) + np.uint64(1)) << np.uint64(32))))]


def alike(one: np.ndarray, two: np.ndarray, symbols: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each run of equal rows, when they are sorted, and the run of every row; numbers below 2**20, 2**20, 2**20 and 8."""
    key = (((one << 20 | two) << 20 | symbols) << 3) | gates
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.empty(len(key), np.int64)
    run[order] = np.cumsum(new) - 1
    return order[new], run


def contexts(symbols: np.ndarray, sizes: np.ndarray, start: int) -> list[np.ndarray]:
    """Hashes of the last token and of the last two within the text; ``start`` stands before its first."""
    return hashed(*before(symbols, sizes, start))


def gates_before(symbols: np.ndarray, sizes: np.ndarray, shares: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """For each token the most likely gate given the tokens of its text before it."""
    first = np.cumsum(sizes) - sizes
    out, best, run = np.zeros(len(symbols), np.uint8), None, np.zeros(len(symbols) + 1)
    for g, column in enumerate(np.ascontiguousarray(shares.T)):
        np.cumsum(column.take(symbols), out=run[1:])
        now = np.repeat(prior[g] - run.take(first), sizes)
        now += run[:-1]
        if best is None:
            best = now
        else:
            np.copyto(out, np.uint8(g), where=now > best)
            np.maximum(best, now, out=best)
    return out.astype(np.int64)


def slots(context: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Slot of a node in a context, from the high bits of a product; sixteen nodes in a row lie together, in an order that the product gives."""
    out = node.astype(np.uint32)
    low = out & np.uint32(15)
    out >>= np.uint32(4)
    out *= _NODE
    out += context
    out *= _SPREAD
    out >>= np.uint32(32 - size)
    out ^= low
    return out


def tallied(context: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of a context's hash and a symbol, in order, and how often each is met."""
    key = np.sort(context.astype(np.uint64) << np.uint64(32) | symbols.astype(np.uint64))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[at] >> np.uint64(32)).astype(np.uint32), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(at, len(key)))


def count(code: Code, symbols: np.ndarray, sizes: np.ndarray, size: int, into: list[np.ndarray]) -> None:
    """Add the outcomes of all decisions to one table of two counts a slot for each context.

    What is met again is added once with its number; in order, slots that are
    added to one after another are often the same.
    """
    if not len(symbols):
        return
    last, two = contexts(symbols, sizes, len(code.length))
    for table, (met, symbol, times) in zip(into, (tallied(last, symbols), tallied(two, symbols)), strict=True):
        flat, times = table.reshape(-1), times.astype(table.dtype)
        for low in range(0, len(met), BLOCK):
            part = slice(low, low + BLOCK)
            n, way = code.ways(symbol[part])
            step = code.packed.take(way)
            place = slots(np.repeat(met[part], n), step >> np.int32(DEPTH_BITS + 1), size).astype(np.int64)
            place <<= 1
            place += step & np.int32(1)
            np.add.at(flat, place, np.repeat(times[part], n))


@dataclass
class Slots:
    """Opinions and levels of the slots of one table, both in one number; unpacks into an array of each."""

    packed: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Slots:
        x, level = opinion(counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32))
        return cls(np.rint(x * (SCALE / 9) + SCALE).astype(np.uint16) | level.astype(np.uint16) << LEVEL_BIT)

    def at(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the opinions above the least one, and levels."""
        met = self.packed.take(slot)
        return (met & np.uint16((1 << LEVEL_BIT) - 1)).astype(np.float32), met >> LEVEL_BIT

    def __iter__(self):
        steps, levels = self.at(np.arange(len(self.packed)))
        return iter((steps * (9 / SCALE) - 9, levels))


def without_own(counts: np.ndarray) -> np.ndarray:
    """(slot, bit): opinion and level of each slot, packed, once an outcome of that bit is taken out."""
    out = np.empty(counts.shape, np.uint16)
    for low in range(0, len(counts), 1 << 17):
        for bit in range(2):
            n = counts[low : low + (1 << 17)].astype(np.float32)
            n[:, bit] = np.maximum(0, n[:, bit] - 1)
            out[low : low + len(n), bit] = Slots.of(n).packed
    return out


def unpacked(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Opinions and levels of packed slots."""
    return (met & np.uint16((1 << LEVEL_BIT) - 1)).astype(np.float32) * np.float32(9 / SCALE) - np.float32(9), met >> LEVEL_BIT


@dataclass
class RunningModel:
    """The list, its code, exact predictions by gate and in all, the tables' opinions, and what mixes them.

    ``tables`` holds counts while weights are learnt, afterwards their opinions and levels.
    """

    number: dict[bytes, int]
    code: Code
    shares: np.ndarray
    prior: np.ndarray
    by_gate: np.ndarray
    in_all: np.ndarray
    size: int
    tables: list
    weights: np.ndarray
    apm: np.ndarray

    @classmethod
    def new(cls, words: list[bytes], by_gate: np.ndarray, prior: np.ndarray, size: int) -> RunningModel:
        """A model of listed words; ``by_gate`` has a row of counts for each, and one for the escape at the end."""
        code = Code.of(by_gate.sum(1) + 1)
        n = code.counts(by_gate)
        p = (n[:, 1].sum(1) + 0.4) / (n.sum((1, 2)) + 0.8)
        own = (n[:, 1] + 4 * p[:, None]) / (n.sum(1) + 4)
        smooth = by_gate.sum(1, keepdims=True) + 0.5
        share = 0.95 * by_gate / np.maximum(by_gate.sum(0), 1) + 0.05 * smooth / smooth.sum()
        weights = np.tile(np.array([0.4, 0.1, 0.3, 0.3, 0.0], np.float32), (by_gate.shape[1] * LEVELS * LEVELS, 1))
        apm = np.repeat(squash(np.linspace(-8, 8, APM_BINS))[None], DEPTHS, 0)
        return cls({w: i for i, w in enumerate(words)}, code, np.log(share), np.log(prior), stretch(own).T.astype(np.float32).copy(), stretch(p).astype(np.float32), size, [], weights, apm)

    @property
    def escape(self) -> int:
        return len(self.code.length) - 1

    def with_opinions(self, weights: np.ndarray, apm: np.ndarray) -> RunningModel:
        """The model for scoring, from the one with counts."""
        tables = [Slots.of(t) for t in self.tables]
        return RunningModel(self.number, self.code, self.shares, self.prior, self.by_gate, self.in_all, self.size, tables, weights, apm)

    def exact(self) -> np.ndarray:
        """Both exact predictions of each node in one number, gate by gate."""
        return np.stack((self.by_gate, np.broadcast_to(self.in_all, self.by_gate.shape)), -1).view(np.complex64).reshape(-1)

    def log_shares(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithm of the probability of each token given those before it in its text, and its gate.

        What follows the same two tokens under the same gate is worked out once.
        """
        gates = gates_before(symbols, sizes, self.shares, self.prior)
        one, two = before(symbols, sizes, len(self.code.length))
        first, run = alike(one, two, symbols, gates)  # in the order of the last token, so that slots read one after another are often the same
        symbol, gate, seen = symbols[first], gates[first], hashed(one[first], two[first])
        out = np.empty(len(first))
        logs = np.ascontiguousarray(refined_logs(self.apm, 1e-6).transpose(0, 2, 1), np.float32).reshape(-1)
        # opinions are read as whole steps from the least one, so their weights and the constant are changed to suit
        constant = self.weights[:, 4] - 9 * (self.weights[:, 2] + self.weights[:, 3])
        scale = np.array([1, 1, 9 / SCALE, 9 / SCALE], np.float32)
        # what is read together stands in one number: here four weights
        weights = np.ascontiguousarray(self.weights[:, :4] * scale).view(np.complex128).reshape(-1)
        nodes, exact = self.by_gate.shape[1], self.exact()
        for low in range(0, len(first), BLOCK):
            part = slice(low, low + BLOCK)
            n, way = self.code.ways(symbol[part])
            step = self.code.packed.take(way)
            node, chosen = step >> np.int32(DEPTH_BITS + 1), np.repeat(gate[part].astype(np.uint8), n)
            x = np.empty((len(way), INPUTS - 1), np.float32)
            x.view(np.complex64)[:, 0] = exact.take(np.repeat(gate[part] * nodes, n) + node)
            for k, (table, context) in enumerate(zip(self.tables, seen, strict=True)):
                x[:, 2 + k], level = table.at(slots(np.repeat(context[part], n), node, self.size))
                chosen *= np.uint8(LEVELS)
                chosen += level.astype(np.uint8)
            chosen = chosen.astype(np.int64)
            x *= weights.take(chosen).view(np.float32).reshape(-1, INPUTS - 1)
            z = constant.take(chosen)
            for k in range(INPUTS - 1):
                z += x[:, k]
            line = step_of(z)
            line += (step & np.int32(2 * DEPTHS - 1)) * np.int32(GRID)
            out[part] = np.add.reduceat(logs.take(line), np.cumsum(n) - n)
        return out[run], gates

    def inputs(self, exact: np.ndarray, minus: list[np.ndarray], symbols: np.ndarray, gates: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Both exact predictions and the opinions of both tables on every decision, then its cell, and its depth and bit in one number."""
        n, way = self.code.ways(symbols)
        step = self.code.packed.take(way)
        node, bit, cell = step >> np.int32(DEPTH_BITS + 1), (step & np.int32(1)).astype(np.uint32), np.repeat(gates.astype(np.uint8), n)
        both = exact.take(np.repeat(gates * self.by_gate.shape[1], n) + node)
        out = [both.real.copy(), both.imag.copy()]
        for table, context in zip(minus, hashes, strict=True):
            place = slots(np.repeat(context, n), node, self.size)
            place <<= np.uint32(1)
            place += bit
            own, level = unpacked(table.take(place))
            out.append(own)
            cell *= np.uint8(LEVELS)
            cell += level.astype(np.uint8)
        return *out, cell, (step & np.int32(2 * DEPTHS - 1)).astype(np.uint8)

    def learn(self, parts, minus: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights learnt online on texts that the tables have counted, what they are known by, and hits and visits of the map.

        Each token's own counts are taken out of what it meets, since a text to be scored is not in the tables;
        ``minus`` holds the tables in the form of ``without_own``, if they were made before.
        """
        minus = [t.reshape(-1) for t in minus or [without_own(t) for t in self.tables]]
        weights, exact, bins = self.weights.astype(np.float64), self.exact(), self.apm.size
        curve, met, known = no_curve(weights), np.zeros(2 * bins), 0
        for symbols, sizes in parts:
            gates = gates_before(symbols, sizes, self.shares, self.prior)
            hashes = contexts(symbols, sizes, len(self.code.length))
            low = 0
            while low < len(symbols):
                high = min(len(symbols), low + min(MOST_LEARN, max(LEARN, known // LEARN_PART)))
                cuts = [slice(k, min(high, k + READ)) for k in range(low, high, READ)]
                *x, cell, line = (np.concatenate(c) for c in zip(*(self.inputs(exact, minus, symbols[c], gates[c], [h[c] for h in hashes]) for c in cuts), strict=True))
                order, z = learn(weights, curve, x, cell, line & np.uint8(1))
                line = line.take(order)
                at = bin_of(z) + (line >> np.uint8(1)).astype(np.int32) * np.int32(APM_BINS)
                met += np.bincount(2 * at + (line & np.uint8(1)), minlength=2 * bins)
                low, known = high, known + high - low
        met = met.reshape(*self.apm.shape, 2)
        return weights, curve, met[..., 1], met.sum(-1)
