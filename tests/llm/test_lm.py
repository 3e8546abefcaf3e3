import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from millrace.llm import lm, mixing, running, words
from millrace.llm.queries import op6_lm_scoring

SF = "/root/testdata/sf0.01"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), " "]


def base(docs):
    train = Counter(t for d, text in docs if zlib.crc32(str(d).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    return {d: (len(w := tokens(text)), sum(train[t] > 0 for t in w), n, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in w)) for d, text in docs}


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = base(docs)
    rows = op6_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - score) < 1e-6 * abs(score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    held = [r for r in rows if r.held_out]
    per = lambda k: sum(getattr(r, k) for r in held) / sum(r.n_tokens for r in held)
    print("log10 a token, held out: model", per("score"), "base", per("base_score"), "better", np.mean([r.score > r.base_score for r in held]), "bits per byte", np.mean([r.bits_per_byte for r in held]))
    # a sixth of these tokens are new words: the base gives each the same share, the model spells them
    assert per("score") > per("base_score") and np.mean([r.score > r.base_score for r in held]) > 0.5


def test_bits_of_all_short_words_sum_to_one_at_most():
    tables = [np.zeros((1 << s, 2), np.int64) for s in lm.SIZES]
    words = [b"ab", b"ac", b"b"]
    lm.count_tables(words, np.ones((3, lm.GATES), np.int64), tables)
    tables = [t.astype(np.float32) for t in tables]
    model = lm.BitModel([lm.opinion(t[:, 0].astype(float), t[:, 1].astype(float)) for t in tables], lm.fit_mixer(tables, words * 50, np.zeros(150, int)))
    every = [bytes([a]) for a in range(256) if a != 32]
    first = 10 ** model.log10(every)[:, 0]
    assert first.sum() <= 1 + 1e-9 and model.log10(words)[:, 0].min() > model.log10([b"zz"])[0, 0]


def test_edges(spark):
    schema = "doc_id long, text string, c string, word string"
    assert lm.scores(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (1, "", "x", None), (2, "A a b", None, "w"), (2, "A a b", None, "w"), (3, "long " * 100_000, None, None), (10, "b c", None, None)]
    got = lm.scores(spark.createDataFrame(rows, schema)).collect()
    want = {}
    train = Counter(t for d, text, *_ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    assert len(got) == 6 and {r.train_tokens for r in got} == {n}
    for d, text, *_ in rows:
        want[d] = (len(tokens(text)), sum(train[t] > 0 for t in tokens(text)), sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens(text)))
    assert all((r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6 * abs(want[r.doc_id][2]) + 1e-9 for r in got)


def small_model(rng):
    """A model of five words and an escape, learnt from texts where each word is mostly followed by the next."""
    words = [b"a", b"b", b"c", b"d", b"e", running.END]
    texts = [b" ".join([b"a", b"b", b"c", b"d", b"e", b"new"][(k + int(rng.integers(2))) % 6] for k in range(int(rng.integers(1, 30)))) for _ in range(60)]
    number = {w: i for i, w in enumerate(words)}
    _, symbols, sizes = running.numbered(texts, number, len(words))
    by_gate = np.stack([np.bincount(symbols, minlength=len(words) + 1) for _ in range(lm.GATES)], 1) * rng.uniform(0.5, 2, (len(words) + 1, lm.GATES))
    model = running.RunningModel.new(words, by_gate, np.full(lm.GATES, 1 / lm.GATES), 12)
    model.tables = [np.zeros((1 << 12, 2), np.uint16) for _ in range(running.ORDERS)]
    running.count(model.code, symbols, sizes, 12, model.tables)
    weights, _, hits, met = model.learn([(symbols, sizes)])
    return model.with_opinions(weights.astype(np.float32), (8 * model.apm + hits) / (8 + met)), symbols, sizes


def test_running_shares_sum_to_one_and_use_the_last_token():
    model, symbols, sizes = small_model(np.random.default_rng(1))
    history = [0, 1, 2]
    every = [model.log_shares(np.array([*history, x]), np.array([4]))[0][-1] for x in range(7)]
    assert abs(np.exp(every).sum() - 1) < 1e-6
    after = lambda h, x: model.log_shares(np.array([*h, x]), np.array([len(h) + 1]))[0][-1]
    assert after([1, 2], 3) > after([1, 4], 3)


def test_running_shares_token_by_token(monkeypatch):
    """Against a plain walk down the code of one token after another, over texts longer than a block."""
    model, symbols, sizes = small_model(np.random.default_rng(2))
    want, at = [], 0
    code, flat = model.code, lambda x: 1 / (1 + math.exp(-x))
    for n in sizes.tolist():
        text, belief = symbols[at : at + n].tolist(), model.prior.copy()
        at += n
        for i, x in enumerate(text):
            gate = int(belief.argmax())
            one, two = (text[i - 1] if i > 0 else 7), (text[i - 2] if i > 1 else 7)
            seen = running.contexts(np.array([two, one, x]), np.array([3]), 7) if i > 1 else running.contexts(np.array([one, x]) if i else np.array([x]), np.array([2 if i else 1]), 7)
            total = 0.0
            for depth in range(code.length[x]):
                node, bit = int(code.node[code.first[x] + depth]), int(code.bit[code.first[x] + depth])
                inputs, levels = [float(model.by_gate[gate, node]), float(model.in_all[node])], []
                for (opinions, level), context in zip(model.tables, seen, strict=True):
                    slot = int(running.slots(context[-1:], np.array([node]), model.size)[0])
                    inputs.append(float(opinions[slot]))
                    levels.append(int(level[slot]))
                weights = model.weights[(gate * lm.LEVELS + levels[0]) * lm.LEVELS + levels[1]]
                z = max(-12.0, min(12.0, sum(w * v for w, v in zip(weights.tolist(), [*inputs, 1.0], strict=True))))
                z = (math.floor((max(-11.99, min(11.99, z)) + 12) * mixing.GRID / 24) + 0.5) * 24 / mixing.GRID - 12
                place = (max(-7.999, min(7.999, z)) + 8) * 2
                row = model.apm[min(depth, running.DEPTHS - 1)]
                p = (flat(z) + row[int(place)] * (1 - place % 1) + row[int(place) + 1] * (place % 1)) / 2
                p = min(1 - 1e-6, max(1e-6, p))
                total += math.log(p if bit else 1 - p)
            want.append(total)
            belief = belief + model.shares[x]
    whole, _ = model.log_shares(symbols, sizes)
    monkeypatch.setattr(running, "BLOCK", 7)
    parts, _ = model.log_shares(symbols, sizes)
    assert np.allclose(whole, want, atol=0.01) and np.allclose(parts, whole, atol=1e-9)


def test_words_that_begin_alike_are_scored_as_alone():
    rng = np.random.default_rng(8)
    words = sorted({bytes(rng.integers(97, 100, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(300)} | {b"a\xc3\xa9", b"a" * 5000})
    tables = [(rng.normal(size=1 << s).astype(np.float32), rng.integers(0, mixing.LEVELS, 1 << s).astype(np.int8)) for s in lm.SIZES]
    model = lm.BitModel(tables, lm.Mixer.new())
    assert np.allclose(model.log10(words), np.concatenate([model.log10([w]) for w in words]), rtol=1e-5)


def test_slots_keep_opinions_and_levels():
    counts = np.random.default_rng(5).integers(0, 1 << 16, (4000, 2)) >> np.random.default_rng(6).integers(0, 17, (4000, 2))
    counts[0] = 0
    x, level = mixing.opinion(counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32))
    got, got_level = running.Slots.of(counts)
    assert np.abs(got - x).max() <= 9 / running.SCALE and got[0] == 0 and (got_level == level).all()


def test_alike_finds_runs_of_equal_rows():
    columns = np.random.default_rng(7).integers(0, 3, (4, 500)).astype(np.int64)
    first, run = running.alike(*columns)
    assert (columns[:, first][:, run] == columns).all() and len(first) == len(set(zip(*columns.tolist(), strict=True)))


def test_code_is_free_of_prefixes_and_of_least_length():
    weights = np.array([8, 1, 1, 2, 4, 16, 1])
    code = running.Code.of(weights)
    ways = ["".join(map(str, code.bit[f : f + n])) for f, n in zip(code.first, code.length, strict=True)]
    assert not any(a != b and b.startswith(a) for a in ways for b in ways) and abs(sum(2.0 ** -len(w) for w in ways) - 1) < 1e-12
    assert sum(w * len(c) for w, c in zip(weights, ways, strict=True)) == 69


def test_gates_and_weights_are_learnt_from_all_training_documents(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id, ' of ', id % 7, ' a b') as text")
    train = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in range(4000))
    met = {}
    for name in ("fit_gates", "fit_running", "fit_spelling"):
        def spy(frame, *args, name=name, real=getattr(lm, name, None)):
            met[name] = frame.count()
            return real(frame, *args)

        monkeypatch.setattr(lm, name, spy, raising=False)
    assert lm.scores(docs).count() == 4000
    assert met == {"fit_gates": train, "fit_running": train, "fit_spelling": train + 3 + 7}  # words of their own, "of", "a", "b" and seven numbers


def test_one_document_of_many_moves_a_gate(spark):
    rows = [(f"{'the of and' if k % 2 else 'le la et'} x{k % 50}",) for k in range(3000)]
    want = lm.fit_gates(spark.createDataFrame(rows, "text string").coalesce(1))
    for k in (0, 1501, 2999):
        other = [*rows[:k], ("quite another text",), *rows[k + 1 :]]
        assert not np.array_equal(want, lm.fit_gates(spark.createDataFrame(other, "text string").coalesce(1)))


def test_opinions_without_own_outcome():
    counts = np.random.default_rng(9).integers(0, 40, (2000, 2)).astype(np.uint16)
    minus = running.without_own(counts)
    for bit in range(2):
        less = counts.astype(np.float32)
        less[:, bit] = np.maximum(0, less[:, bit] - 1)
        x, level = mixing.opinion(less[:, 0], less[:, 1])
        own, own_level = running.unpacked(minus[:, bit])
        assert np.abs(own - x).max() <= 9 / running.SCALE and (own_level == level).all()


def test_a_way_meets_few_groups_of_slots():
    code = running.Code.of(1e6 / np.arange(1, 5001))
    for symbol in range(0, 5000, 7):
        node = code.node[code.first[symbol] + np.arange(code.length[symbol])]
        met = running.slots(np.array([12345], np.uint32), node, 22)
        assert len(set(met.tolist())) == len(node) and len(set((met >> 4).tolist())) <= 2 * -(-len(node) // 4)


def test_words_are_cut_like_bytes():
    texts = [b"", b" \t", b"A b\x0bC\x1cd\r\nE", b"\xc3\x89t\xc3\xa9 \xff\xfeX \xc2\xa0", b" x "]
    flat, sizes = words.cut_words(pa.array(texts, pa.binary())[1:])
    assert flat.to_pylist() == [w for t in texts[1:] for w in t.lower().split()] and sizes.tolist() == [len(t.split()) for t in texts[1:]]
    assert words.cut_words(pa.array(["", "\n"], pa.large_string()))[1].tolist() == [0, 0]


def test_learning_in_parts_is_like_learning_in_one(monkeypatch):
    """Two learners, each on half of the bits, come together to nearly the weights that all bits give."""
    monkeypatch.setattr(mixing, "HOLD", 8.0)
    rng = np.random.default_rng(3)
    x = [rng.normal(size=40_000).astype(np.float32) for _ in range(2)]
    bit = (rng.random(40_000) < mixing.squash(1.5 * x[0] - 0.5 * x[1] + 0.3)).astype(np.int64)

    def learnt(places):
        weights = np.zeros((2, 3))
        curve = mixing.no_curve(weights)
        for low in range(0, len(places), 1000):
            at = places[low : low + 1000]
            mixing.learn(weights, curve, [c[at] for c in x], (at % 2).astype(np.uint8), bit[at])
        return weights, curve

    weights, curves = zip(learnt(np.arange(20_000)), learnt(np.arange(20_000, 40_000)))
    whole, _ = learnt(np.arange(40_000))
    assert np.abs(whole - [1.5, -0.5, 0.3]).max() < 0.1 and np.abs(mixing.merged(np.array(weights), np.array(curves)) - whole).max() < 0.05
