import hashlib
import math
import re

import pytest

from millrace.llm import mixture as mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def water(sizes, most):
    """Targets by sharing again what is above a cap, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return names, target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)


def plain(docs, most, slots, seed):
    """{(id, text, source): words taken}, slot by slot and word by word."""
    sizes, laid = {}, {}
    for i, text, source in docs:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        key = hashlib.md5(f"{seed}:{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        laid.setdefault(source, []).append((key, i, text, n))
    total = sum(sizes.values())
    names, target = water(sizes, most)
    block = max(1, math.ceil(total / slots))
    ends, run = [], 0.0
    for s in names:
        run += target[s]
        ends.append(round(run / total * 2**32))
    words = {s: [k for k, row in enumerate(sorted(laid[s], key=lambda r: r[0])) for _ in range(row[3])] for s in names}
    taken, used = {s: [0] * len(laid[s]) for s in names}, dict.fromkeys(names, 0)
    for slot in range(math.ceil(total / block)):
        point = slot * mix.GOLDEN % 2**32
        s = names[next(k for k, e in enumerate(ends) if point < e)]
        blocks = math.ceil(sizes[s] / block)
        if used[s] < most * blocks:
            b = used[s] % blocks
            for k in words[s][b * block : (b + 1) * block]:
                taken[s][k] += 1
        used[s] += 1
    out = [(row[1], row[2], s, taken[s][k]) for s in names for k, row in enumerate(sorted(laid[s], key=lambda r: r[0]))]
    return sorted(out, key=str), target, sizes


DOCS = [(i, "w " * (i * 7 % 40), ["a", "b", "ü", None, "a"][i % 5]) for i in range(120)] + [(1, "w " * 7, "b"), (None, None, "c"), (None, "x\ty z", None), (500, "q " * 3000, "big"), (501, "", "void")]


@pytest.mark.parametrize("most,slots,group", [(3, 1 << 18, 10_000), (3, 60, 4), (1, 500, 10)])
def test_equals_the_definition(spark, monkeypatch, most, slots, group):
    monkeypatch.setattr(mix, "GROUP_ROWS", group)
    docs = spark.createDataFrame([(*d, 9, "n") for d in DOCS], "doc_id long, text string, source string, size int, target string").repartition(3)
    want, target, sizes = plain(DOCS, most, slots, 11)
    got = mix.mixture(docs, most=most, slots=slots, seed=11).collect()
    text = {(d[0], len(WORD.findall(d[1] or "")), d[2]): d[1] for d in DOCS}
    assert sorted(((r.doc_id, text[r.doc_id, r.size, r.source], r.source, r.taken) for r in got), key=str) == want
    assert all(r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken <= most * r.size for r in got)
    block = mix.block_words(sum(sizes.values()), slots)
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 4 * block


def test_pieces_of_the_mix(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    pieces, taken = mix.mixed(docs, slots=200).collect(), {}
    block = mix.block_words(sum(len(WORD.findall(d[1] or "")) for d in DOCS), 200)
    for p in pieces:
        taken[p.doc_id, p.source] = taken.get((p.doc_id, p.source), 0) + p.n_words
    want = {}
    for r in mix.mixture(docs, slots=200).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    assert {k: v for k, v in want.items() if v} == taken
    by_slot = {}
    for p in sorted(pieces, key=lambda p: (p.slot, p.place)):
        at = by_slot.setdefault(p.slot, 0)
        assert p.place == at and p.first >= 0
        by_slot[p.slot] += p.n_words
    assert max(by_slot.values()) == block and max(by_slot) < 200


def test_empty(spark):
    docs = spark.createDataFrame([(1, "", "a"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mix.mixture(docs).where("doc_id = 1").collect()) == [(1, 0, 0, 0.0, 0)]
    assert mix.mixture(docs).count() == 2 and mix.mixed(docs).count() == 0 and mix.mixture(docs.limit(0)).count() == 0


def test_every_stretch_is_near_the_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    slots = sorted(mix.mixed(docs, slots=3000).select("slot", "source").distinct().collect())
    for low in range(0, 2900, 100):
        some = [r.source for r in slots[low : low + 100]]
        assert all(abs(some.count(s) - w * 100 / 6) < 4 for s, w in zip("abc", (1, 2, 3)))
