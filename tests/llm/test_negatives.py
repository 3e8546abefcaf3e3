import math
import random

import numpy as np
import pytest

from millrace.llm import negatives as neg


def plain(rows, every, n_pos, n_neg, low, high):
    """All products as whole numbers, by definition."""
    use = []
    for k, (i, v, l) in enumerate(rows):
        if l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((k, i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i is not None and i % 7 == 0 else l))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, i, q, l in use:
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(q, p)), j, m == l) for o, j, p, m in use if o != k]
        for s, p, _ in sorted((x for x in scores if x[2]), key=order)[:n_pos]:
            fit = sorted((x for x in scores if not x[2] and low * s <= 100 * x[0] <= high * s), key=order)[:n_neg]
            out += [(i, p, r + 1, x[1], s, x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=str)


def data(rng, n, width, scale=0.3, labels=3):
    centre = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(labels)]
    return [(k, [c + rng.gauss(0, scale) for c in centre[rng.randrange(labels)]], rng.randrange(labels)) for k in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, neg.hard_negatives(frame, **options).collect()), key=str)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


@pytest.mark.parametrize("scale,rows,anchors,block,sparse", [(0.3, 1024, 1024, 1 << 15, 32), (0.3, 16, 3, 4, 2), (40.0, 64, 8, 1 << 15, 8), (4e4, 64, 8, 5, 10**9), (0.01, 32, 1024, 1 << 15, 1)])
def test_equals_all_products(spark, monkeypatch, scale, rows, anchors, block, sparse):
    monkeypatch.setattr(neg, "ROWS", rows), monkeypatch.setattr(neg, "ANCHORS", anchors), monkeypatch.setattr(neg, "BLOCK_ANCHORS", block), monkeypatch.setattr(neg, "SPARSE", sparse)
    table = as_float(data(random.Random(rows), 300, 12, scale))
    want = plain(table, 10, 4, 3, 30, 95)
    assert len(want) > 20 and run(spark, table, every=10, positives=4, negatives=3, low=30, high=95) == want


def test_nulls_ties_repeats_and_lengths(spark):
    rng = random.Random(3)
    table = as_float(data(rng, 120, 5))
    table += [table[10], table[20], (None, table[3][1], 1), (None, table[4][1], 2), (50, None, 1), (51, [0.1, None], 1), (52, [math.nan], 2), (53, [math.inf, 0.0], 0), (54, table[1][1], None)]
    table += [(200, [], 1), (201, [0.5], 1), (202, [0.5, 0.25, 0.0, 0.1, 0.2, 0.9], 2), (203, [0.5] * 9, 1)] + [(300 + k, table[10][1], k % 3) for k in range(40)]
    table = as_float(table)
    assert run(spark, table, every=10) == plain(table, 10, 5, 3, 50, 95)


def test_one_label_and_empty(spark):
    table = as_float(data(random.Random(1), 60, 6, labels=1))
    assert run(spark, table, every=50) == plain(table, 50, 5, 3, 50, 95)
    assert run(spark, [(1, [1.0], 1)], every=50) == [] and run(spark, [(50, [1.0], 1)], every=50) == []
    assert neg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planes_bound_every_score():
    """Whatever is dropped on the way lies outside the bounds."""
    rng = np.random.default_rng(2)
    for top in (3, 200, 60_000, 1 << 26):
        q, a = rng.integers(-top, top, (50, 8)), rng.integers(-top, top, (20, 8))
        exact = q @ a.T
        least, greatest = np.full(20, int(np.quantile(exact, 0.8))), np.full(20, int(np.quantile(exact, 0.97)))
        r, c, s = neg.Planes(a).pairs(q, np.ones((50, 20), bool), least, greatest, slice(0, 20))
        assert sorted(zip(r, c, s)) == sorted((i, j, exact[i, j]) for i, j in np.ndindex(50, 20) if least[j] <= exact[i, j] <= greatest[j])
