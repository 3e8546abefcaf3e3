import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import importance as imp

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, n, buckets, percent, least, seed):
    """The same by definition, one document at a time."""
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(words(text))))
    for text in target:
        t.update(map(bucket, runs(words(text))))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in docs:
        w = words(text)
        f = runs(w)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


DOCS = [(i, " ".join(f"W{(i * k) % 17}é-x{k % 5}" for k in range(i % 31))) for i in range(200)] + [(7, "same"), (7, "same"), (None, None), (None, "a b c " * 10), (None, "a b c " * 10), (300, ""), (301, "-- !"), (302, "Ab3 中文 ß" * 400)]
TARGET = ["W1é x2 w3é", None, "a b", ""]


@pytest.mark.parametrize("n,percent,least", [(1, 10, 20), (3, 50, 2), (2, 100, 0)])
def test_equals_the_definition(spark, n, percent, least):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, score int, row string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = imp.importance(docs, target, n=n, buckets=97, percent=percent, least_words=least, seed=5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(DOCS, TARGET, n, 97, percent, least, 5)


def test_ring_in_pieces_is_the_ring_at_once(monkeypatch):
    text = ("lorem ipsum 12 " * 50 + "x" * 100 + " é").encode()
    want = imp.Ring(4).feed(text.split())
    for step in (1, 7, 64):
        monkeypatch.setattr(imp, "STEP_BYTES", step)
        ring, got = imp.Ring(4), [[], [], [], []]
        for w in imp.word_steps(text):
            for k, s in enumerate(ring.feed(w)):
                got[k] += s.tolist()
        assert got == [s.tolist() for s in want]


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, i or 0, "x") for i, t in DOCS], "doc_id long, text string, score int, rank string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = imp.drawn(docs, target, n=2, buckets=97, percent=20, least_words=3)
    want = [r[0] for r in plain(DOCS, TARGET, 2, 97, 20, 3, 2024) if r[5]]
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(i, t) for i, t in DOCS], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert sorted(map(tuple, imp.importance(docs, target, buckets=97).collect()), key=str) == plain(DOCS, [], 1, 97, 10, 20, 2024)
    assert imp.importance(docs.limit(0), target).count() == 0
    assert {r.rank for r in imp.importance(docs, target, least_words=10**6).collect()} == {None}
