import hashlib
import random

import duckdb
import pytest

from millrace.llm.queries import op1_suffix_array_dedup
from millrace.llm.repeats import repeats


def brute(docs, length=100):
    """docs: (doc_id, bytes) in corpus order."""
    seen, out = set(), []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    got = sorted(map(tuple, op1_suffix_array_dedup(spark, "/root/testdata/sf0.01").collect()), key=str)
    want = brute([(d, t.encode()) for d, t in docs])
    assert got == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed", range(3))
def test_made_up_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcd" if seed else "ab") for _ in range(n))
    passages = [word(n) for n in (32, 60, 99, 100, 101, 150, 400)] + ["ab" * 200, "x" * 500, "é" * 90]
    docs = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(1, 140)) for _ in range(rng.randrange(0, 8))]
        docs.append((d, "".join(parts)))
    docs += [(120 + k, docs[rng.randrange(120)][1]) for k in range(40)]
    shuffled = docs[:]
    rng.shuffle(shuffled)
    got = sorted(map(tuple, repeats(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert got == brute([(d, t.encode()) for d, t in docs])


def test_common_line(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = word(70)
    docs = [(d, word(60) + line + word(80) + (line + word(3) if d % 3 else "")) for d in range(300)]
    got = sorted(map(tuple, repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute([(d, t.encode()) for d, t in docs])


def test_edges(spark):
    schema = "doc_id long, text string, d int, key string"
    assert repeats(spark.createDataFrame([], schema)).count() == 0
    long = "0123456789" * 30_000
    rows = [(None, "z" * 120, 1, None), (None, None, None, None), (1, "", 1, "x"), (2, long, None, None), (3, "z" * 101, None, None), (3, "z" * 101, None, None), (3, "z" * 99, None, None)]
    got = {}
    for r in repeats(spark.createDataFrame(rows, schema), with_text=True).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert sorted(got[None]) == [(0, 0, 0, b""), (120, 119, 1, b"z")] and got[1] == [(0, 0, 0, b"")]
    assert got[2] == [(300_000, 299_990, 1, b"0123456789")]
    assert sorted(got[3]) == [(99, 0, 0, b"z" * 99), (101, 101, 1, b""), (101, 101, 1, b"")]
