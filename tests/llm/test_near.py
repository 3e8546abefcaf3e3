import re

import duckdb
import pytest

from millrace.llm.near import near_duplicates
from millrace.llm.queries import op8_minhash_near_dedup

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {d: shingle_set(t, width) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = {(a, b) for ds in by.values() if len(ds) < 400 for a in ds for b in ds if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_matches_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op8_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_large_group_of_near_copies(spark, width, percent):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "ONE"), (5, "one two")]
    for d in range(10, 700):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, label string")
    want = brute([(d, t) for d, t in rows], width, percent)
    sets = {d: shingle_set(t, width) for d, t in rows}
    ids = [d for d, _ in rows]
    label = {d: d for d in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, width, percent).collect()}
    assert got == {d: root(d) for d in ids} and len(want) == len(got)


def test_edges(spark):
    schema = "doc_id long, text string, star long, comp string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1, None), (7, "a b c d e f", 1, None), (7, "a b c d e f", 1, None), (9, "A B c d e f", None, "x"), (8, "", 1, "y")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("7", 7, True), ("7", 7, True), ("8", 8, True), ("9", 7, False), ("None", None, True)]
