import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.queries import op5_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "It's we'll DON'T they're I'd", "a''s !'s ''", "naïve Öl ½ x² 3.14 ﬁ", "İstanbul ΑΣ Σ", "tab\tnew\nline\x1cx\x85y\xa0z", "<|endoftext|> a <|startoftext|>", "中文 text", "é é", "a_b__c", "ª º µ ǅ", "​ ﻿"]


def test_words_encode_like_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    texts = ODD + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    rng = random.Random(1)
    texts += ["".join(chr(rng.randrange(1, 0x260)) for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choice("ab's 're12 !.'É") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(texts, packing.Encoder(PATH)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_every_code_point_inside_plain_text():
    t, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}ata is{c}on a {c} b{c}" for c in chars]
    for text, ids, want in zip(texts, encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    t, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(encode.young) <= 80 and len(encode.old) <= 80


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in places) <= 2
    return len(by)


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 200)))}
    bins, placed = Counter(), Counter()
    for length, first, n, per, base, at in packing.plan(counts, capacity):
        assert first == placed[length] and at + per * length <= capacity
        placed[length] += n
        for i in range(n):
            assert bins[base + i // per] == at + i % per * length
            bins[base + i // per] += length
    assert placed == Counter(counts) and max(bins.values()) <= capacity
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= 11 / 9 * max(total / capacity, sum(c for n, c in counts.items() if 2 * n > capacity)) * 1.3 + 2


def test_whole_table(spark):
    t = Tokenizer.from_file(PATH)
    docs = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = op5_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    n = check(rows, 2048)
    total = sum(r.length for r in rows)
    print("sequences", n, "lower bound", -(-total // 2048))
    assert n <= 1.02 * total / 2048 + 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == docs.keys()
    for d, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[d], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]


def test_edges(spark):
    schema = "doc_id long, text string, length string, n int"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(None, None, None, None), (1, "", "x", 1), (2, "word " * 50_000, None, 1), (3, "a b", None, 1), (3, "a b", None, 1)]
    got = packing.pack(spark.createDataFrame(rows, schema), PATH, with_ids=True).collect()
    check(got, 2048)
    assert Counter(r.doc_id for r in got) == {None: 1, 1: 1, 2: 25, 3: 2} and all(len(r.ids) == r.length for r in got)
