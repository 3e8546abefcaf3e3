import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import media, webp
from millrace.llm.queries import op9_media_columns
from pyspark.sql import functions as F


def image(rng, height, width, colours=None, alpha=True):
    if colours:
        table = rng.integers(0, 256, (colours, 4))
        return table[rng.integers(0, colours, (height, width))]
    x = rng.integers(0, 256, (height, width, 4))
    x[:, : width // 2] = x[:1, :1]
    if not alpha:
        x[..., 0] = 255
    return x


@pytest.mark.parametrize("seed", range(6))
def test_round_trips(seed):
    rng = np.random.default_rng(seed)
    for height, width in ((1, 1), (5, 7), (17, 33)):
        x = image(rng, height, width)
        tiles = (-(-height >> 2), -(-width >> 2))
        modes, factors = rng.integers(0, 14, tiles), rng.integers(0, 256, (*tiles, 4))
        for transforms in ((), (("subtract green",),), (("predictor", 2, modes),), (("cross colour", 2, factors),), (("predictor", 2, modes), ("cross colour", 2, factors), ("subtract green",))):
            for cache_bits, search in ((0, False), (3, False), (7, True), (0, True)):
                assert (webp.decode(webp.encode(x, transforms, cache_bits, search)) == x).all()
        for colours in (1, 2, 3, 11, 60):
            y = image(rng, height, width, colours)
            assert (webp.decode(webp.encode(y, (("palette",),), 4, True)) == y).all()


def test_known_file():
    """A 1x1 image written bit by bit: opaque, red 10, green 20, blue 30."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), *[p for s in (20, 10, 30, 255) for p in ((1, 1), (0, 1), (1, 1), (s, 8))], (1, 1), (0, 1), (0, 1), (0, 1)):
        w.write(v, n)
    assert webp.decode(w.bytes()).tolist() == [[[255, 10, 20, 30]]]


def test_groups_of_codes():
    """Two groups, chosen by a tile image, each with one pixel value."""
    w = webp.Writer()
    one = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]
    two = [(1, 1), (1, 1), (1, 1), (0, 8), (1, 8)]
    parts = [(0x2F, 8), (7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3), (0, 1), *two, *one(0), *one(0), *one(255), *one(0), (0, 1), (1, 1)]
    for g in (5, 9):
        parts += [*one(g), *one(1), *one(2), *one(255), *one(0)]
    for v, n in parts:
        w.write(v, n)
    assert webp.decode(w.bytes())[..., 2].tolist() == [[5] * 4 + [9] * 4] * 4


def test_bad_data():
    good = webp.encode(image(np.random.default_rng(1), 8, 8))
    for bad in (b"", good[:12], b"\0" + good[1:], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.files(webp.wrap(good)[:-9])


def test_near_table():
    assert len(webp.NEAR) == 120 and webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_fast_lane_is_the_same_format():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(64 * rng.randrange(1, 9))) for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    streams = webp.encode_texts(data, offsets)
    assert [s.tobytes() for s in webp.decode_texts(streams)] == texts
    for s, t in zip(streams, texts, strict=True):
        assert webp.decode(s)[..., 2].tobytes() == t and (webp.decode(s)[..., [0, 1, 3]] == [255, 0, 0]).all()
    mixed = [webp.encode(image(np.random.default_rng(3), 4, 64, alpha=False), (), 3, True), *streams[:3]]
    assert [s.tobytes() for s in webp.decode_texts(mixed)] == [webp.decode(s)[..., 2].tobytes() for s in mixed]


def test_forms_of_lanes():
    """Every form that texts are stored in, read back in lanes and by the general decoder."""
    rng = np.random.default_rng(8)
    period, ramp = rng.integers(0, 256, 64, dtype=np.uint8), np.arange(4096) // 3
    texts = [
        b"\0" * 64, b"ab" * 2048, bytes(rng.integers(0, 4, 4096, dtype=np.uint8)), bytes(rng.integers(0, 16, 1024, dtype=np.uint8)), bytes(rng.integers(0, 256, 4096, dtype=np.uint8)),
        (b"the same line of words again and again\n" * 120)[:4096], bytes(((ramp * ramp) & 255).astype(np.uint8)), bytes(np.cumsum(rng.integers(0, 3, 4096)).astype(np.uint8)),
        bytes((np.tile(period, 64) + np.repeat(np.arange(64), 64)).astype(np.uint8)), "я не знаю, как это будет по-русски, но надо ".encode() * 3 + b" " * 54, b"plain words that do not come back, " * 1 + b"." * 29,
    ]
    texts = [t + b"\0" * (-len(t) % 64) for t in texts]
    streams = webp.encode_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [s.tobytes() for s in webp.decode_texts(streams)] == texts
    assert [webp.decode(s)[..., 2].tobytes() for s in streams] == texts
    assert all((webp.decode(s)[..., [0, 1, 3]] == [255, 0, 0]).all() for s in streams)
    lanes = [webp._lane(s) for s in streams]
    known = [webp._known_lane(s) is not None for s in streams]
    assert any(known) and not all(known) and all(lanes) and sum(bool(lane.undo) for lane in lanes) >= 5
    assert any(lane.green.only is None and lane.green.symbol.max() > 255 for lane in lanes)
    for s in streams:  # an image alone is stored as it is among others
        assert webp.encode_texts(np.frombuffer(webp.decode(s)[..., 2].tobytes(), np.uint8), np.array([0, webp.decode(s)[..., 2].size])) == [s]


@pytest.mark.parametrize("seed", range(4))
def test_lanes_of_random_repetition(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [bytes(rng.randrange(97, 97 + rng.randrange(1, 26)) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 40))]
        t = b" ".join(rng.choice(words) for _ in range(rng.randrange(1, 600)))[:4096]
        texts.append(t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t)))
    streams = webp.encode_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [s.tobytes() for s in webp.decode_texts(streams)] == texts
    for s, t in zip(streams, texts, strict=True):
        assert webp.decode(s)[..., 2].tobytes() == t
        with pytest.raises(ValueError):
            webp.decode_texts([s[: max(6, len(s) * 2 // 3)]])


def test_a_megapixel_is_linear():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (1024, 1024, 4))
    x[512:] = x[:512, :, :] & 3
    modes = rng.integers(0, 14, (2, 2))
    stream = webp.encode(x, (("predictor", 9, modes), ("cross colour", 9, rng.integers(0, 256, (2, 2, 4))), ("subtract green",)), 8, True)
    began = time.process_time()
    assert (webp.decode(stream) == x).all()
    took = time.process_time() - began
    print("a megapixel takes", took)
    assert took < 40  # minutes, if a symbol cost more the longer the file is


def test_whole_table(spark):
    docs = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = op9_media_columns(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    print("media share", sum(r.media_bytes for r in rows) / sum(r.payload_bytes for r in rows))


def test_edges(spark):
    schema = "doc_id long, text string, media string, m int"
    assert media.media_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (1, "", "x", 1), (2, "é" * 40_000, None, 1), (2, "é" * 40_000, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = media.media_digests(docs).collect()
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(0, 64), (0, 64), (80_000, 80_000), (80_000, 80_000)] and got[2][1:] == got[3][1:]
    images = docs.select(media.pixel_arrays(media.encode_text(F.col("text"))).alias("i")).collect()
    assert [[(p.width, p.height) for p in r.i] for r in images][2] == [(64, 64)] * 19 + [(64, 34)]
    assert b"".join(bytes(p.argb)[2::4] for p in images[2].i).decode() == "é" * 40_000
