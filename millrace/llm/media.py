"""Texts as lossless images in a column, and images back to arrays of pixels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import lean, steps, text_bytes

#: Samples of a row, and rows of an image; a longer payload goes on in further images behind the first.
WIDTH, ROWS = 64, 64
#: Bytes of text whose images are read back in step.
STEP = 4 << 20
RESULT = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"
IMAGES = "array<struct<width:int,height:int,argb:binary>>"


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with zeros up to a positive multiple of WIDTH, and the new offsets."""
    n = np.diff(offsets)
    size = np.maximum(1, -(-n // WIDTH)) * WIDTH
    new = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(new[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(new[:-1] - offsets[:-1], n)] = data
    return out, new


def store(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A media value for each payload: one file, or several of ROWS rows one behind another."""
    count = -(-np.diff(offsets) // (WIDTH * ROWS))
    cuts = np.repeat(offsets[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WIDTH * ROWS
    streams = webp.encode_texts(data, np.concatenate((cuts, offsets[-1:])), WIDTH)
    ends = np.cumsum(count).tolist()
    return [b"".join(map(webp.wrap, streams[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def load(media: list[bytes]) -> list[bytes]:
    """The payload of each media value."""
    parts = [webp.files(m) for m in media]
    samples = iter(webp.decode_texts([s for p in parts for s in p]))
    return [b"".join(next(samples).tobytes() for _ in p) for p in parts]


def feature(payload: bytes) -> str:
    """Figures of the samples: rows, sum, sum of steps to the right and down, and how many values occur."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    return f"{len(x)}:{x.sum()}:{np.abs(np.diff(x, axis=1)).sum()}:{np.abs(np.diff(x, axis=0)).sum()}:{np.count_nonzero(np.bincount(x.ravel(), minlength=256))}"


def _stored(text: pa.Array) -> pa.Array:
    return pa.array([m for part in steps([pa.RecordBatch.from_arrays([text], ["text"])]) for m in store(*payloads(*text_bytes(part.column("text"))))], pa.binary())


def _opened(media: pa.Array) -> pa.Array:
    out = []
    for m in media.to_pylist():
        images = [webp.decode(s) for s in webp.files(m)] if m is not None else None
        out.append(images and [{"width": x.shape[1], "height": x.shape[0], "argb": x.tobytes()} for x in images])
    return pa.array(out, pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])))


def encode_text(text: Column) -> Column:
    """Binary media of a text; null counts as empty."""
    return F.arrow_udf(_stored, "binary")(F.coalesce(text, F.lit("")))


def pixel_arrays(media: Column) -> Column:
    """The images of a media value, four bytes a pixel; null stays null, and anything else than lossless WebP is an error."""
    return F.arrow_udf(_opened, IMAGES)(media)


def _checked(text: pa.Array) -> pa.Array:
    rows = []
    for part in steps([pa.RecordBatch.from_arrays([text], ["text"])], STEP):
        n, media = [], []
        for small in steps([part], 1 << 20):
            data, offsets = text_bytes(small.column("text"))
            n += np.diff(offsets).tolist()
            media += store(*payloads(data, offsets))
        for size, m, back in zip(n, media, load(media), strict=True):
            rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(back)))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row of docs (doc_id, text, …).

    Each text is stored, and all figures of the payload come from the stored
    bytes read back. A null text counts as empty and has 64 zeros. Rows are
    independent of one another, so repeated rows and null ids need no care; a
    very long text is several images. Other columns are not read. An empty table
    gives no rows.
    """
    found = lean(docs).select("doc_id", F.arrow_udf(_checked, RESULT)(F.coalesce(F.col("text"), F.lit(""))).alias("m"))
    return found.select("doc_id", "m.*")
