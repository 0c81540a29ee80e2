"""Texts as lossless WebP images: stored, read back, and measured.

A payload is the UTF-8 bytes of a text with bytes 0 up to a positive multiple of 64. It becomes 8-bit samples in rows
of 64, in one image for each mebibyte; the files of a payload follow one another. Decoding gives the pixel arrays back,
and with them the payload, bit by bit.

Defined cases: a null or empty text is a payload of 64 bytes 0; equal texts give equal files and features; repeated rows
are stored each; texts of any length are taken whole, an image at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstore.llm import webp
from foldstore.llm.runtime import small_batches, tidy

ROW, IMAGE = 64, 1 << 20


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW if text else ROW)


def store(payload: bytes) -> bytes:
    """The WebP files of a payload, one after the other."""
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(webp.encode_samples(samples[k : k + IMAGE].reshape(-1, ROW)) for k in range(0, len(samples), IMAGE))


def load(media: bytes) -> list[np.ndarray]:
    """The sample arrays of the files."""
    return [webp.decode_samples(f) for f in webp.split(media)]


def feature(images: list[np.ndarray]) -> str:
    """Size, mean and deviation of the samples, and their shares in sixteen bands, in thousandths."""
    counts = sum(np.bincount(x.ravel(), minlength=256) for x in images)
    n, values = int(counts.sum()), np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt(max(0.0, (counts * values**2).sum() / n - mean * mean)))
    bands = counts.reshape(16, 16).sum(1) * 1000 // n
    return f"{ROW}x{n // ROW};mean={mean:.3f};sd={deviation:.3f};bands={'.'.join(map(str, bands))}"


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure(text: bytes) -> tuple:
    media = store(padded(text))
    images = load(media)
    back = b"".join(x.tobytes() for x in images)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)


def round_trip(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and what its text's stored form gives back."""
    small_batches(docs.sparkSession, 500)
    whole = docs.select(*keep, F.col("text").alias("media_text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(b.num_columns - 1)]
            cols = zip(*got, strict=True) if got else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*b.schema.names[:-1], *names])

    schema = whole.drop("media_text").schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split())
    return whole.mapInArrow(tidy(run), schema)


def images(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The stored form itself: a row for each image of each text, with its size, file and samples."""
    small_batches(docs.sparkSession, 500)
    whole = docs.select(*keep, F.col("text").alias("media_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = b.column(b.num_columns - 1)[k]
                files = webp.split(store(padded(t.as_buffer().to_pybytes() if t.is_valid else b"")))
                arrays = [webp.decode_samples(f) for f in files]
                n = len(files)
                kept = [pa.array([c[k].as_py()] * n, c.type) for c in b.columns[:-1]]
                more = [pa.array(range(n), pa.int32()), pa.array([x.shape[1] for x in arrays], pa.int32()), pa.array([x.shape[0] for x in arrays], pa.int32()), pa.array(files, pa.binary()), pa.array([x.tobytes() for x in arrays], pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *more], [*b.schema.names[:-1], "image", "width", "height", "file", "samples"])

    schema = whole.drop("media_text").schema
    for name, kind in (("image", "integer"), ("width", "integer"), ("height", "integer"), ("file", "binary"), ("samples", "binary")):
        schema = schema.add(name, kind)
    return whole.mapInArrow(tidy(run), schema)
