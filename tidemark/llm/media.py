"""Media columns: payloads kept as lossless WebP images and read back as pixel arrays.

A payload (bytes) becomes an image of 8-bit R, G, B, A samples, WIDTH pixels a row; longer
payloads get a multiple of that width, so that one image holds up to 1 GB.  Images are made in
tasks, written to the shared folder as a binary column, read back from there, decoded to pixels,
and described.

Defined cases: null text is an empty payload; payloads are filled up with bytes 255 to a positive
multiple of ROW (and whole rows), and payload_bytes tells how many of the samples count; equal
texts give equal images; an empty table gives an empty table.  Columns pass through; those
named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c
from . import webp

ROW = 576
WIDTH = ROW // 4


def to_pixels(text: bytes) -> tuple[np.ndarray, int]:
    """The image of a payload, and the payload's bytes (filled up to a multiple of ROW)."""
    size = max(1, -(-len(text) // ROW)) * ROW
    width = WIDTH * -(-size // (ROW * webp.SIDE))
    if width > webp.SIDE:
        raise ValueError("a payload of more than 1 GB needs several images")
    height = -(-size // (4 * width))
    raw = text + b"\xff" * (4 * width * height - len(text))
    return np.frombuffer(raw, np.uint8).reshape(height, width, 4), size


def _fields(part: pa.RecordBatch, **new) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: part.column(i) for i, n in enumerate(part.schema.names)} | new)


def _store(column: str):
    def run(batches):
        for part, raw in c.blocks(batches, column):
            media, sizes = [], []
            for x in raw:
                pixels, size = to_pixels(x)
                media.append(webp.encode(pixels))
                sizes.append(size)
            part = part.drop_columns([column])
            yield _fields(part, n_bytes=pa.array([len(x) for x in raw], pa.int64()), payload_bytes=pa.array(sizes, pa.int64()), media=pa.array(media, pa.binary()))

    return run


def store(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with n_bytes, payload_bytes and media (WebP) in the place of a text column, written to the shared folder."""
    docs = docs.drop("n_bytes", "payload_bytes", "media")
    c.small_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != column]
    kind = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return c.save(docs.mapInArrow(_store(column), kind), "uncompressed")


def _describe(pixels: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and an average hash: 64 bits, whether a part of the samples is above the mean."""
    flat = pixels.reshape(-1, 4)
    sums = flat.sum(0, dtype=np.int64)
    bounds = np.linspace(0, flat.size, 65).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat.ravel(), dtype=np.int64)])
    part = np.diff(total[bounds]) * flat.size > sums.sum() * np.diff(bounds)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{','.join(str(int(x) * 1000 // len(flat)) for x in sums)};{np.packbits(part).tobytes().hex()}"


def _read(keep_pixels: bool):
    def run(batches):
        for part, raw in c.blocks(batches, "media"):
            sizes = part.column(part.schema.get_field_index("payload_bytes")).to_pylist()
            digest, tail, media, feature, kept = [], [], [], [], []
            for x, size in zip(raw, sizes, strict=True):
                pixels = webp.decode(x)
                payload = np.ascontiguousarray(pixels).tobytes()[:size]
                digest.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-32:]))
                media.append(hashlib.sha256(x).hexdigest())
                feature.append(_describe(pixels))
                kept.append(payload if keep_pixels else None)
            new = {"payload_sha256": pa.array(digest), "tail_crc32": pa.array(tail, pa.int64()), "media_bytes": pa.array([len(x) for x in raw], pa.int64()), "media_sha256": pa.array(media), "feature": pa.array(feature)}
            if keep_pixels:
                new["pixels"] = pa.array(kept, pa.binary())
            yield _fields(part.drop_columns(["media"]), **new)

    return run


def read(stored: DataFrame, pixels: bool = True) -> DataFrame:
    """What the stored images hold: digests and a feature, and (if asked for) the samples as a binary column."""
    names = [("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    if pixels:
        names.append(("pixels", T.BinaryType()))
    kind = T.StructType([*[f for f in stored.schema.fields if f.name != "media"], *[T.StructField(n, k) for n, k in names]])
    return stored.drop(*[n for n, _ in names]).mapInArrow(_read(pixels), kind)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(store(docs), pixels=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
