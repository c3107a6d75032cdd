"""Media columns: texts stored as lossless WebP images, and pixels and features read back from them.

A payload is the text's UTF-8 bytes with blanks up to a positive multiple of
192: rows of 64 pixels of three bytes.  Payloads higher than an image may be are
stored as several files one after the other.  Null and empty texts are one row
of blanks; equal texts give equal bytes and features.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import portions

ROW = 192


def to_media(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return b"".join(webp.encode(rows[i : i + webp.MAX_SIDE]) for i in range(0, len(rows), webp.MAX_SIDE))


def files_of(media: bytes) -> list[bytes]:
    """The files in ``media``, one after the other."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def to_pixels(media: bytes) -> np.ndarray:
    """The pixels (height, width, 3) of the files in ``media``, one below the other."""
    return np.concatenate([webp.decode(x)[0][..., :3] for x in files_of(media)])


def many_pixels(media: list[bytes], known: webp.Known) -> list[np.ndarray]:
    """``to_pixels`` of each, decoded side by side."""
    files = [files_of(m) for m in media]
    pixels = iter(webp.decode_many([x for own in files for x in own], known))
    return [np.concatenate([next(pixels)[..., :3] for _ in own]) for own in files]


def feature(pixels: np.ndarray) -> str:
    """The 64 bits of the average hash of the grey image, and the channels' means."""
    grey = pixels.sum(2, dtype=np.int64)
    height, width = grey.shape
    rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
    cells = np.add.reduceat(np.add.reduceat(grey, rows, 0), columns, 1)
    area = np.maximum(np.diff(np.append(rows, height)), 1)[:, None] * np.maximum(np.diff(np.append(columns, width)), 1)[None, :]
    mean = cells / area
    bits = np.packbits((mean > mean.mean()).ravel()).tobytes().hex()
    return bits + "".join(f"-{m:.3f}" for m in pixels.reshape(-1, 3).mean(0))


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_bytes (of the text), media (the stored bytes)."""

    def run(batches):
        for whole in batches:
            for batch in portions(whole, 1):
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                media = [to_media(t + b" " * (max(ROW, -(-len(t) // ROW) * ROW) - len(t))) for t in texts]
                yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(F.col(key), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_back(stored: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """From ``key``, n_bytes and media: height, width, payload (the pixels' bytes), media and feature."""

    def run(batches):
        known = webp.Known()
        for whole in batches:
            for batch in portions(whole, 2, 4096, 4 << 20):
                pixels = many_pixels(batch.column(2).to_pylist(), known)
                yield pa.record_batch(
                    [
                        *batch.columns,
                        pa.array([p.shape[0] for p in pixels], pa.int32()),
                        pa.array([p.shape[1] for p in pixels], pa.int32()),
                        pa.array([p.tobytes() for p in pixels], pa.binary()),
                        pa.array([feature(p) for p in pixels], pa.string()),
                    ],
                    names=[key, "n_bytes", "media", "height", "width", "payload", "feature"],
                )

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary, height int, width int, payload binary, feature string")


def digest(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the op6 query from those of ``read_back``."""
    return read.select(
        key,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

