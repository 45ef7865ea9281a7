"""Texts as greyscale PNG images in a binary column, and perceptual hashes of what is read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_or_empty

#: Samples in an image row.
WIDTH = 192
#: Compressed bytes in one IDAT chunk.
CHUNK_BYTES = 1 << 16
#: Fixed by the PNG format: its signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the reduced image, and of the block of low frequencies that the hash keeps.
REDUCED, LOW = 32, 8


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(pixels: np.ndarray) -> np.ndarray:
    """Each row under the filter (none, left or up) with the least sum of signed magnitudes."""
    left, up = pixels.copy(), pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    forms = np.stack([pixels, left, up])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(len(best))]
    return rows


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload: a positive multiple of width bytes, one 8-bit grey sample each."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(filtered(pixels).tobytes(), 1)
    parts = [packed[i : i + CHUNK_BYTES] for i in range(0, len(packed), CHUNK_BYTES)]
    header = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + b"".join(chunk(b"IDAT", x) for x in parts) + chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undoes the five PNG row filters for one byte a pixel. Left runs are cumulative sums along
    rows and up runs along columns; the two that depend on both neighbours go pixel by pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    left = kinds == 1
    out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else []
    for start, stop in zip(starts, [*starts[1:], len(kinds)]):
        kind = kinds[start]
        above = out[start - 1] if start else np.zeros(out.shape[1], np.uint8)
        if kind == 2:
            out[start:stop] = np.cumsum(np.vstack([above, out[start:stop]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for at in range(start, stop):
                out[at] = two_sided(kind, out[at].tolist(), (out[at - 1] if at else above).tolist())
        elif kind > 4:
            raise ValueError(f"unknown row filter {kind}")
    return out


def two_sided(kind: int, row: list[int], above: list[int]) -> np.ndarray:
    a = c = 0
    for x, b in enumerate(above):
        if kind == 3:
            guess = (a + b) // 2
        else:
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        a, c = (row[x] + guess) & 255, b
        row[x] = a
    return np.array(row, np.uint8)


def read_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG; ValueError on a bad signature, checksum or size."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, data, ended = 8, None, zlib.decompressobj(), False
    raw = bytearray()
    while not ended:
        if at + 12 > len(media):
            raise ValueError("cut short")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            raw += data.decompress(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey without interlace")
    width, height = header[:2]
    raw += data.flush()
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(np.frombuffer(bytes(raw), np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=8)
def cosines(size: int, kept: int) -> np.ndarray:
    """The first rows of the type-II cosine transform."""
    return np.cos(np.pi / size * np.outer(np.arange(kept), np.arange(size) + 0.5))


def means(pixels: np.ndarray, size: int) -> np.ndarray:
    """The image reduced to size x size by means of cells; smaller images repeat their samples."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        edges = np.arange(size) * n // size
        counts = np.maximum(1, np.diff(np.r_[edges, n]))
        shape = (-1, 1) if axis == 0 else (1, -1)
        pixels = np.add.reduceat(pixels.astype(np.float64), edges, axis=axis) / counts.reshape(shape)
    return pixels


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which low frequencies lie above their median, the constant one aside."""
    basis = cosines(REDUCED, LOW)
    low = (basis @ means(pixels, REDUCED) @ basis.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Stores each whole text losslessly as a PNG and reads it back, row by row: no shuffle.

    The UTF-8 bytes, filled up with bytes 32 to a positive multiple of width, are the samples.
    Returns id_col, n_bytes (without the fill), media (the file), payload (the samples as decoded
    from media, checksums tested) and hash (8 bytes). A null or empty text is one row of blanks.
    Repeated rows and null ids come back as often as they came; equal texts give equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, media, payloads, hashes = [], [], [], []
            for raw in batch.column(1).to_pylist():
                rows = max(1, -(-len(raw) // width))
                media.append(write_png(raw.ljust(rows * width, b" "), width))
                pixels = read_png(media[-1])
                sizes.append(len(raw))
                payloads.append(pixels.tobytes())
                hashes.append(cosine_hash(pixels))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (media, payloads, hashes))],
                names=["id", "n_bytes", "media", "payload", "hash"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("raw"))
    out = map_arrow(rows, run, f"id {kind}, n_bytes long, media binary, payload binary, hash binary")
    return out.withColumnRenamed("id", id_col)
