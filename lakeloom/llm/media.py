"""Media columns: payloads stored as PNG, read back and hashed perceptually.

``encode_png`` turns bytes into a greyscale 8-bit PNG 64 pixels wide: the
payload is the text's UTF-8, padded with zero bytes to a positive multiple of
64, one byte a pixel.  Every row gets that of the five row filters whose
differences are smallest in sum, as PNG writers do.  ``media_features`` takes
such a binary column back: it walks the chunks, tests each checksum, inflates
the IDAT stream, undoes the filters with numpy and computes a 64-bit hash from
the low frequencies of the picture's cosine transform.  Encoding and reading
share nothing but the bytes of the ``media`` column.

Undoing a filter needs the pixels to the left and above, so pixels of equal
row number plus column number are independent of each other, whatever their
rows' filters: all pictures of a batch are undone together, one such diagonal at
a time.

Memory: a worker holds batches of about ``BATCH_BYTES``; a longer text comes alone
and takes some 12 bytes for each of its own.

Defined cases: a null or empty text is 64 zero bytes; very long texts are taller
pictures (IDAT is split into chunks); repeated rows give repeated results and
equal texts equal values; an empty table gives no rows; input columns other
than the id and the text are ignored whatever their names.  Bytes that are not
a readable PNG give nulls and a message in ``error`` instead of failing a job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, lean, record_batch, slices, text_bytes

WIDTH = 64
LEVEL = 1
IDAT_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
#: rows whose filters are chosen at a time
FILTER_ROWS = 1 << 14
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8

STORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
])
FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("phash", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return b"".join((struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))))


def filtered(rows: np.ndarray, above: np.ndarray, bpp: int = 1) -> np.ndarray:
    """(height, 1 + stride): each row behind the type of the filter with the least sum of differences.

    ``above`` holds the row over each row (zeros over a picture's first).
    """
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for at in range(0, len(rows), FILTER_ROWS):
        x, b = (r[at : at + FILTER_ROWS].astype(np.int16) for r in (rows, above))
        a, c = np.zeros_like(x), np.zeros_like(x)
        a[:, bpp:], c[:, bpp:] = x[:, :-bpp], b[:, :-bpp]
        guesses = (np.int16(0), a, b, (a + b) >> 1, _paeth(a, b, c))
        tried = [(x - g).astype(np.uint8) for g in guesses]
        # a difference counts as signed: 255 is -1
        sums = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for t in tried])
        kind = np.argmin(sums, axis=0)
        out[at : at + len(x), 0] = kind
        for k, t in enumerate(tried):
            out[at : at + len(x), 1:][kind == k] = t[kind == k]
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner, the first of equals."""
    near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - c - c)
    return np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))


def png_bytes(raw: np.ndarray, level: int = LEVEL) -> bytes:
    """A greyscale 8-bit PNG of filtered rows."""
    packed = zlib.compress(np.ascontiguousarray(raw), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", raw.shape[1] - 1, len(raw), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def write_png(rows: np.ndarray, level: int = LEVEL) -> bytes:
    """A greyscale 8-bit PNG of a (height, width) uint8 array."""
    return png_bytes(filtered(rows, np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])), level)


def unfilter(pictures: list[np.ndarray], bpp: int) -> list[np.ndarray]:
    """Undo PNG's row filters: (height, 1 + stride) bytes each to (height, stride), one stride for all.

    Rows are ordered by their number in their picture, so those that a diagonal
    goes through are neighbours.  Of every row only the last two pixels that are
    done are held: they are the left one, and the row's below above and corner.
    """
    heights = np.array([len(p) for p in pictures], np.int64)
    total, width = int(heights.sum()), (pictures[0].shape[1] - 1) // bpp
    number = np.arange(total) - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(number, kind="stable")
    raw = np.concatenate(pictures)[order]
    kinds = raw[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    number = number[order]
    up = np.where(number > 0, place[order - 1], total)  # the last one stands for no row
    pixels = raw[:, 1:].reshape(total, width, bpp)
    ends = np.searchsorted(number, np.arange(int(heights.max(initial=0)) + width + 1))
    now, before = (np.zeros((total + 1, bpp), np.int16) for _ in range(2))
    for step in range(int(heights.max(initial=0)) + width - 1):
        lo, hi = int(ends[max(0, step - width + 1)]), int(ends[step + 1])
        at, x = np.arange(lo, hi), step - number[lo:hi]
        kind, above, corner = kinds[lo:hi, None], now[up[lo:hi]], before[up[lo:hi]]
        left = now[lo:hi]
        guess = np.where(kind == 1, left, np.where(kind == 2, above, np.where(kind == 3, (left + above) >> 1, np.where(kind == 4, _paeth(left, above, corner), 0))))
        value = (pixels[at, x] + guess) & 255
        # rows that ended one step ago are still above and corner of the next ones
        old = int(ends[max(0, step - width - 1)])
        before[old:hi] = now[old:hi]
        now[lo:hi] = value
        pixels[at, x] = value
    out = pixels.reshape(total, width * bpp)[place]
    return np.split(out, np.cumsum(heights)[:-1])


def read_chunks(data: bytes) -> tuple[np.ndarray, int]:
    """The filtered rows of a greyscale, RGB or RGBA 8-bit PNG, and its channels."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, inflate, parts, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off inside a chunk")
        length, kind = struct.unpack_from(">I4s", data, at)
        body = memoryview(data)[at + 8 : at + 8 + length]
        if len(body) < length or at + 12 + length > len(data):
            raise ValueError("cut off inside a chunk")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(inflate.decompress(body))
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended:
        raise ValueError("no IHDR or IEND")
    width, height, depth, colour, *rest = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or rest != [0, 0, 0]:
        raise ValueError("only plain 8-bit pictures are read")
    raw = np.frombuffer(b"".join([*parts, inflate.flush()]), np.uint8)
    if len(raw) != height * (1 + width * channels) or not inflate.eof:
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, 1 + width * channels)
    if raw[:, 0].max(initial=0) > 4:
        raise ValueError("unknown row filter")
    return raw, channels


def read_png(data: bytes) -> np.ndarray:
    """The samples of a greyscale, RGB or RGBA 8-bit PNG as (height, width * channels)."""
    raw, channels = read_chunks(data)
    return unfilter([raw], channels)[0]


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _shrunk(rows: np.ndarray) -> np.ndarray:
    """Area means on a SIDE x SIDE grid (small pictures are stretched)."""
    for _ in range(2):
        n = len(rows)
        sums = np.zeros((n + 1, rows.shape[1]))
        np.cumsum(rows, axis=0, out=sums[1:], dtype=np.float64)
        edge = np.arange(SIDE + 1) * (n / SIDE)
        low = np.minimum(edge.astype(np.int64), n - 1)
        at = sums[low] + (edge - low)[:, None] * (sums[low + 1] - sums[low])
        rows = (np.diff(at, axis=0) * (SIDE / n)).T
    return rows


def perceptual_hash(rows: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine terms are above their median."""
    if rows.shape[1] == 2 * SIDE:  # fold the width first: fewer sums
        rows = rows[:, ::2].astype(np.uint16) + rows[:, 1::2]
    c = _cosines()
    low = np.round(c @ _shrunk(rows) @ c.T, 4).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        data, offsets = binary_parts(batch.column("text"))
        sizes = np.diff(offsets)
        heights = np.maximum(1, -(-sizes // WIDTH))
        ends = np.cumsum(heights)
        payload = np.zeros(int(ends[-1]) * WIDTH, np.uint8)
        for a, b, row in zip(offsets[:-1], offsets[1:], ends - heights, strict=True):
            payload[row * WIDTH : row * WIDTH + b - a] = data[a:b]
        rows = payload.reshape(-1, WIDTH)
        above = np.zeros_like(rows)
        above[1:] = rows[:-1]
        above[(ends - heights)] = 0
        media = [png_bytes(raw, level) for raw in np.split(filtered(rows, above), ends[:-1])]
        yield record_batch({"doc_id": batch.column("doc_id"), "n_bytes": sizes, "media": media}, STORED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", BATCH_BYTES // 2):
        found: list[dict] = []
        together: dict[tuple[int, int], list[tuple[dict, np.ndarray]]] = {}
        for value in batch.column("media"):
            data, row = value.as_py(), {}
            found.append(row)
            try:
                if data is None:
                    raise ValueError("no media")
                raw, channels = read_chunks(data)
                row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                together.setdefault((raw.shape[1], channels), []).append((row, raw))
            except (ValueError, zlib.error, struct.error) as e:
                row["error"] = str(e)
        for (_, channels), pictures in together.items():
            for (row, _), samples in zip(pictures, unfilter([raw for _, raw in pictures], channels), strict=True):
                payload, mark = np.ascontiguousarray(samples).reshape(-1), perceptual_hash(samples)
                row |= {"payload_bytes": payload.size, "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": mark.hex(), "phash": mark}
        out = {f.name: [row.get(f.name) for row in found] for f in FEATURES if f.name not in ("doc_id", "n_bytes")}
        yield record_batch(out | {c: batch.column(c) for c in ("doc_id", "n_bytes")}, FEATURES)


def encode_png(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_bytes, media)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(lambda it: _encode(it, level)), STORED)


def media_features(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` to digests and hashes of what is read back."""
    return media.select(*STORED.names).mapInArrow(lean(_read), FEATURES)


def op1_media_png(spark, sf_dir: str) -> DataFrame:
    """Every document stored as PNG, read back, checked and hashed."""
    return media_features(encode_png(spark.read.parquet(f"{sf_dir}/documents.parquet")))
