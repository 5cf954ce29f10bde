"""PNG images as columns: decoded to pixels, resized, and laid out as the channel planes that vision encoders read.

A pixel's prediction needs the pixels to its left and above, so a whole image is undone along its diagonals: all rows take
part in each step, whatever filter each has.

Defined results: what is null, empty, cut short, damaged (checksums are compared) or has more than LARGEST pixels gives
nulls in every column but the identifier; transparency is dropped; equal bytes give equal values; an empty table gives an
empty table."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: its first bytes, channels and allowed bits by colour type, and the first pixel and step of
#: each interlaced pass (x, y, step in x, step in y).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
BITS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Most pixels of an image, which bounds a task's memory, and the side that the encoder reads.
LARGEST, SIDE = 1 << 25, 224
#: Images that a worker hands on at once.
ROWS = 16


def _predicted(kind, left, up, corner):
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.choose(kind, [np.zeros_like(left), left, up, (left + up) // 2, nearest])


def _undone(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows of pixels (row, place, byte) without their filters."""
    high, wide, size = lines.shape
    out = np.zeros((high + 1, wide + 1, size), dtype=np.int16)
    for diagonal in range(high + wide - 1):
        row = np.arange(max(0, diagonal - wide + 1), min(high, diagonal + 1))
        at = diagonal - row
        guess = _predicted(kinds[row, None], out[row + 1, at], out[row, at + 1], out[row, at])
        out[row + 1, at + 1] = (lines[row, at] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        (check,) = struct.unpack_from(">I", data, at + 8 + n)
        if zlib.crc32(name + body) != check:
            raise ValueError("checksum")
        yield name, body
        at += 12 + n
        if name == b"IEND":
            return
    raise ValueError("cut short")


def _samples(raw: np.ndarray, wide: int, high: int, channels: int, bits: int) -> np.ndarray:
    """Samples (row, place, channel) of one pass, as they are stored."""
    length = -(-wide * channels * bits // 8)
    lines = raw.reshape(high, length + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("filter")
    size = max(1, channels * bits // 8)
    rows = _undone(lines[:, 1:].reshape(high, -1, size).astype(np.int16), lines[:, 0].astype(np.int64)).reshape(high, length)
    if bits == 16:
        return rows.view(">u2").astype(np.int64).reshape(high, wide, channels)
    if bits < 8:
        places = np.unpackbits(rows, axis=1).reshape(high, -1, bits)
        rows = (places << np.arange(bits - 1, -1, -1)).sum(axis=2)[:, : wide * channels]
    return rows.astype(np.int64).reshape(high, wide, channels)


def decoded_png(data: bytes) -> np.ndarray | None:
    """Red, green and blue of every pixel (row, place, colour), or None."""
    try:
        if data[: len(SIGNATURE)] != SIGNATURE:
            return None
        chunks = list(_chunks(data))
        (wide, high, bits, colour, packing, filters, laced), palette = struct.unpack(">IIBBBBB", chunks[0][1]), b""
        if chunks[0][0] != b"IHDR" or bits not in BITS.get(colour, ()) or packing or filters or laced > 1 or not 0 < wide * high <= LARGEST:
            return None
        palette = next((np.frombuffer(body, dtype=np.uint8).reshape(-1, 3) for name, body in chunks if name == b"PLTE"), None)
        channels = CHANNELS[colour]
        whole = [(0, 0, 1, 1)] if not laced else PASSES
        parts = [(x, y, dx, dy, -(-(wide - x) // dx), -(-(high - y) // dy)) for x, y, dx, dy in whole if x < wide and y < high]
        sizes = [h * (1 + -(-w * channels * bits // 8)) for *_, w, h in parts]
        raw = zlib.decompressobj().decompress(b"".join(body for name, body in chunks if name == b"IDAT"), sum(sizes) + 1)
        if len(raw) != sum(sizes):
            return None
        out, at = np.zeros((high, wide, channels), dtype=np.int64), 0
        for (x, y, dx, dy, w, h), n in zip(parts, sizes):
            out[y::dy, x::dx] = _samples(np.frombuffer(raw, dtype=np.uint8, count=n, offset=at), w, h, channels, bits)
            at += n
        if colour == 3:
            return palette[out[..., 0]]
        out = out[..., : 1 if colour in (0, 4) else 3]
        out = (out + 128) // 257 if bits == 16 else out * 255 // ((1 << bits) - 1)
        return np.broadcast_to(out, (high, wide, 3)).astype(np.uint8)
    except (ValueError, IndexError, TypeError, struct.error, zlib.error):
        return None


def encoded_png(pixels: np.ndarray, kinds: np.ndarray) -> bytes:
    """8-bit pixels (row, place, colour; one, three or four of them) as a PNG, each row with the filter of its kind."""
    high, wide, channels = pixels.shape
    around = np.pad(pixels.astype(np.int16), ((1, 0), (1, 0), (0, 0)))
    guess = _predicted(kinds[:, None, None], around[1:, :-1], around[:-1, 1:], around[:-1, :-1])
    lines = np.column_stack([kinds, ((around[1:, 1:] - guess) & 255).reshape(high, -1)]).astype(np.uint8)
    colour = {1: 0, 3: 2, 4: 6}[channels]
    parts = [(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, colour, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in parts)


def _triangle(n: int, to: int) -> np.ndarray:
    """Weights of n places for each of the new ones: a triangle as wide as the step between those, of sum one."""
    step = n / to
    apart = np.abs(np.arange(n) + 0.5 - (np.arange(to)[:, None] + 0.5) * step)
    weight = np.maximum(0, 1 - apart / max(1.0, step))
    return weight / weight.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Exactly side by side pixels, whatever the shape was."""
    high, wide, _ = pixels.shape
    made = np.einsum("yj,jic,xi->yxc", _triangle(high, side), pixels.astype(np.float64), _triangle(wide, side), optimize=True)
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)


def planes(pixels: np.ndarray) -> np.ndarray:
    """Channel planes from -1 to 1 (colour, row, place)."""
    return (pixels.astype(np.float32).transpose(2, 0, 1) / np.float32(255) - np.float32(0.5)) / np.float32(0.5)


def decoded(files: DataFrame, id_col: str, data: str, side: int | None = SIDE) -> DataFrame:
    """id, width, height and pixel_values: the planes of the image at ``side``, or its bytes as they are if that is None."""
    kind = files.schema[id_col].dataType.simpleString()
    item, value = (pa.binary(), "binary") if side is None else (pa.list_(pa.float32()), "array<float>")

    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, found = batch.slice(start, ROWS), []
                for x in part.column(1):
                    pixels = decoded_png(x.as_py() or b"")
                    if pixels is None:
                        found.append((None, None, None))
                        continue
                    found.append((pixels.shape[1], pixels.shape[0], pixels.tobytes() if side is None else planes(resized(pixels, side)).ravel()))
                wide, high, values = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(wide, pa.int32()), pa.array(high, pa.int32()), pa.array(values, item)], ["id", "width", "height", "pixel_values"])

    rows = files.select(F.col(id_col).alias("id"), F.col(data).cast("binary").alias("data"))
    return rows.mapInArrow(each, f"id {kind}, width int, height int, pixel_values {value}").withColumnRenamed("id", id_col)
