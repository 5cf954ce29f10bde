"""PNG decoding against a byte-by-byte reading of the format's rules, whole round trips, odd input, and resizing by sums."""

import struct
import zlib

import duckdb
import numpy as np
import pytest

from mossgraph import catalog
from mossgraph.functions import images


def stored(wide, high, bits, colour, raw, laced=0, palette=None):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", wide, high, bits, colour, 0, 0, laced)), (b"tEXt", b"a\0b")]
    parts += [(b"PLTE", palette)] if palette is not None else []
    packed = zlib.compress(raw)
    parts += [(b"IDAT", packed[:7]), (b"IDAT", packed[7:]), (b"IEND", b"")]
    return images.SIGNATURE + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in parts)


def unfiltered(raw, length, size):
    """Rows without their filters, one byte after another."""
    rows, before = [], [0] * length
    for start in range(0, len(raw), length + 1):
        kind, line, row = raw[start], raw[start + 1 : start + 1 + length], []
        for i, x in enumerate(line):
            left, up, corner = (row[i - size] if i >= size else 0), before[i], (before[i - size] if i >= size else 0)
            p = left + up - corner
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row.append((x + [0, left, up, (left + up) // 2, nearest][kind]) % 256)
        rows.append(row)
        before = row
    return np.array(rows, dtype=np.uint8)


@pytest.mark.parametrize("colour,bits", [(c, b) for c, allowed in images.BITS.items() for b in allowed])
def test_every_colour_and_depth(colour, bits):
    rng = np.random.default_rng(colour * 100 + bits)
    channels = images.CHANNELS[colour]
    palette = rng.integers(0, 256, (1 << min(bits, 8), 3), dtype=np.uint8)
    for wide, high in ((1, 1), (13, 7), (3, 40)):
        length = -(-wide * channels * bits // 8)
        raw = b"".join(bytes([int(k)]) + rng.bytes(length) for k in rng.integers(0, 5, high))
        got = images.decoded_png(stored(wide, high, bits, colour, raw, palette=palette.tobytes() if colour == 3 else None))
        rows = unfiltered(raw, length, max(1, channels * bits // 8))
        for y in range(high):
            whole = int.from_bytes(rows[y].tobytes(), "big")
            for x in range(wide):
                v = [(whole >> (8 * length - bits * (x * channels + c + 1))) & ((1 << bits) - 1) for c in range(channels)]
                v = [(s + 128) // 257 if bits == 16 else s * 255 // ((1 << bits) - 1) for s in v] if colour != 3 else v
                want = palette[v[0]].tolist() if colour == 3 else v[:1] * 3 if colour in (0, 4) else v[:3]
                assert got[y, x].tolist() == want


def test_interlaced_equals_plain():
    rng = np.random.default_rng(3)
    for wide, high in ((1, 1), (2, 3), (8, 8), (21, 17)):
        pixels = rng.integers(0, 256, (high, wide, 3), dtype=np.uint8)
        raw = b""
        for x, y, dx, dy in images.PASSES:
            for row in pixels[y::dy, x::dx] if x < wide else []:
                raw += b"\0" + row.tobytes()
        assert np.array_equal(images.decoded_png(stored(wide, high, 8, 2, raw, laced=1)), pixels)


def test_round_trip_of_every_filter():
    rng = np.random.default_rng(5)
    for channels in (1, 3, 4):
        pixels = rng.integers(0, 256, (31, 19, channels), dtype=np.uint8)
        for kinds in [np.full(31, k) for k in range(5)] + [rng.integers(0, 5, 31)]:
            assert np.array_equal(images.decoded_png(images.encoded_png(pixels, kinds)), np.broadcast_to(pixels[..., :3], (31, 19, 3)))


def test_resized_by_sums():
    rng = np.random.default_rng(6)
    for high, wide, side in ((9, 5, 4), (3, 3, 8), (1, 17, 6), (6, 6, 6)):
        pixels = rng.integers(0, 256, (high, wide, 3), dtype=np.uint8)
        got = images.resized(pixels, side)
        assert got.shape == (side, side, 3)

        def weights(n, k):
            step = n / side
            w = [max(0.0, 1 - abs(j + 0.5 - (k + 0.5) * step) / max(1.0, step)) for j in range(n)]
            return [x / sum(w) for x in w]

        for y in range(side):
            for x in range(side):
                total = sum(a * b * pixels[j, i].astype(float) for j, a in enumerate(weights(high, y)) for i, b in enumerate(weights(wide, x)))
                assert np.abs(got[y, x] - total).max() <= 0.5 + 1e-9
    assert np.array_equal(images.resized(pixels, 6), pixels)  # the same size changes nothing
    flat = images.planes(np.array([[[0, 255, 51]]], dtype=np.uint8))
    assert flat.shape == (3, 1, 1) and flat.ravel().tolist() == pytest.approx([-1, 1, -0.6])


def test_columns_with_odd_rows(spark):
    rng = np.random.default_rng(7)
    pixels = rng.integers(0, 256, (300, 200, 3), dtype=np.uint8)
    good = images.encoded_png(pixels, np.arange(300) % 5)
    broken = bytearray(good)
    broken[len(good) // 2] ^= 1
    huge = stored(1 << 20, 1 << 20, 8, 2, b"")
    cases = {"good": good, "again": good, None: good, "null": None, "empty": b"", "text": b"hello", "short": good[:-20], "header": good[:20], "broken": bytes(broken), "huge": huge,
             "few": stored(4, 4, 8, 2, b"\0" * 10), "kind": stored(1, 1, 8, 0, b"\x09\0"), "bare": stored(1, 1, 8, 3, b"\0\0"), "beyond": stored(1, 1, 8, 3, b"\0\5", palette=b"abc")}
    frame = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "x") for k, v in cases.items()], "name string, data binary, width string").repartition(3)
    out = {r["name"]: r for r in images.decoded(frame, "name", "data").collect()}
    assert len(out) == len(cases)
    want = images.planes(images.resized(pixels)).ravel()
    for k, r in out.items():
        if k in ("good", "again", None):
            assert (r["width"], r["height"]) == (200, 300) and np.array_equal(np.array(r["pixel_values"], dtype=np.float32), want)
        else:
            assert r["width"] is None and r["height"] is None and r["pixel_values"] is None
    assert images.decoded(frame.limit(0), "name", "data").count() == 0


def test_query_equals_sql(spark, sf):
    got = catalog.queries()["image_pixels"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(catalog.oracle_sql()["image_pixels"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
