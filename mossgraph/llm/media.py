"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, and resampled PCM.

Lookup tables (computed from the G.711 rules) expand the companded codes; ADPCM is decoded one sample position at a time
with numpy across all blocks of a batch; PCM is resampled and stored as 16-bit samples in a WAV container.

Defined results: a null text counts as empty; the payload is never empty; equal texts give equal values; repeated rows
repeat; very long texts are stored whole and described slice by slice; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, tidy

RATE, TARGET_RATE = 8_000, 16_000
#: Bytes to which a payload is padded with 255: also one ADPCM block.
UNIT = 576
#: Codec numbers of the WAV format, fixed values.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Bytes of payload that are processed at once (whole blocks), and texts' bytes that are taken together.
SLICE, TOGETHER = 2048 * UNIT, 2 << 20


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    size = np.where(segment > 0, (step + 0x100) << np.maximum(segment - 1, 0), step)
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: IMA ADPCM step sizes and index changes, fixed values of the format.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
IMA_TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _ima_changes() -> np.ndarray:
    """The change of the predictor for each step index and code."""
    code = np.arange(16)
    step = IMA_STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


IMA_CHANGES = _ima_changes().reshape(-1)
IMA_NEXT = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_TURNS, 0, len(IMA_STEPS) - 1).astype(np.int32).reshape(-1)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (a row each: 4 bytes of header, then two codes a byte) to int16 samples."""
    blocks = np.ascontiguousarray(blocks, dtype=np.uint8)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k, column in enumerate(columns):
        for half, code in ((1, column & 15), (2, column >> 4)):
            at = index * 16 + code
            value = np.clip(value + IMA_CHANGES[at], -32768, 32767)
            index = IMA_NEXT[at]
            out[2 * k + half] = value
    return out.T


def resampled(samples: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: every sample, and between two the mean of both (after the last, the last)."""
    out = np.empty(2 * len(samples), dtype="<i2")
    out[::2] = samples
    out[1::2] = np.r_[(samples[:-1].astype(np.int32) + samples[1:]) >> 1, samples[-1:]]
    return out


def wav(payload: bytes, codec: int, rate: int, bits: int, align: int) -> bytes:
    """A mono WAV file around stored bytes (of even length)."""
    samples = len(payload) // align * (1 + 2 * (align - 4)) if codec == IMA_ADPCM else len(payload) // align
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if codec == IMA_ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    per_second = rate * align if codec != IMA_ADPCM else rate * align // (1 + 2 * (align - 4))
    form = struct.pack("<HHIIHH", codec, 1, rate, per_second, align, bits) + extra
    fact = b"" if codec == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", (len(body) + len(payload)) & 0xFFFFFFFF) + body + payload


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """Codec, block size and stored samples of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, align = 12, 0, 1
    while at + 8 <= len(stored):
        kind, n = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            codec, align = int.from_bytes(stored[at + 8 : at + 10], "little"), int.from_bytes(stored[at + 20 : at + 22], "little")
        elif kind == b"data":
            return codec, align, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def decoded(codec: int, align: int, stored: bytes) -> np.ndarray:
    """int16 samples of stored bytes."""
    codes = np.frombuffer(stored, dtype=np.uint8)
    if codec == MU_LAW:
        return mu_law_table()[codes]
    if codec == A_LAW:
        return a_law_table()[codes]
    if codec == IMA_ADPCM:
        return decode_ima(codes.reshape(-1, align)).reshape(-1)
    if codec == PCM:
        return codes.view("<i2")
    raise ValueError(f"codec {codec}")


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def _described(text: bytes, stored: bytes, keep_audio: bool) -> dict:
    """What a stored file's bytes are and sound like, read back SLICE by SLICE, so that a long one needs no large arrays."""
    _, _, back = read_wav(stored)
    back, mu, al = memoryview(back), mu_law_table(), a_law_table()
    sums, turns, crc, last, pcm = np.zeros(3), 0, 0, None, []
    for at in range(0, len(back), SLICE):
        codes = np.frombuffer(back[at : at + SLICE], dtype=np.uint8)
        linear = mu[codes]
        sums += [_power(linear), _power(al[codes]), _power(decode_ima(codes.reshape(-1, UNIT)))]
        signs = linear < 0
        turns += int(np.count_nonzero(signs[1:] != signs[:-1])) + int(last is not None and signs[0] != last)
        last = signs[-1]
        beyond = mu[np.frombuffer(back[at + SLICE : at + SLICE + 1], dtype=np.uint8)]
        part = resampled(np.r_[linear, beyond])[: 2 * len(linear)].tobytes()
        crc = zlib.crc32(part, crc)
        if keep_audio:
            pcm.append(part)
    n = len(back)
    rms = np.sqrt(sums / [n, n, n // UNIT * (1 + 2 * (UNIT - 4))])
    return {
        "n_bytes": len(text),
        "payload_bytes": n,
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"mulaw_rms={rms[0]:.3f};alaw_rms={rms[1]:.3f};ima_rms={rms[2]:.3f};turns={turns};pcm16k_bytes={4 * n};pcm16k_crc32={crc:08x}",
    } | ({"media": stored, "pcm": wav(b"".join(pcm), PCM, TARGET_RATE, 16, 2)} if keep_audio else {})


def _power(samples: np.ndarray) -> float:
    return float((samples.astype(np.int64) ** 2).sum())


def telephony_rows(texts: list[bytes], keep_audio: bool) -> list[dict]:
    """Store each text as mu-law samples, read them back, and describe what all three codecs make of them.

    ADPCM blocks of short texts are decoded together, since decoding goes sample by sample across all blocks at hand."""
    mu, al = mu_law_table(), a_law_table()
    stored = [wav(payload_of(t), MU_LAW, RATE, 8, 1) for t in texts]
    back = [read_wav(s)[2] for s in stored]
    lengths = np.array([len(b) for b in back])
    codes = np.frombuffer(b"".join(back), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    linear, other = mu[codes], al[codes]
    power = [np.add.reduceat(x.astype(np.int64) ** 2, starts).astype(float) for x in (linear, other)]
    turns = np.r_[(linear[1:] < 0) != (linear[:-1] < 0), False]
    turns[starts[1:] - 1] = False
    turns = np.add.reduceat(turns.astype(np.int64), starts)
    block_power = (decode_ima(codes.reshape(-1, UNIT)).astype(np.int64) ** 2).sum(axis=1)
    power.append(np.add.reduceat(block_power, starts // UNIT).astype(float))
    out = []
    for k, text in enumerate(texts):
        n = int(lengths[k])
        rms = np.sqrt(np.array([p[k] for p in power]) / [n, n, n // UNIT * (1 + 2 * (UNIT - 4))])
        pcm = resampled(linear[starts[k] : starts[k] + n]).tobytes()
        out.append(
            {
                "n_bytes": len(text),
                "payload_bytes": n,
                "payload_sha256": hashlib.sha256(back[k]).hexdigest(),
                "tail_crc32": zlib.crc32(back[k][-32:]),
                "media_bytes": len(stored[k]),
                "media_sha256": hashlib.sha256(stored[k]).hexdigest(),
                "feature": f"mulaw_rms={rms[0]:.3f};alaw_rms={rms[1]:.3f};ima_rms={rms[2]:.3f};turns={turns[k]};pcm16k_bytes={len(pcm)};pcm16k_crc32={zlib.crc32(pcm):08x}",
            }
            | ({"media": stored[k], "pcm": wav(pcm, PCM, TARGET_RATE, 16, 2)} if keep_audio else {})
        )
    return out


FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def telephony_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_audio: bool = True) -> DataFrame:
    """doc_id, digests and features for every row and, if asked for, media (mu-law WAV) and pcm (16 kHz PCM WAV)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = FIELDS | ({"media": pa.binary(), "pcm": pa.binary()} if keep_audio else {})

    def each(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() + [TOGETHER]
            start, held, used = 0, [], 0
            for k in range(len(texts)):
                held.append(texts[k].as_py() or b"")
                used += sizes[k]
                if used + sizes[k + 1] >= TOGETHER:
                    alone = len(held) == 1 and used >= TOGETHER
                    rows = [_described(held[0], wav(payload_of(held[0]), MU_LAW, RATE, 8, 1), keep_audio)] if alone else telephony_rows(held, keep_audio)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), *[pa.array([r[f] for r in rows], t) for f, t in fields.items()]], ["doc_id", *fields])
                    start, held, used = k + 1, [], 0

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([f"doc_id {kind}", *[f"{f} {names[t]}" for f, t in fields.items()]])
    return for_python(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), schema)
