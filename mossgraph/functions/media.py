"""Media files: kinds, descriptions and embeddings that mix the description with a fingerprint of the bytes."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import vector
from . import text as T

#: File endings by kind, fixed values.
KINDS = {"audio": "mp3 wav ogg flac m4a aac opus".split(), "video": "mp4 mov mkv webm avi".split(), "image": "png jpg jpeg gif webp bmp svg".split()}
#: Seeds of the first, last and middle window, fixed values.
SEEDS = (0xA110A2026, 0xB220B2026, 0xC330C2026)
WINDOW, TEXT_SHARE, BYTE_SHARE = 4096, 0.85, 0.15


def kind(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = None
    for name, endings in KINDS.items():
        found = F.when(ending.isin(endings), name) if found is None else found.when(ending.isin(endings), name)
    return found


def human_bytes(n: Column) -> Column:
    scaled = lambda power: F.bround(n / float(1024**power), 2 if power == 3 else 1)  # noqa: E731  ties to even
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024**2, F.format_string("%.1fKB", scaled(1))).when(n < 1024**3, F.format_string("%.1fMB", scaled(2))).otherwise(F.format_string("%.2fGB", scaled(3)))


def description(path: Column, size: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parent = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    return T.squeezed(F.concat_ws(" ", kind(path), stem, parent, human_bytes(size)))


def fingerprint(data: bytes) -> np.ndarray:
    """Signs from digests of the first and last window, and of the middle one of larger files, summed."""
    out = np.zeros(T.DIM)
    if not data:
        return out
    n = min(WINDOW, len(data))
    parts = [data[:n], data[-n:]]
    if len(data) > 4 * n:
        middle = len(data) // 2 - n // 2
        parts.append(data[middle : middle + n])
    place = np.arange(T.DIM)
    for seed, part in zip(SEEDS, parts):
        digest = np.frombuffer(hashlib.sha256(struct.pack("<Q", seed) + part).digest(), dtype=np.uint8)
        out += np.where(digest[place % 32] >> (place % 8) & 1, 1.0, -1.0)
    return out


def embedding(words: list[str], data: bytes) -> np.ndarray:
    text = np.zeros(T.DIM)
    for k, v in vector.places(words).items():
        text[k] = v
    unit = lambda v: v / n if (n := np.sqrt((v**2).sum())) > 1e-9 else v
    return unit(TEXT_SHARE * unit(text) + BYTE_SHARE * unit(fingerprint(data))).astype(np.float32)


def embedded(files: DataFrame, id_col: str, words: str, data: str) -> DataFrame:
    """id, embedding: ``embedding`` of each file's words and bytes."""

    def each(frames):
        for f in frames:
            yield pd.DataFrame({id_col: f["id"], "embedding": [embedding(list(w), bytes(d)).tolist() for w, d in zip(f["words"], f["data"])]})

    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInPandas(each, f"{id_col} {kind}, embedding array<float>")
