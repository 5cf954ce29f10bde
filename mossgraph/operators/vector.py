"""Vector retrieval: hashed embeddings, cosine, thresholds and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Rows whose nearest others a block of ``all_pairs_topk`` keeps, rows that are packed together, and rows that pass by in one task.
BLOCK_ROWS, CELL_ROWS, SLICE_ROWS = 32_768, 2_048, 500_000


def cosine(a: Column, b: Column) -> Column:
    """0 for arrays of different or no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1), F.lit(0.0)).otherwise(dot(a, b) / F.greatest(norm, F.lit(1e-9)))


def places(words: list[str]) -> dict[int, int]:
    """Nonzero places of the hashed embedding of tokens, before it is scaled."""
    out: dict[int, int] = {}
    for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = T.fnv1a(feature)
        out[h % T.DIM] = out.get(h % T.DIM, 0) + (-1 if h >> 56 & 1 else 1)
    return {k: v for k, v in out.items() if v}


class Hasher(dict):
    """Place and sign of a feature; hashed once for each different feature a worker sees."""

    def __missing__(self, feature: str) -> tuple[int, int]:
        if len(self) > 1_000_000:
            self.clear()
        h = T.fnv1a(feature)
        self[feature] = found = (h % T.DIM, -1 if h >> 56 & 1 else 1)
        return found


def embedded(rows: DataFrame, words: str = "tokens") -> DataFrame:
    """rows with embedding (array of float, length 1 or zeros); Arrow batches, dense arithmetic in numpy."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for batch in batches:
            out = np.zeros((len(batch), T.DIM), dtype=np.float32)
            for k, found in enumerate(batch):
                found = list(found)
                for feature in [*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))]:
                    at, s = hasher[feature]
                    out[k, at] += s
            norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), out).astype(np.float32)))

    return rows.withColumn("embedding", encode(F.col(words)))


#: Rows whose hashed embeddings are dense at once.
DENSE = 1024


def counts(words: pa.ListArray) -> Iterator[np.ndarray]:
    """Hashed embeddings before they are scaled, DENSE rows after another.  Each different token and pair of a batch is hashed
    once, a pair by going on from its left token's state."""
    values, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = coded.dictionary.cast(pa.large_binary())
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, dtype=np.int64)
    own = _from(data, at, np.arange(len(raw)), np.full(len(raw), T.FNV_BASIS, dtype=np.uint64))
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    left = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, dtype=np.int64)
    pairs, which = np.unique(code[left] * max(len(raw), 1) + code[left + 1], return_inverse=True)
    first, second = pairs // max(len(raw), 1), pairs % max(len(raw), 1)
    with np.errstate(over="ignore"):
        spaced = (own[first] ^ np.uint64(32)) * np.uint64(T.FNV_PRIME) if len(pairs) else np.zeros(0, dtype=np.uint64)
    both = _from(data, at, second, spaced)
    h = np.concatenate([own[code], both[which]])
    rows = np.concatenate([row, row[left]])
    place, sign = (h % np.uint64(T.DIM)).astype(np.int64), np.where(h >> np.uint64(56) & np.uint64(1), -1.0, 1.0)
    order = np.argsort(rows, kind="stable")
    rows, place, sign = rows[order], place[order], sign[order]
    for k in range(0, len(words), DENSE):
        n = min(DENSE, len(words) - k)
        part = slice(*np.searchsorted(rows, [k, k + n]))
        yield np.bincount((rows[part] - k) * T.DIM + place[part], sign[part], n * T.DIM).reshape(n, T.DIM)


def _from(data: np.ndarray, at: np.ndarray, chosen: np.ndarray, start: np.ndarray) -> np.ndarray:
    """FNV-1a of chosen strings (data from offset to offset), each going on from its own state, a byte of all at a time."""
    begin, size = at[:-1][chosen], np.diff(at)[chosen]
    order = np.argsort(-size, kind="stable")
    begin, size, state, live = begin[order], size[order], start[order], len(order)
    with np.errstate(over="ignore"):
        for k in range(int(size[0]) if len(order) else 0):
            live = int(np.searchsorted(-size[:live], -k, side="left"))
            state[:live] = (state[:live] ^ data[begin[:live] + k]) * np.uint64(T.FNV_PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def query_scores(rows: DataFrame, query_words: list[str], words: str = "tokens") -> DataFrame:
    """rows with score: cosine of each row's tokens and the query, exact in integers up to the final division."""
    wanted = places(query_words)
    length = math.sqrt(sum(v * v for v in wanted.values()))
    asked = np.zeros(T.DIM)
    asked[list(wanted)] = list(wanted.values())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [np.zeros(0)]
            for own in counts(batch):
                dot, size = own @ asked, np.sqrt((own * own).sum(axis=1))
                out.append(np.divide(dot, size * length, out=np.zeros(len(own)), where=dot != 0))
            yield pa.array(np.concatenate(out))

    return rows.withColumn("score", score(F.col(words)))


def nearest_to(vectors: DataFrame, query: list[float], k: int | None = None, threshold: float | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Rows by cosine with a literal query vector: no join, one projection and a top-k."""
    scored = vectors.select(id_col, F.round(cosine(F.col(col), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k) if k is not None else scored


def all_pairs_topk(vectors: DataFrame, k: int = 5, least: float = -1.0, blocks: int | None = None, linked: DataFrame | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """source, target, score: each row's k nearest others that score at least ``least`` and aren't linked from it.

    Rows are hashed into blocks, and all rows pass by each block in packed cells, once; the block keeps the k best of its rows so far.
    So a row is shuffled as often as there are blocks, and what comes out is k rows of each source and slice of the passing
    rows, which a window merges.  Links are taken out before the ranking."""
    n = vectors.where(F.col(col).isNotNull()).count()
    if blocks is None:
        blocks = n // BLOCK_ROWS + 1
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    slices = max(min(-(-2 * parallel // blocks), n // CELL_ROWS + 1), n // SLICE_ROWS + 1)
    rows = vectors.where(F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), F.col(col).alias("v"))
    kind = np.dtype("<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8")
    rows = rows.withColumn("v", F.col("v").cast("array<float>" if kind.itemsize == 4 else "array<double>"))
    none = F.array().cast("array<long>")
    if linked is not None:
        out = linked.select(F.col("source").alias("id"), F.col("target").alias("t")).groupBy("id").agg(F.collect_set("t").alias("out"))
        rows = rows.join(out, "id", "left").withColumn("out", F.coalesce("out", none))
    else:
        rows = rows.withColumn("out", none)
    cell = "tasks array<int>, kind int, n int, ids binary, v binary, sizes binary, out binary"
    names = [c.split(" ")[0] for c in cell.split(", ")]

    def packed(batches) -> Iterator[pa.RecordBatch]:
        held, turn = [], 0

        def told(tasks: list, what: int, ids: np.ndarray, v: np.ndarray, out: list) -> pa.RecordBatch:
            sizes, flat = np.array([len(x) for x in out], dtype=np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *out]).astype(np.int64)
            data = [x.tobytes() for x in (ids, v, sizes, flat)]
            return pa.RecordBatch.from_arrays([pa.array([tasks], pa.list_(pa.int32())), pa.array([what], pa.int32()), pa.array([len(ids)], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], names=names)

        def sent(rows: pa.Table):
            ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
            v = np.stack(rows.column("v").to_pylist()).astype(kind)
            out = [np.array(x, dtype=np.int64) for x in rows.column("out").to_pylist()]
            yield told([b * slices + turn % slices for b in range(blocks)], 1, ids, v, [])
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                yield told([int(b) * slices + s for s in range(slices)], 0, ids[at], v[at], [out[i] for i in at])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= CELL_ROWS:
                rows = pa.Table.from_batches(held)
                held = rows.slice(CELL_ROWS).combine_chunks().to_batches()
                yield from sent(rows.slice(0, CELL_ROWS))
                turn += 1
        if sum(x.num_rows for x in held):
            yield from sent(pa.Table.from_batches(held))

    def unit(row: dict) -> np.ndarray:
        x = np.frombuffer(row["v"].as_buffer(), dtype=kind).reshape(row["n"].as_py(), -1).astype(float)
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)

    def numbers(row: dict, name: str) -> np.ndarray:
        return np.frombuffer(row[name].as_buffer(), dtype=np.int64)

    def met(batches) -> Iterator[pa.RecordBatch]:
        parts, best = [], None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                if not row["kind"].as_py():
                    parts.append((numbers(row, "ids"), unit(row), np.split(numbers(row, "out"), np.cumsum(numbers(row, "sizes"))[:-1])))
                    continue
                if best is None and parts:
                    best = Best(np.concatenate([x for x, *_ in parts]), np.concatenate([x for _, x, _ in parts]), [o for *_, out in parts for o in out], k, least)
                    parts = []
                if best is not None:
                    best.meet(numbers(row, "ids"), unit(row))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["source", "target", "score"])

    dealt = rows.mapInArrow(packed, cell).select(F.explode("tasks").alias("task"), *names[1:]).repartitionById(blocks * slices, F.col("task")).sortWithinPartitions("kind")
    pairs = dealt.mapInArrow(met, "source long, target long, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target")))
    return ranked.where(F.col("rank") <= k)


class Best:
    """The k best others so far of some rows (of length one), of equals the smallest ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, out: list[np.ndarray], k: int, least: float):
        self.ids, self.v, self.out, self.k, self.least = ids, v, out, k, least
        self.score, self.target = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        self.banned = any(len(x) for x in out)

    def meet(self, ids: np.ndarray, v: np.ndarray, strip: int = 256) -> None:
        for at in range(0, len(self.ids), strip):
            scores = self.v[at : at + strip] @ v.T
            reach = np.maximum(self.score[at : at + strip, -1], self.least)[:, None]
            if not np.isfinite(self.score[at : at + strip, -1]).all() and len(ids) > self.k:
                # Nothing to compare with yet: of each row those that reach its k-th score are looked at, not all.
                scores[self.ids[at : at + strip, None] == ids] = -np.inf
                if self.banned:
                    for i, out in enumerate(self.out[at : at + strip]):
                        scores[i, np.isin(ids, out)] = -np.inf
                scores[np.isnan(scores)] = -np.inf
                reach = np.maximum(reach, np.round(np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None], 6))
            i, j = np.nonzero(scores >= reach - 1e-6)
            score = np.round(scores[i, j], 6)
            keep = (score >= reach[i, 0]) & np.isfinite(score) & (self.ids[at + i] != ids[j])
            i, j, score = i[keep], j[keep], score[keep]
            if self.banned:
                keep = np.array([ids[y] not in self.out[at + x] for x, y in zip(i, j)], dtype=bool)
                i, j, score = i[keep], j[keep], score[keep]
            if len(i):
                self._take(at + i, ids[j], score)

    def _take(self, row: np.ndarray, target: np.ndarray, score: np.ndarray) -> None:
        some = np.unique(row)
        rows = np.r_[np.repeat(some, self.k), row]
        targets, scores = np.r_[self.target[some].reshape(-1), target], np.r_[self.score[some].reshape(-1), score]
        order = np.lexsort([targets, -scores, rows])
        rows, targets, scores = rows[order], targets[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < self.k
        self.score[rows[first], place[first]], self.target[rows[first], place[first]] = scores[first], targets[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.isfinite(self.score))
        return self.ids[i], self.target[i, j], self.score[i, j]


def to_bytes(vector: list[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def from_bytes(data: bytes) -> list[float]:
    return np.frombuffer(data[: len(data) // 4 * 4], dtype="<f4").tolist()


class Hashed:
    """The encoder that is always there: ``embedded`` tokens."""

    def ready(self) -> bool:
        return True

    def dim(self) -> int:
        return T.DIM

    def encode(self, rows: DataFrame, text: str) -> DataFrame:
        return embedded(rows.withColumn("__words", T.tokens(F.col(text))), "__words").drop("__words")


def chosen(encoders: list) -> object:
    """The first encoder of a list that is ready (one whose model isn't there is passed over), else the hashed one."""
    return next((e for e in encoders if e.ready()), Hashed())
