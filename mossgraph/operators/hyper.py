"""Hyperdimensional computing: token vectors, bundles, text and neighbourhood vectors, key-value and complex memories."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks, graph, placing
from .graph import checkpointed as graph_cut
from .graph import written as graph_written

DIM = 10_000
#: Links from which a note's are counted in chunks, and how many of those it then has.
HUB, CHUNKS = 20_000, 256
_M64 = (1 << 64) - 1


def _seed_words(state: int) -> np.ndarray:
    """Eight 32-bit key words from a 64-bit seed, by the PCG32 steps that expand short seeds (public algorithm)."""
    out = []
    for _ in range(8):
        state = (state * 6364136223846793005 + 11634580027462260723) & _M64
        mixed = (((state >> 18) ^ state) >> 27) & 0xFFFFFFFF
        turn = state >> 59
        out.append(((mixed >> turn) | (mixed << (32 - turn) & 0xFFFFFFFF)) & 0xFFFFFFFF if turn else mixed)
    return np.array(out, dtype=np.uint32)


def _seeds_words(seeds: np.ndarray) -> np.ndarray:
    """``_seed_words`` of many seeds, as columns."""
    state, out = np.asarray(seeds, dtype=np.uint64), []
    u = np.uint64
    with np.errstate(over="ignore"):
        for _ in range(8):
            state = state * u(6364136223846793005) + u(11634580027462260723)
            mixed, turn = (((state >> u(18)) ^ state) >> u(27)) & u(0xFFFFFFFF), state >> u(59)
            out.append((mixed >> turn | mixed << ((u(32) - turn) & u(31))).astype(np.uint32))
    return np.stack(out)


def _blocks(key: np.ndarray, first: int, blocks: int, rounds: int = 8) -> np.ndarray:
    """Words (4, 4, seeds, blocks) of the ChaCha streams with these key words, from block ``first``; all blocks at once.

    The 16 words of a block are four rows of four, so a round is four steps on whole rows, before and after the rows are
    turned against each other."""
    start = np.zeros((4, 4, key.shape[1], blocks), dtype=np.uint32)
    start[0] = np.frombuffer(b"expand 32-byte k", dtype="<u4")[:, None, None]
    start[1:3] = key.reshape(2, 4, -1, 1)
    start[3, 0] = np.arange(first, first + blocks, dtype=np.uint32)
    a, b, c, d = start.copy()

    def half(x: np.ndarray, y: np.ndarray, z: np.ndarray, turn: int) -> None:
        x += y
        z ^= x
        low = z >> np.uint32(32 - turn)
        z <<= np.uint32(turn)
        z |= low

    with np.errstate(over="ignore"):
        for k in range(rounds):
            half(a, b, d, 16)
            half(c, d, b, 12)
            half(a, b, d, 8)
            half(c, d, b, 7)
            shift = -1 if k % 2 == 0 else 1
            b, c, d = np.roll(b, shift, axis=0), np.roll(c, 2, axis=0), np.roll(d, -shift, axis=0)
        return np.stack([a, b, c, d]) + start


def chacha_streams(seeds: list[int], n: int, rounds: int = 8) -> np.ndarray:
    """The first n 32-bit words of the ChaCha stream of each seed, as rows."""
    x = _blocks(_seeds_words(np.array(seeds, dtype=np.uint64)), 0, -(-n // 16), rounds)
    return x.transpose(2, 3, 0, 1).reshape(len(seeds), 16 * x.shape[3])[:, :n]


#: Blocks of words drawn at once, which stay in a core's cache.
DRAWN = 20_000


def _low_bits(key: np.ndarray, first: int, blocks: int, rounds: int = 8) -> np.ndarray:
    """The low bits of ``_blocks``' words, 16 to a number, as rows; words are apart, so no row is turned."""
    start = [np.full((key.shape[1], blocks), x, dtype=np.uint32) for x in np.frombuffer(b"expand 32-byte k", dtype="<u4")]
    start += [np.repeat(x[:, None], blocks, axis=1) for x in key]
    start += [np.broadcast_to(np.arange(first, first + blocks, dtype=np.uint32), start[0].shape).copy(), *[np.zeros_like(start[0]) for _ in range(3)]]
    x, low = [w.copy() for w in start], np.empty_like(start[0])

    def half(i: int, j: int, k: int, turn: int) -> None:
        np.add(x[i], x[j], out=x[i])
        np.bitwise_xor(x[k], x[i], out=x[k])
        np.right_shift(x[k], np.uint32(32 - turn), out=low)
        np.left_shift(x[k], np.uint32(turn), out=x[k])
        np.bitwise_or(x[k], low, out=x[k])

    for k in range(rounds):
        for i in range(4):
            b, c, d = (4 + i, 8 + i, 12 + i) if k % 2 == 0 else (4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
            half(i, b, d, 16)
            half(c, d, b, 12)
            half(i, b, d, 8)
            half(c, d, b, 7)
    out = np.zeros(start[0].shape, dtype=np.uint16)
    for i in range(16):
        out |= ((x[i] ^ start[i]) & np.uint32(1)).astype(np.uint16) << np.uint16(i)
    return out


def drawn(key: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places lo (a multiple of 16) to hi of the seeds' vectors, packed, a row each; any part of a stream can be drawn alone."""
    out = np.empty((key.shape[1], -(-(hi - lo) // 8)), dtype=np.uint8)
    blocks = -(-(hi - lo) // 16)
    step = max(1, DRAWN // blocks)
    for k in range(0, key.shape[1], step):
        out[k : k + step] = (~_low_bits(key[:, k : k + step], lo // 16, blocks)).astype("<u2").view(np.uint8)[:, : out.shape[1]]
    if (hi - lo) % 8 and len(out):
        out[:, -1] &= (1 << (hi - lo) % 8) - 1
    return out


def chacha_words(seed: int, n: int, rounds: int = 8) -> np.ndarray:
    return chacha_streams([seed], n, rounds)[0]


def random_vector(seed: int, dim: int = DIM) -> np.ndarray:
    """Bipolar vector of a seed: the low bit of each word, 0 to +1."""
    return np.where(chacha_words(seed, dim) & 1, -1, 1).astype(np.int8)


class Tokens(dict):
    """Vectors of tokens, each drawn once; a bounded memory."""

    def __init__(self, dim: int = DIM, most: int = 4_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        self[token] = v = random_vector(T.fnv1a(token), self.dim)
        return v


def bundle(vectors: list[np.ndarray], dim: int = DIM) -> np.ndarray:
    """Sign of the sum, ties to +1; nothing gives +1 everywhere."""
    total = np.zeros(dim, dtype=np.int32)
    for v in vectors:
        total += v
    return np.where(total >= 0, 1, -1).astype(np.int8)


def permute(v: np.ndarray, k: int = 1) -> np.ndarray:
    return np.roll(v, k)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.astype(np.int32) @ b.astype(np.int32)) / len(a)


def packed(v: np.ndarray) -> bytes:
    """One bit a place, lowest first, +1 as 1."""
    return np.packbits(v > 0, bitorder="little").tobytes()


def unpacked(data: bytes, dim: int = DIM) -> np.ndarray:
    return np.where(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[:dim], 1, -1).astype(np.int8)


def text_vector(words: list[str], tokens: Tokens) -> np.ndarray:
    """Tokens and their neighbours: each pair binds the left with the shifted right."""
    return bundle([*(tokens[w] for w in words), *(tokens[a] * permute(tokens[b]) for a, b in zip(words, words[1:]))], tokens.dim)


def ones(rows: np.ndarray, width: int) -> np.ndarray:
    """For each place, how many of the packed rows are +1 there; counted in bytes, eight places at once."""
    out = np.zeros(width, dtype=np.int64)
    for k in range(0, len(rows), 248):
        bits = np.unpackbits(rows[k : k + 248], axis=1, bitorder="little")
        if bits.shape[1] % 8:
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
        out += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)[:width]
    return out


def planes(rows: np.ndarray) -> list[np.ndarray]:
    """Bits of the number of ones at each place of packed rows (the first axis), the lowest first: full adders take three rows to two."""
    out = []
    while len(rows):
        carries = []
        while (n := len(rows)) > 1:
            t = max(1, n // 3)
            a, b = rows[:t], rows[t : 2 * t]
            both, x = a & b, a ^ b
            if n > 2:
                c = rows[2 * t : 3 * t]
                a = x & c
                both |= a
                x ^= c
            carries.append(both)
            rows = np.concatenate([x, rows[3 * t :]]) if n > 3 * t else x
        out.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    return out


def reached(bits: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """For each place of a note whether its number is at least the note's least."""
    more, same = np.zeros_like(bits[0]), np.full_like(bits[0], ~np.uint64(0))
    for k in reversed(range(max(len(bits), int(least.max()).bit_length()))):
        want = np.where(least >> k & 1, ~np.uint64(0), np.uint64(0))[:, None]
        own = bits[k] if k < len(bits) else np.zeros_like(bits[0])
        more |= same & own & ~want
        same &= ~(own ^ want)
    return more | same


#: Bytes of rows that are added up at once, which stay near a core, and rows of a note from which places are counted instead.
ADDED, COUNTED = 2_000_000, 4_096


def majority(table: np.ndarray, sizes: np.ndarray, index: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The sign (ties to +1) of the sum of each note's rows of a table, which are index in a row, and of its own row; all packed in words.

    Notes of about as many rows go together; rows of zeros fill up the smaller ones."""
    width, more = table.shape[1], 0 if own is None else 1
    out = np.empty((len(sizes), width), dtype=np.uint64)
    stop, least = np.cumsum(sizes), (sizes + more + 1) // 2
    full = -(-sizes // 4) * 4
    for size in np.unique(full):
        notes = np.flatnonzero(full == size)
        if size > COUNTED:
            for n in notes:
                places = sum(ones(table[part].view(np.uint8), 64 * width) for part in np.split(index[stop[n] - sizes[n] : stop[n]], range(COUNTED, sizes[n], COUNTED)))
                places = places if own is None else places + np.unpackbits(own[n].view(np.uint8), bitorder="little")
                out[n] = np.packbits(places >= least[n], bitorder="little").view(np.uint64)
            continue
        step = max(1, ADDED // (8 * width * (int(size) + 1)))
        for k in range(0, len(notes), step):
            n = notes[k : k + step]
            at = (stop[n] - sizes[n]) + np.arange(size)[:, None]
            short = np.arange(size)[:, None] >= sizes[n]
            rows = np.empty((int(size) + more, len(n), width), dtype=np.uint64)
            if size:
                np.take(table, index[np.where(short, 0, at)], axis=0, out=rows[more:], mode="clip")
                rows[more:][short] = 0
            if more:
                rows[0] = own[n]
            out[n] = reached(planes(rows), least[n]) if len(rows) else ~np.uint64(0)
    return out


def in_words(rows: np.ndarray) -> np.ndarray:
    """Packed rows of bytes as rows of words, filled up with zeros."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64)


class Words(dict):
    """Packed vectors of tokens and the same shifted, each drawn once; a bounded memory."""

    def __init__(self, dim: int = DIM, most: int = 20_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= self.most:
            self.clear()
        v = random_vector(T.fnv1a(token), self.dim)
        self[token] = rows = tuple(np.frombuffer(packed(x), dtype=np.uint8) for x in (v, permute(v)))
        return rows

    def learn(self, words: set[str]) -> None:
        """Draw the tokens that aren't known, together."""
        words = sorted(w for w in words if w not in self)
        if len(self) + len(words) > self.most:
            self.clear()
        for lo in range(0, min(len(words), self.most), 256):
            some = words[lo : lo + 256]
            rows = in_words(drawn(_seeds_words(np.array([T.fnv1a(w) for w in some], dtype=np.uint64)), 0, self.dim))
            turned = rows << np.uint64(1)
            turned[:, 1:] |= rows[:, :-1] >> np.uint64(63)
            turned[:, 0] |= rows[:, (self.dim - 1) // 64] >> np.uint64((self.dim - 1) % 64) & np.uint64(1)
            rows, turned = (np.ascontiguousarray(x.view(np.uint8)[:, : -(-self.dim // 8)]) for x in (rows, turned))
            if self.dim % 8:
                turned[:, -1] &= (1 << self.dim % 8) - 1
            self.update(zip(some, zip(rows, turned)))

    def text(self, words: list[str]) -> bytes:
        """``text_vector``, packed: a pair's product is +1 where the bits of the left and of the shifted right are equal."""
        if not words:
            return packed(np.ones(self.dim, dtype=np.int8))
        rows = [self[w] for w in words]
        own, turned = (np.stack(x) for x in zip(*rows))
        every = np.concatenate([own, ~(own[:-1] ^ turned[1:])])
        return np.packbits(2 * ones(every, self.dim) >= len(every), bitorder="little").tobytes()


def texts_of(lists: list, tokens: Words) -> np.ndarray:
    """``text_vector`` of many texts, packed in words."""
    out = np.empty((len(lists), -(-tokens.dim // 64)), dtype=np.uint64)
    for lo in range(0, len(lists), 500):
        rows, sizes = [], []
        tokens.learn({w for words in lists[lo : lo + 500] for w in words})
        for words in lists[lo : lo + 500]:
            held = [tokens[w] for w in words]
            rows += [x for x, _ in held] + [~(a ^ b) for (a, _), (_, b) in zip(held, held[1:])]
            sizes.append(max(0, 2 * len(held) - 1))
        table = in_words(np.stack(rows)) if rows else np.zeros((0, out.shape[1]), dtype=np.uint64)
        out[lo : lo + 500] = majority(table, np.array(sizes), np.arange(len(rows)))
    return out


def encoded(docs: DataFrame, id_col: str = "id", words: str = "tokens", dim: int = DIM) -> DataFrame:
    """id, hv: packed vectors, one bit a place (1250 bytes at 10 000)."""

    def each(frames):
        tokens = Words(dim)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "hv": [tokens.text(list(w)) for w in frame["tokens"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(words).alias("tokens")).mapInPandas(each, "id long, hv binary")


#: Bytes of vectors that a task draws at once, and links of the notes that it sums together.
REMEMBERED, LINKS = 64 << 20, 4_000_000


def neighbourhoods(out: list, into: list, dim: int = DIM):
    """lo, hi, row, sums: for a range of places at a time and each note (row), the sum of the vectors of the notes it links to and of
    the shifted vectors of those that link to it.

    Every different neighbour is drawn once, in ranges of places small enough that all of them fit ``REMEMBERED``."""
    sizes = [np.array([0 if x is None else len(x) for x in side], dtype=np.int64) for side in (out, into)]
    named = [np.concatenate([np.zeros(0, dtype=np.int64), *(x for x in side if x is not None)]).astype(np.int64) for side in (out, into)]
    distinct, place = np.unique(np.concatenate(named), return_inverse=True)
    (a, b), ends = np.split(place, [len(named[0])]), [np.cumsum(s) for s in sizes]
    key = _seeds_words(np.array([T.fnv1a(f"note:{n}") for n in distinct.tolist()], dtype=np.uint64))
    width = min(dim, max(64, 8 * REMEMBERED // max(1, len(distinct)) // 64 * 64))
    last = (dim - 1) // 16 * 16
    before = np.unpackbits(drawn(key, last, dim), axis=1, bitorder="little")[:, dim - 1 - last] if len(distinct) else np.zeros(0, dtype=np.uint8)
    for lo in range(0, dim, width):
        hi = min(dim, lo + width)
        rows = drawn(key, lo, hi)
        for k, (n_out, n_into, o, i) in enumerate(zip(*sizes, *ends)):
            mine, theirs = a[o - n_out : o], b[i - n_into : i]
            shifted = np.r_[before[theirs].sum(dtype=np.int64), ones(rows[theirs], hi - lo)[:-1]]
            yield lo, hi, k, 2 * (ones(rows[mine], hi - lo) + shifted) - n_out - n_into
        before = np.unpackbits(rows[:, -1:], axis=1, bitorder="little")[:, (hi - lo - 1) % 8]


def gathered(frames, links: int = LINKS):
    """Batches put together until their notes have that many links, so that neighbours they share are drawn once."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += sum(len(x) for side in ("out", "into") for x in frame[side] if x is not None)
        if size >= links:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def combined(texts: DataFrame, edges: DataFrame, dim: int = DIM) -> DataFrame:
    """id, hv of each note with its links: its text, the notes it links to, and the shifted notes that link to it.

    Notes are dealt into bands by their ids, since near ids tend to share neighbours, and a task draws each different neighbour of
    a band once.  A hub's neighbours are counted in chunks of its links first, so it is many tasks' work, and only sums of places meet."""
    edges = graph_written(edges.select("src", "dst"))
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("shift"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("shift"), F.col("src").alias("other")))))
    hubs = graph_cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > HUB).select("id"))
    marked = F.broadcast(hubs.withColumn("__hub", F.lit(True)))
    listed = lambda rows, *key: rows.groupBy(*key).agg(F.collect_list(F.when(F.col("shift") == 0, F.col("other"))).alias("out"), F.collect_list(F.when(F.col("shift") == 1, F.col("other"))).alias("into"))
    near = listed(ends.join(F.broadcast(hubs), "id", "left_anti"), "id")
    n, parallel = edges.count(), edges.sparkSession.sparkContext.defaultParallelism
    bands = max(1, min(parallel, n // 20_000), 2 * n // LINKS)
    cuts = edges.agg(F.percentile_approx("src", [k / bands for k in range(1, bands)], 10_000)).first()[0] if bands > 1 and n else []
    band = F.aggregate(F.array(*[F.lit(x).cast("long") for x in cuts]), F.lit(0), lambda s, x: s + (x <= F.col("id")).cast("int")) if cuts else F.lit(0)

    def each(frames):
        for frame in gathered(frames):
            made = np.empty((len(frame), -(-dim // 8)), dtype=np.uint8)
            own = np.frombuffer(b"".join(frame["hv"]), dtype=np.uint8).reshape(made.shape)
            for lo, hi, k, sums in neighbourhoods(frame["out"].tolist(), frame["into"].tolist(), dim):
                span = slice(lo // 8, -(-hi // 8))
                made[k, span] = np.packbits(sums + 2 * np.unpackbits(own[k, span], bitorder="little")[: hi - lo].astype(np.int64) > 0, bitorder="little")
            for at in range(0, len(frame), 2_000):
                yield pd.DataFrame({"id": frame["id"].iloc[at : at + 2_000], "hv": [v.tobytes() for v in made[at : at + 2_000]]})

    plain = texts.join(F.broadcast(hubs), "id", "left_anti").join(near, "id", "left").select("id", "hv", "out", "into")
    made = plain.repartitionById(bands, band).mapInPandas(each, "id long, hv binary")
    if hubs.isEmpty():
        return made

    def parts(frames):
        for frame in (f.iloc[at : at + 256] for f in frames for at in range(0, len(f), 256)):
            sums = np.empty((len(frame), dim), dtype="<i4")
            for lo, hi, k, found in neighbourhoods(frame["out"].tolist(), frame["into"].tolist(), dim):
                sums[k, lo:hi] = found
            yield pd.DataFrame({"id": frame["id"], "part": [x.tobytes() for x in sums]})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, dtype="<i4").astype(np.int64) for p in frame["part"])
        return pd.DataFrame({"id": frame["id"].iloc[:1], "hv": [packed(np.where(unpacked(frame["hv"].iloc[0], dim) + total >= 0, 1, -1))]})

    whole = listed(ends.join(marked, "id").withColumn("chunk", F.pmod(F.xxhash64("other"), F.lit(CHUNKS))), "id", "chunk")
    summed = whole.select("id", "out", "into").mapInPandas(parts, "id long, part binary").join(texts, "id")
    return made.unionByName(summed.groupBy("id").applyInPandas(joined, "id long, hv binary"))


def bundled(sizes: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], ids: np.ndarray, own: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Packed words of the notes: the sign of the text (own), of the notes they link to and of the shifted ones that link to them.

    sizes, others: how many of both each has, and which of ``ids`` those are.  Each of ids is drawn once, in ranges of places small
    enough that all of them fit ``REMEMBERED``."""
    key = _seeds_words(np.array([T.fnv1a(f"note:{n}") for n in ids.tolist()], dtype=np.uint64))
    m, n = len(ids), sizes[0] + sizes[1]
    # A note's rows of both kinds next to each other; the shifted ones lie in the second half of the table.
    index = np.empty(int(n.sum()), dtype=np.int64)
    begin = np.cumsum(n) - n
    for side, first, add in ((0, begin, 0), (1, begin + sizes[0], m)):
        size = sizes[side]
        index[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)] = others[side] + add
    width = min(-(-dim // 64) * 64, max(64, 4 * REMEMBERED // max(1, m) // 64 * 64))
    last = (dim - 1) // 16 * 16
    before = (drawn(key, last, dim)[:, (dim - 1 - last) // 8] >> (dim - 1) % 8 & 1).astype(np.uint64) if m else np.zeros(0, dtype=np.uint64)
    out = np.empty_like(own)
    for lo in range(0, dim, width):
        span = slice(lo // 64, -(-min(dim, lo + width) // 64))
        rows = in_words(drawn(key, lo, min(dim, lo + width)))
        shifted = rows << np.uint64(1)
        shifted[:, 1:] |= rows[:, :-1] >> np.uint64(63)
        shifted[:, 0] |= before
        before = rows[:, -1] >> np.uint64(63)
        out[:, span] = majority(np.concatenate([rows, shifted]), n, index, np.ascontiguousarray(own[:, span]))
    return out


def over_blocks(made: blocks.Blocks, tokens: DataFrame, dim: int = DIM) -> DataFrame:
    """id, hv of each text (id, tokens), as ``combined`` gives them; a block draws each different neighbour of its notes once."""

    def each(own: pa.Table, texts: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"id": pa.array([], pa.int64()), "hv": pa.array([], pa.binary())})
        ids = texts.column("id").to_numpy()
        out = [np.zeros(len(ids), dtype=np.int64)] * 2, [np.zeros(0, dtype=np.int64)] * 2
        known = ids[:0]
        if len(own):
            row = {c: own.column(c)[0] for c in own.schema.names}
            nodes, begin, near, _ = blocks.read(row)
            known = np.r_[nodes, np.frombuffer(row["needed"].as_buffer(), dtype=np.int64)]
            place = np.searchsorted(nodes, ids).clip(max=max(0, len(nodes) - 1))
            size = np.where(nodes[place] == ids, np.diff(begin)[place], 0) if len(nodes) else out[0][0]
            stop, who = np.cumsum(size), np.repeat(np.arange(len(ids)), size)
            at = near[np.arange(stop[-1]) + np.repeat(begin[place] - stop + size, size)] if len(nodes) else near[:0]
            up = known[at] > ids[who]
            out = [np.bincount(who[x], minlength=len(ids)) for x in (up, ~up)], [at[x] for x in (up, ~up)]
        vectors = bundled(tuple(out[0]), tuple(out[1]), known, texts_of(texts.column("tokens").to_pylist(), Words(dim)), dim)
        raw = np.ascontiguousarray(vectors.view(np.uint8)[:, : -(-dim // 8)])
        if dim % 8 and len(raw):
            raw[:, -1] &= (1 << dim % 8) - 1
        return pa.table({"id": ids, "hv": pa.array([v.tobytes() for v in raw], pa.binary())})

    with placing._set(tokens.sparkSession, adaptive="false"):
        dealt = blocks.owned(tokens.select(F.col("id").cast("long").alias("id"), "tokens").where("id IS NOT NULL"), made).repartition(made.count, "block")
        return graph_written(made.held.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(each, "id long, hv binary"))


def related(vectors: DataFrame, query: bytes, k: int, dim: int = DIM) -> DataFrame:
    """id, score: the k most similar to a packed query; bits are compared packed, inside the scan."""
    wanted = np.frombuffer(query, dtype=np.uint8)

    @F.pandas_udf("double")
    def score(hv: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(hv), dtype=np.uint8).reshape(len(hv), -1)
        return pd.Series(1 - 2 * np.bitwise_count(rows ^ wanted).sum(axis=1, dtype=np.int64) / dim)

    return vectors.select("id", F.round(score("hv"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Rows that a block of ``packed_topk`` should hold, and rows of another block that one row meets in a step.
BLOCK_ROWS, STEP = 2048, 512


def packed_topk(vectors: DataFrame, k: int, least: float, linked: DataFrame | None = None, dim: int = DIM, blocks: int | None = None) -> DataFrame:
    """source, target, score, rank: each packed vector's k most similar others of at least ``least`` that it isn't linked to.

    Exact: rows are hashed into blocks and each pair of blocks meets once, for both directions; bits stay packed (a row is
    dim / 8 bytes) and differing ones are counted 64 at a time.  Work is quadratic, memory is that of two blocks."""
    if blocks is None:
        blocks = vectors.count() // BLOCK_ROWS + 1
    rows = vectors.select("id", "hv", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    if linked is not None:
        out = linked.groupBy(F.col("source").alias("id")).agg(F.collect_set("target").alias("out"))
        rows = rows.join(out, "id", "left")
    else:
        rows = rows.withColumn("out", F.lit(None).cast("array<long>"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select("id", "hv", "out", F.explode(F.filter(every, lambda b: b >= F.col("block"))).alias("b"), "block").select("id", "hv", "out", F.struct(F.col("block").alias("a"), "b").alias("pair"))
    right = rows.select("id", "hv", "out", F.explode(F.filter(every, lambda a: a <= F.col("block"))).alias("a"), "block").select(F.col("id").alias("id2"), F.col("hv").alias("hv2"), F.col("out").alias("out2"), F.struct("a", F.col("block").alias("b")).alias("pair"))
    limit, words = math.floor((1 - least) / 2 * dim + 1e-9), -(-dim // 64)

    def bits(frame: pd.DataFrame) -> np.ndarray:
        size = -(-dim // 8)
        held = np.zeros((len(frame), words * 8), dtype=np.uint8)
        held[:, :size] = np.frombuffer(b"".join(frame["hv"]), dtype=np.uint8).reshape(-1, size)
        return held.view(np.uint64)

    def best(src: np.ndarray, dst: np.ndarray, differs: np.ndarray, own: pd.DataFrame, ids: np.ndarray) -> pd.DataFrame:
        order = np.lexsort([ids[dst], differs, src])
        src, dst, differs = src[order], dst[order], differs[order]
        keep = np.ones(len(src), dtype=bool)
        for at in np.unique(src):
            span = slice(*np.searchsorted(src, [at, at + 1]))
            if own["out"].iloc[at] is not None:
                keep[span] &= ~np.isin(ids[dst[span]], np.asarray(own["out"].iloc[at]))
            keep[span] &= np.cumsum(keep[span]) <= k
        return pd.DataFrame({"source": own["id"].to_numpy()[src[keep]], "target": ids[dst[keep]], "score": np.round(1 - 2 * differs[keep] / dim, 6)})

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"source": [], "target": [], "score": []})
        if not len(a) or not len(b):
            return none
        b = b.rename(columns={"id2": "id", "hv2": "hv", "out2": "out"})
        a_bits, b_bits, a_ids, b_ids = bits(a), bits(b), a["id"].to_numpy(), b["id"].to_numpy()
        found = []
        for at in range(0, len(b), STEP):
            other = b_bits[at : at + STEP]
            for i in range(len(a)):
                differs = np.bitwise_count(a_bits[i] ^ other).sum(axis=1, dtype=np.int32)
                hit = np.flatnonzero((differs <= limit) & (a_ids[i] != b_ids[at : at + STEP]))
                if len(hit):
                    found.append((np.full(len(hit), i), at + hit, differs[hit]))
        if not found:
            return none
        src, dst, differs = (np.concatenate(x) for x in zip(*found))
        one = best(src, dst, differs, a, b_ids)
        # A block that meets itself has each pair in both directions already.
        return one if set(a_ids) == set(b_ids) else pd.concat([one, best(dst, src, differs, b, a_ids)])

    pairs = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(met, "source long, target long, score double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= k)


def features(edges: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """id, feature, weight (unit length a note): what a note's vector is made of, as ``combined`` weighs it.

    A note's text, each note it links to and each that links to it count one; the text's share is dealt to its tokens and
    their neighbours (id, tokens)."""
    ends = edges.select(F.col("src").alias("id"), F.struct(F.lit("o").alias("k"), F.col("dst").cast("string").alias("v")).alias("feature")).unionByName(edges.select(F.col("dst").alias("id"), F.struct(F.lit("i").alias("k"), F.col("src").cast("string").alias("v")).alias("feature")))
    parts = ends.distinct().withColumn("w", F.lit(1.0))
    if tokens is not None:
        words = tokens.select("id", F.explode(F.concat("tokens", T.bigrams(F.col("tokens")))).alias("t")).groupBy("id", "t").agg(F.count(F.lit(1)).cast("double").alias("n"))
        norm = words.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
        parts = parts.unionByName(words.join(norm, "id").select("id", F.struct(F.lit("t").alias("k"), F.col("t").alias("v")).alias("feature"), (F.col("n") / F.col("norm")).alias("w")))
    size = parts.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return parts.join(size, "id").select("id", "feature", (F.col("w") / F.col("size")).alias("weight"))


def margin(least: float, dim: int = DIM) -> float:
    """Cosine of two notes' features below which their vectors don't reach a similarity, but for chance of 3.5 deviations.

    Two sums of random signs agree in sign by the arc sine of their correlation, and the features' cosine is no less
    than that correlation (the text's share of it comes through an arc sine of its own)."""
    return math.sin(math.pi / 2 * max(0.0, least - 3.5 / math.sqrt(dim)))


def prefixed(weights: DataFrame, least: float) -> DataFrame:
    """weights of the features that a pair of at least this cosine has to share: each note's, rarest first, up to where the
    rest is shorter than the cosine; with ``df``, the number of notes that keep the feature."""
    often = weights.groupBy("feature").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id").orderBy(F.desc("often"), "feature")  # a note's own features
    rest = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = weights.join(often, "feature").withColumn("rest", rest).where(F.col("rest") >= least * least - 1e-12).select("id", "feature", "weight")
    return kept.join(kept.groupBy("feature").agg(F.count(F.lit(1)).alias("df")), "feature")


#: Features of notes that a block of ``candidates`` holds, and notes up to which a table's blocks aren't used for pairs.
FEATURES, PAIRED = 5_000_000, 20_000


def candidates(weights: DataFrame, kept: DataFrame, least: float, features: int | None = None) -> DataFrame:
    """a, b (a < b): notes whose features have at least this cosine; exact.

    Notes are dealt into blocks by ranges of ids.  A note's features go once to each block in which a note has a feature that it keeps, and
    its products with all notes of the block are summed there.  What a note doesn't keep is shorter than the cosine asked for, so a
    pair whose sum over the kept features stays below by more than that length is done; the others are summed over all features."""
    n, parallel = weights.count(), weights.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(parallel, n // 50_000), -(-n // (features or FEATURES)))
    cuts = weights.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    block = functools.reduce(lambda s, x: s + (F.col("id") >= F.lit(x)).cast("int"), cuts, F.lit(0))
    # Features by a hash; two of one hash would only add to a sum, so no pair is lost, and vectors are compared afterwards.
    code = F.xxhash64("feature").alias("code")
    rows = weights.select("id", code, F.col("weight"), F.lit(False).alias("k")).unionByName(kept.select("id", code, F.col("weight"), F.lit(True).alias("k")))
    lists = rows.groupBy("id").agg(F.collect_list(F.when(~F.col("k"), F.struct("code", "weight"))).alias("f"), F.collect_list(F.when(F.col("k"), F.col("code"))).alias("kept"))
    there = weights.select(code, block.alias("task")).distinct()
    meets = kept.where("df > 1").select("id", code, block.alias("own")).join(there, "code").where("task >= own").select("id", "task").distinct()
    shape = ["id", F.col("f.code").alias("codes"), F.col("f.weight").alias("weights"), "kept"]
    lists = graph_written(lists)
    sent = lists.select(block.alias("task"), F.lit(0).alias("kind"), *shape).unionByName(lists.join(meets, "id").select("task", F.lit(1).alias("kind"), *shape))
    dealt = sent.repartitionById(blocks, F.col("task")).sortWithinPartitions("task", "kind")

    def each(batches):
        at, parts, held = None, [], None
        for task, kind, rows in graph._runs(batches):
            if at != task:
                at, parts, held = task, [], None
            ids, (sizes, codes), (_, lengths) = rows.column("id").to_numpy(), graph._flat(rows.column("codes")), graph._flat(rows.column("weights"))
            if not kind:
                parts.append((ids, sizes, codes, lengths))
                continue
            if held is None:
                held, parts = _postings(*(np.concatenate(x) for x in zip(*parts))), []
            found = _near(ids, sizes, codes, lengths, *graph._flat(rows.column("kept")), *held, least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return dealt.mapInArrow(each, "a long, b long")


def _postings(ids, sizes, codes, lengths) -> tuple[np.ndarray, ...]:
    """The notes, the different features in order, where each one's notes begin and end, those notes by place, and their weights."""
    order = np.argsort(codes, kind="stable")
    known, begin = np.unique(codes[order], return_index=True)
    return ids, known, begin, np.r_[begin[1:], len(codes)], np.repeat(np.arange(len(ids)), sizes)[order], lengths[order]


def _near(a, sizes, codes, lengths, kept_sizes, kept, ids, known, begin, stop, notes, weights, least) -> tuple[np.ndarray, np.ndarray]:
    """a, b of the pairs of at least this cosine."""
    place = np.searchsorted(known, codes)
    place[place == len(known)] = 0
    begins, count = begin[place], np.where(known[place] == codes, stop[place] - begin[place], 0)

    def sums(which: np.ndarray) -> np.ndarray:
        size = count[which]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(begins[which] - end + size, size)
        return np.bincount(notes[at], weights[at] * np.repeat(lengths[which], size), len(ids))

    pairs = [], []
    lo = k0 = 0
    for note, hi, k1 in zip(a, np.cumsum(sizes), np.cumsum(kept_sizes)):
        keeps = np.isin(codes[lo:hi], kept[k0:k1])
        mine, rest = lo + np.flatnonzero(keeps), lo + np.flatnonzero(~keeps)
        dot = sums(mine)
        if ((dot >= least - math.sqrt((lengths[rest] ** 2).sum()) - 1e-9) & (ids > note)).any():
            near = ids[(dot + sums(rest) >= least) & (ids > note)]
            pairs[0].append(np.full(len(near), note))
            pairs[1].append(near)
        lo, k0 = hi, k1
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in pairs)


def candidates_of_blocks(made: blocks.Blocks, tokens: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), linked (a links to b): at least the notes whose features have this cosine; made is closed.

    A block sums the links that its notes share; the texts of such notes count as if they were the same, so no pair is lost.  Notes that
    share no link, as those of different blocks, are compared by their tokens where texts alone can reach the cosine."""

    def shares(ids: np.ndarray, texts: pa.Table, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each note's length and its text's share of that."""
        full = pc.greater(pc.fill_null(pc.list_value_length(texts.column("tokens")), 0), 0).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, dtype=bool)
        text = np.isin(ids, texts.column("id").to_numpy()[full] if len(texts) else ids[:0]).astype(float)
        size = np.sqrt(links + text).clip(1e-9)
        return size, text / size

    def notes(own: pa.Table, texts: pa.Table) -> tuple:
        row = {c: own.column(c)[0] for c in own.schema.names} if len(own) else None
        ids, begin, near, _ = blocks.read(row) if row else (np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32), None)
        extra = np.setdiff1d(texts.column("id").to_numpy(), ids) if len(texts) else ids[:0]
        every = np.r_[ids, extra]
        return every, np.r_[begin, np.full(len(extra), begin[-1])], near, *shares(every, texts, np.r_[np.diff(begin), np.zeros(len(extra), dtype=np.int64)])

    def near_in(own: pa.Table, texts: pa.Table) -> pa.Table:
        ids, begin, near, size, text = notes(own, texts)
        n, found = len(ids), [(ids[:0], ids[:0], np.zeros(0, dtype=bool))]
        row = np.repeat(np.arange(n), np.diff(begin))
        # A feature is a neighbour and which of both links to the other; ids of links are in order, texts' alone come after.
        code = np.where(ids[near] > ids[row], near, near + n)
        order = np.argsort(code, kind="stable")
        held, start = row[order], np.searchsorted(code[order], np.arange(2 * n + 1))
        weight = (1 / size)[held]
        for a in range(n):
            mine = code[begin[a] : begin[a + 1]]
            if not len(mine):
                continue
            count = start[mine + 1] - start[mine]
            stop = np.cumsum(count)
            at = np.arange(stop[-1]) + np.repeat(start[mine] - stop + count, count)
            dot = np.bincount(held[at], weight[at], n) / size[a]
            hit = np.flatnonzero((dot > 0) & (dot + text[a] * text >= least - 1e-9) & (ids > ids[a]))
            if len(hit):
                found.append((np.full(len(hit), ids[a]), ids[hit], np.isin(hit, near[begin[a] : begin[a + 1]])))
        return pa.table(dict(zip(("a", "b", "linked"), (np.concatenate(x) for x in zip(*found)))))

    def alone(own: pa.Table, texts: pa.Table) -> pa.Table:
        ids, _, _, size, text = notes(own, texts)
        keep = (text >= least - 1e-9) & (text > 0)
        return pa.table({"id": ids[keep], "size": size[keep]})

    with placing._set(tokens.sparkSession, adaptive="false"):
        dealt = blocks.owned(tokens.select(F.col("id").cast("long").alias("id"), "tokens").where("id IS NOT NULL"), made).repartition(made.count, "block")
        both = made.held.groupBy("block").cogroup(dealt.groupBy("block"))
        inside = graph_written(both.applyInArrow(near_in, "a long, b long, linked boolean"))
        short = graph_written(both.applyInArrow(alone, "id long, size double"))
    if short.isEmpty():
        return inside
    words = tokens.join(short, "id").select("id", "size", F.explode(F.concat("tokens", T.bigrams(F.col("tokens")))).alias("t")).groupBy("id", "size", "t").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = words.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    weights = graph_written(words.join(norm, "id").select("id", F.xxhash64("t").alias("feature"), (F.col("n") / F.col("norm") / F.col("size")).alias("weight")))
    told = candidates(weights, graph_written(prefixed(weights, least / 2)), least)
    return inside.unionByName(told.join(inside, ["a", "b"], "left_anti").select("a", "b", F.lit(False).alias("linked")))


def verified(pairs: DataFrame, vectors: DataFrame, least: float, dim: int = DIM) -> DataFrame:
    """source, target, score in both directions of the pairs (a, b) whose vectors are that similar; bits compared packed."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), -1) for v in (x, y))
        return pd.Series(1 - 2 * np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) / dim)

    held = pairs.join(vectors.select(F.col("id").alias("a"), F.col("hv").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("hv").alias("y")), "b")
    told = held.select("a", "b", F.round(score("x", "y"), 6).alias("score")).where(F.col("score") >= least)
    return told.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("p"), "score").select("p.*", "score")


def suggestions(vectors: DataFrame, edges: DataFrame, least: float = 0.18, per_source: int = 5, total: int = 100, dim: int = DIM, tokens: DataFrame | None = None, exact: bool | None = None, made: blocks.Blocks | None = None) -> DataFrame:
    """source, target, score, shared: similar notes that the source doesn't link to yet.

    Exact compares all pairs of vectors; otherwise vectors are compared where the notes' features (links and tokens) have
    the cosine that such a similarity comes from.  By default the way with less to do is taken: pairs that share a kept feature
    against all pairs, at a quarter each, since they have to be shuffled.  The ways differ by pairs that are similar by
    chance: of notes with one or three links, whose even sums tie (ties count as +1), or beyond 3.5 deviations.

    ``made``: closed blocks of the same edges, which find the pairs in a task each, instead of by all features."""
    edges = graph_written(edges.select("src", "dst"))
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    weights = kept = None
    if not exact and made is None:
        weights = graph_written(features(edges, tokens).withColumn("feature", F.xxhash64("feature")))
        # More than has to be shared is kept, so that a sum over it tells most pairs apart.
        kept = graph_written(prefixed(weights, margin(least, dim) / 2))
        if exact is None:
            shared = kept.groupBy("feature").agg(F.first("df").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
            n = vectors.count()
            exact = shared > n * (n - 1) / 8
    found = None
    if exact:
        near = packed_topk(vectors, per_source, least, links, dim)
    elif made is not None:
        pairs = graph_written(candidates_of_blocks(made, tokens, margin(least, dim)))
        linked = pairs.where("linked").select(F.col("a").alias("source"), F.col("b").alias("target"))
        found = verified(pairs, vectors, least, dim).join(linked, ["source", "target"], "left_anti")
    else:
        found = verified(candidates(weights, kept, margin(least, dim)), vectors, least, dim).join(links, ["source", "target"], "left_anti")
    if found is not None:
        near = found.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= per_source)
    best = graph_cut(near.orderBy(F.desc("score"), "source", "target").limit(total).select(F.col("source").alias("a"), F.col("target").alias("b"), "score"))
    shared = graph.shared_neighbours(edges, best.select("a", "b"), few=True)
    return best.join(shared, ["a", "b"]).select(F.col("a").alias("source"), F.col("b").alias("target"), "score", F.col("shared").cast("long").alias("shared"))


class PairMemory:
    """Role-value pairs in one vector; what is bound with a role comes back by nearest value."""

    def __init__(self, pairs: list[tuple[str, str]], dim: int = DIM):
        self.tokens = Tokens(dim)
        self.trace = bundle([self.tokens[k] * self.tokens[v] for k, v in pairs], dim)

    def value(self, key: str, known: list[str]) -> tuple[str, float]:
        return self._nearest(self.trace * self.tokens[key], known)

    def key(self, value: str, known: list[str]) -> tuple[str, float]:
        return self._nearest(self.trace * self.tokens[value], known)

    def score(self, key: str, value: str) -> float:
        return similarity(self.trace, self.tokens[key] * self.tokens[value])

    def _nearest(self, v: np.ndarray, known: list[str]) -> tuple[str, float]:
        scores = [(similarity(v, self.tokens[x]), -i) for i, x in enumerate(known)]
        best = max(scores)
        return known[-best[1]], best[0]


def recalled(pairs: DataFrame, key: str, role: str, value: str, dim: int = DIM) -> DataFrame:
    """key, role, value, recalled: each key's pairs stored in one vector and read back against the key's values."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["role", "value"])
        memory = PairMemory(list(zip(frame["role"], frame["value"])), dim)
        known = sorted(set(frame["value"]))
        return frame.assign(recalled=[memory.value(r, known)[0] for r in frame["role"]])

    rows = pairs.select(F.col(key).cast("string").alias("key"), F.col(role).cast("string").alias("role"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandas(run, "key string, role string, value string, recalled string")


# -- complex vectors of modulus one


def phases(seed: int, dim: int = 1024) -> np.ndarray:
    return np.exp(2j * math.pi * (chacha_words(seed, dim) / 2**32)).astype(np.complex64)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b


def unbound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b.conj()


def complex_bundle(vectors: list[np.ndarray]) -> np.ndarray:
    """Sum with every place back at modulus one; a place that cancels becomes one."""
    total = np.sum(vectors, axis=0)
    size = np.abs(total)
    return np.where(size > 1e-9, total / np.maximum(size, 1e-9), 1).astype(np.complex64)


def complex_similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b.conj()).real.mean())


def recalled_complex(pairs: DataFrame, key: str, role: str, value: str, dim: int = 1024) -> DataFrame:
    """``recalled`` in complex vectors; one key's pairs are one task's work, its vectors are drawn once a token."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["role", "value"])
        roles = {r: phases(T.fnv1a(r), dim) for r in set(frame["role"])}
        known = sorted(set(frame["value"]))
        values = np.stack([phases(T.fnv1a(v), dim) for v in known])
        place = {v: k for k, v in enumerate(known)}
        trace = complex_bundle([bound(roles[r], values[place[v]]) for r, v in zip(frame["role"], frame["value"])])
        scores = {r: (values.conj() @ unbound(trace, roles[r])).real for r in roles}
        return frame.assign(recalled=[known[int(scores[r].argmax())] for r in frame["role"]])

    rows = pairs.select(F.col(key).cast("string").alias("key"), F.col(role).cast("string").alias("role"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandas(run, "key string, role string, value string, recalled string")
