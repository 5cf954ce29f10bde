"""SimHash near-deduplication by a binary trie self-join.

Fingerprints are joined in several tries, each with another range of their bits first.  In a trie, two copies of it are
traversed together, node pair by node pair, adding up differing bits and pruning a pair once they exceed the error budget
of its depth: none in the first bits (so equal prefixes are the groups that tasks work on), few in the bits below, the
whole budget in the rest.  A task reads its groups one after the other from a sorted partition and returns a spanning
forest of what they link, never all pairs; a group of very many fingerprints is dealt into chunks, and pairs of chunks
become the groups.  Components are then joined by alternating star contraction, every round kept in the checkpoint folder.

Two shapes are used.  ``CONTRACT``: 64 bits, three-word shingles, 2 errors, three tries.  Two fingerprints within 2 bits
agree on one of three ranges, so no link is lost.  ``SIMILAR``: 256 bits over a text's different five-word shingles, where
at least four fifths of the bits have to agree.  Texts with a Jaccard similarity of 0.8 differ in 15 % of the bits on average, and
in more than 51 for one or two pairs in a hundred, which are missed unless a chain links them; texts that share nothing differ in half.  ``tries_for`` says how many tries that takes.  Bits only estimate, so
these links are candidates: each edge of the forest, a pair chosen close by close, is compared by its whole sets of
shingles and stays if their Jaccard similarity is 0.8 or more.  No text is linked below that; a link is lost where its ends
hang together, in each trie, through closer candidates of which one isn't similar enough.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows repeat in the result;
null identifiers count only where a component has no other; an empty table gives an empty table; other columns pass
through ``near_dedup`` by place, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, for_python, hot_limit, positional, shuffle_partitions, skew_safe_lookup, tidy

BUDGET = 2
SHINGLE = 3
SEED = 42
#: Shingles hashed before their bits are added up, so that one very long text needs no more memory.
STEP = 1 << 16
#: Fingerprints of a group from which it is dealt into chunks of that size; rows that a task joins at once.
GROUP, ROWS = 1 << 15, 1 << 16
#: Node pairs of a frontier that are held at once, and comparisons at which a node pair is compared directly.
FRONTIER, LEAF = 1 << 16, 16
#: Accepted probability that fingerprints right at the budget of ``SIMILAR`` meet in none of its tries.
MISS = 0.005
#: Jaccard similarity of the sets of shingles from which wide fingerprints link, and edges that one copy of a text serves.
LEAST, SERVED = 0.8, 256


@dataclass(frozen=True)
class Shape:
    """What is fingerprinted, and how fingerprints are joined."""

    words: int  # of 64 bits
    shingle: int
    budget: int  # differing bits
    starts: tuple[int, ...]  # the bit each trie begins with; bits follow cyclically
    exact: int  # bits without an error
    depth: int  # bits below them
    near: int  # errors in those


CONTRACT = Shape(1, SHINGLE, BUDGET, (0, 21, 42), 21, 43, BUDGET)
WIDE, SIMILAR = 256, 51


def tries_for(total: int, bits: int = WIDE, budget: int = SIMILAR, near: int = 2, miss: float = MISS) -> Shape:
    """``SIMILAR`` for a number of fingerprints: prefixes long enough that a group of unrelated ones stays small, and so many
    tries that fingerprints which differ in just ``budget`` bits meet with a probability of 1 - miss (taking tries as
    independent, which the ranges of one fingerprint outdo); at most one trie begins at each bit."""
    size = max(1, math.ceil(math.log2(max(2, total))))
    exact = max(6, size - GROUP.bit_length() + 2)
    depth = max(12, size - exact)
    p = budget / bits
    meets = (1 - p) ** exact * sum(math.comb(depth, k) * p**k * (1 - p) ** (depth - k) for k in range(near + 1))
    n = min(bits, math.ceil(math.log(miss) / math.log(1 - meets)))
    return Shape(bits // 64, 5, budget, tuple(k * bits // n for k in range(n)), exact, depth, near)


def _digests(text: bytes | None, shingle: int) -> Iterator[tuple[bytes, int]]:
    """Digests of a text's shingles, STEP of them at a time, and how many there are; none for no words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    last = max(1, len(words) - shingle + 1)
    starts, stops = starts[:last], stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]
    digest = xxhash.xxh64_digest
    for k in range(0, last, STEP):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + STEP].tolist(), stops[k : k + STEP].tolist())]), last


def fingerprint(text: bytes | None) -> int:
    """64 bits of a text in UTF-8, as a signed number, by the contract of the operator: repeats count, ties are 0."""
    counts, last = np.zeros(64, dtype=np.int64), 1
    for hashes, last in _digests(text, SHINGLE):
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big", signed=True)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted digests of a text's different shingles."""
    parts = [np.frombuffer(h, dtype=">u8").astype(np.uint64) for h, _ in _digests(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def wide_fingerprint(text: bytes | None, shape: Shape) -> bytes:
    """shape.words * 64 bits of a text's different shingles; a tie takes a bit of the whole set's own hash."""
    found = shingle_set(text, shape.shingle)
    if not len(found):
        return bytes(8 * shape.words)
    turns = np.arange(1, shape.words + 1, dtype=np.uint64) * _ODD
    counts = np.zeros(64 * shape.words, dtype=np.int64)
    for k in range(0, len(found), STEP):
        bits = np.unpackbits(_mixed(found[k : k + STEP, None] + turns).view(np.uint8), axis=1)
        # Eight counters of a byte at once: at most 255 rows are added up before they are read.
        bits = np.concatenate([bits, np.zeros((-len(bits) % 255, bits.shape[1]), dtype=np.uint8)])
        lanes = np.ascontiguousarray(bits).view(np.uint64).reshape(-1, 255, bits.shape[1] // 8).sum(axis=1, dtype=np.uint64)
        counts += lanes.view(np.uint8).sum(axis=0, dtype=np.int64)
    ties = np.unpackbits(_mixed(np.bitwise_xor.reduce(found) + turns).view(np.uint8))
    return np.packbits(np.where(2 * counts == len(found), ties, 2 * counts > len(found))).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = CONTRACT) -> DataFrame:
    """doc_id, tie (a hash of the text), fp (the fingerprint as a long, or a hash of a wider one) and, for wider ones,
    words (array of long) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    wide = shape.words > 1

    def each(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            if not wide:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())], ["doc_id", "tie", "fp"])
                continue
            prints = [wide_fingerprint(t.as_py(), shape) for t in texts]
            ids = [xxhash.xxh64_intdigest(x, SEED) for x in prints]
            words = np.frombuffer(b"".join(prints), dtype=">i8").astype(np.int64)
            words = pa.FixedSizeListArray.from_arrays(pa.array(words), shape.words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), words], ["doc_id", "tie", "fp", "words"])

    schema = f"doc_id {kind}, tie long, fp long" + ", words array<long>" * wide
    return for_python(docs, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), schema)


class Forest:
    """Connected rows, with a label array that numpy can compare, and the pairs that connect them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pairs = [np.zeros((2, 0), dtype=np.int64)]

    def link(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        """Connect pairs of rows, far bits apart: each tree hangs on by the closest pair that leads to an earlier one."""
        order = np.argsort(far, kind="stable")
        a, b = a[order], b[order]
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.pairs.append(np.stack([a[first], b[first]]))
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(x, y)[first]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]


def trie_forest(groups: np.ndarray, sides: np.ndarray, keys: np.ndarray, words: np.ndarray | None = None, shape: Shape = CONTRACT) -> Forest:
    """Rows that are sorted by (group, side, key): rows linked through pairs within the budget share a label.

    keys are the first 64 bits in the trie's order, words (a row each) all bits.  Groups with a side 1 join side 0 with
    side 1, others join with themselves.  A group's keys agree on their exact bits."""
    n = len(keys)
    forest = Forest(n)
    if n < 2:
        return forest
    words = keys[:, None] if words is None else words
    turn = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    stop = np.r_[turn[1:], n]
    crossed = np.add.reduceat(sides.astype(np.int64), turn)
    split = stop - crossed
    two = crossed > 0
    lo2, hi2 = np.where(two, split, turn), stop
    hi1 = np.where(two, split, stop)
    live = np.where(two, (hi1 > turn) & (hi2 > lo2), hi1 - turn > 1)
    top, eased = 64 - shape.exact, 64 - shape.exact - shape.depth
    stack = [(top, np.stack([turn, hi1, lo2, hi2, np.full(len(turn), shape.near)])[:, live])]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONTIER:
            half = front.shape[1] // 2
            stack += [(depth, front[:, half:]), (depth, front[:, :half])]
            continue
        runs = np.r_[0, np.cumsum(forest.label[1:] != forest.label[:-1])]
        lo1, hi1, lo2, hi2, left = front
        joined = (runs[hi1 - 1] == runs[lo1]) & (runs[hi2 - 1] == runs[lo2]) & (forest.label[lo1] == forest.label[lo2])
        front = front[:, ~joined]
        lo1, hi1, lo2, hi2, left = front
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF) | (depth == 0)
        if small.any():
            f1, t1, f2, t2, _ = front[:, small]
            for at in range(0, len(f1), 1 << 14):
                part = slice(at, at + (1 << 14))
                wide = t2[part] - f2[part]
                count = (t1[part] - f1[part]) * wide
                owner = np.repeat(np.arange(len(count)), count)
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                a = f1[part][owner] + inside // wide[owner]
                b = f2[part][owner] + inside % wide[owner]
                other = a != b
                a, b = a[other], b[other]
                far = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
                near = far <= shape.budget
                forest.link(a[near], b[near], far[near])
            front = front[:, ~small]
            lo1, hi1, lo2, hi2, left = front
        if not front.shape[1]:
            continue
        if depth == eased:  # the bits below share the whole budget
            left = left + (shape.budget - shape.near)
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(depth - 1)) & np.uint64(1))].astype(np.int64)
        set_ = ones[depth]
        m1, m2 = hi1 - (set_[hi1] - set_[lo1]), hi2 - (set_[hi2] - set_[lo2])
        same = lo1 == lo2
        nexts = [
            np.stack([lo1, m1, lo2, m2, left]),
            np.stack([m1, hi1, m2, hi2, left]),
            np.stack([lo1, m1, m2, hi2, left - 1]),
            np.stack([m1, hi1, lo2, m2, left - 1])[:, ~same],
        ]
        found = np.concatenate(nexts, axis=1)
        keep = (found[1] > found[0]) & (found[3] > found[2]) & (found[4] >= 0) & ~((found[0] == found[2]) & (found[1] - found[0] < 2))
        stack.append((depth - 1, found[:, keep]))
    return forest


def keys_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each row of words, cyclically from its start."""
    n = words.shape[1]
    word, turn = starts // 64, (starts % 64).astype(np.uint64)
    rows = np.arange(len(words))
    high, low = words[rows, word % n], words[rows, (word + 1) % n]
    return np.where(turn == 0, high, (high << turn) | (low >> (np.uint64(64) - np.maximum(turn, np.uint64(1)))))


def _linked(columns: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (fp, fp) of whole groups: trie, prefix, low, high, side, fp, words."""
    trie, prefix, low, high, side, fp, *words = columns
    words = np.stack(words, axis=1).view(np.uint64)
    keys = keys_of(words, np.asarray(shape.starts)[trie])
    order = np.lexsort([keys, side, high, low, prefix, trie])
    by = np.stack([trie, prefix, low, high])[:, order]
    groups = np.cumsum(np.r_[False, (by[:, 1:] != by[:, :-1]).any(axis=0)])
    pairs = np.concatenate(trie_forest(groups, side[order], keys[order], words[order], shape).pairs, axis=1)
    names = fp[order][pairs]
    return names.max(axis=0), names.min(axis=0)


def links(prints: DataFrame, shape: Shape = CONTRACT) -> DataFrame:
    """Edges (u, v) that connect the fingerprints within the budget.  prints: distinct fp, and words if they are wider."""
    words = [F.col("words")[k] for k in range(shape.words)] if shape.words > 1 else [F.col("fp")]
    names = [f"w{k}" for k in range(shape.words)]

    def prefix(start: int):
        word, turn = start // 64, start % 64
        key = words[word] if not turn else F.shiftleft(words[word], turn).bitwiseOR(F.shiftrightunsigned(words[(word + 1) % shape.words], 64 - turn))
        return F.shiftrightunsigned(key, 64 - shape.exact)

    opened = F.inline(F.array(*[F.struct(F.lit(t).alias("trie"), prefix(s).alias("prefix")) for t, s in enumerate(shape.starts)]))
    rows = prints.select("fp", *[w.alias(n) for w, n in zip(words, names)], opened)
    # By counting, at most a row for each GROUP rows; where there is none the join costs nothing.
    large = rows.groupBy("trie", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).withColumn("chunks", F.ceil(F.col("n") / GROUP).cast("int"))
    rows = rows.join(F.broadcast(large.drop("n")), ["trie", "prefix"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("trie", "prefix", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", *names)
    by = ["trie", "prefix", "low", "high"]

    def joined(batches):
        held, n = [], 0

        def edges(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < ROWS:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in whole[:4]], axis=0))
            if not len(turn):
                held = [whole]  # one group so far; it has no more than twice GROUP rows
                continue
            stop = int(turn[-1]) + 1
            yield edges(*_linked([c[:stop] for c in whole], shape))
            held, n = [[c[stop:].copy() for c in whole]], len(whole[0]) - stop
        if n:
            yield edges(*_linked([np.concatenate(c) for c in zip(*held)], shape))

    dealt = rows.repartition(*by).sortWithinPartitions(*by)
    return for_python(dealt, F.col("*")).mapInArrow(tidy(joined), "u long, v long").where("u != v").distinct()


def similar(edges: DataFrame, leads: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The edges (u, v) whose texts have a Jaccard similarity of LEAST or more.  leads: fp, and doc_id and tie of one text.

    A text with many edges is copied, once for each SERVED of them, and its edges are dealt over the copies."""
    served = cut(edges.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies")))
    wanted = served.join(leads, "fp").select("fp", F.col("doc_id").alias("lead_id"), F.col("tie").alias("lead_tie"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("tie") == F.col("lead_tie"))).groupBy("fp").agg(F.min("text").alias("text"))
    copied = cut(texts.join(served, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text"))
    for end, other in (("u", "v"), ("v", "u")):
        edges = edges.join(served.select(F.col("fp").alias(end), "copies"), end).withColumn(f"{end}_copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
    for end in ("u", "v"):
        edges = edges.join(copied.select(F.col("fp").alias(end), F.col("copy").alias(f"{end}_copy"), F.col("text").alias(f"{end}_text")), [end, f"{end}_copy"])

    def each(batches):
        for batch in batches:
            keep, at, held = [], None, None
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if at != v:
                    at, held = v, shingle_set(b.as_py(), shingle)
                keep.append(similarity(shingle_set(a.as_py(), shingle), held) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return for_python(edges, F.col("u"), F.col("v"), F.col("u_text"), F.col("v_text")).mapInArrow(tidy(each), "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """node, root: root is the smallest node of the component.  Alternating star contraction until nothing changes, which
    takes a number of rounds in the order of the squared logarithm of the nodes."""

    def smallest(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.min("v").alias("m"))

    edges, seen = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        low = smallest(small)
        edges = cut(small.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.w").alias("v")).where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = CONTRACT) -> DataFrame:
    """doc_id, tie, fp, root, component_id and n_links (other fingerprints in its component) for every row.

    Without a shape, ``tries_for`` chooses it by the number of different fingerprints."""
    spark = docs.sparkSession
    rows = cut(fingerprints(docs, id_col, text_col, shape or tries_for(1)))
    wide = "words" in rows.columns
    more = [F.first("words").alias("words"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("lead")] if wide else []
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *more))
    total, parts = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first(), shuffle_partitions(spark)
    shape = shape or tries_for(total[0])
    edges = links(prints.select("fp", *["words"] * wide), shape)
    if wide:
        edges = similar(cut(edges), prints.select("fp", "lead.doc_id", "lead.tie"), docs, id_col, text_col, shape.shingle)
    roots = stars(edges)
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    table = rooted.join(whole, "root", "left").select("fp", "n", "root", "component_id", (F.col("prints") - 1).alias("n_links"))
    return skew_safe_lookup(rows.drop("words"), table, "fp", ["root", "component_id", "n_links"], "n", F.col("doc_id"), hot_limit(total[1], parts))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id and n_links for every row, by the operator's contract."""
    found = components(docs, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """The rows of docs, whole, that stay: of each component the document with the smallest identifier (of documents with
    that same identifier the one whose text has the smallest hash; repeated rows of it stay together)."""
    moved, names = positional(docs)
    place = {n: f"c{k}" for k, n in enumerate(names)}
    found = cut(components(moved, place[id_col], place[text_col], shape).select("doc_id", "tie", "root", "component_id"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("tie").alias("kept_tie"), F.count_distinct("tie").alias("ties"))
    several = first.where("ties > 1").select(F.col("root").alias("s_root"), "kept_tie")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    late = found.where(~stays).unionByName(found.where(stays).join(several, F.col("root") == F.col("s_root")).where("tie != kept_tie").select(found.columns))
    gone = late.select(F.col("doc_id").alias("__gone_id"), F.col("tie").alias("__gone_tie")).distinct()
    kept = moved.join(gone, F.col(place[id_col]).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(place[text_col]) == F.col("__gone_tie")), "left_anti")
    return kept.toDF(*names)
