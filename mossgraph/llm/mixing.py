"""Mixing sources to target weights.

The texts of a source, in an order fixed by a hash, form one stream of words that is packed into blocks of a fixed
length.  Every output shard draws its source counts from a multinomial distribution; the draws are then corrected, by as
few slots as possible, so that each source's slots over all shards equal its target.  Slot j of a source takes the block
to which a pseudorandom permutation of the source's block numbers maps j, with a new permutation each time the source
has been used up, so no block is taken more than once more than any other of its source.  Slots and blocks meet in a join
by block number.

Sources are rows of a table at every number of them: they are ranked by range partitions, their targets follow from a few
sums, and draws go from the shards to groups of SOURCES neighbouring sources first, then inside each group in a task.

Defined results: a null text has no words; a null source is a source of its own and comes last; repeated rows are rows
of their own; texts without words are taken 0 times; empty tables give empty tables; columns of the input pass through by
place, whatever their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, WORD, cut, hot_limit, numbered, positional, ranked, shuffle_partitions, skew_safe_lookup, word_count

WEIGHTS = (5, 2, 1)
#: The mix has this share of all words, and a source is taken at most REPEATS times.
SHARE, REPEATS = 1.5, 2
BLOCK_WORDS = 256
OUTPUT_SHARDS = 64
SEED = 20_240_607
#: Sources whose slots one task draws.
SOURCES = 4_096
#: Slots that one row of the slot plan stands for at most.
RUN = 1 << 14


def catalogue(sized: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """key, source_no, size, rows, target, blocks, slots of each source, by code point, null last.  sized: source, size.

    Targets are min(repeats * size, level * weight): the level starts at what the words allow, and each round takes the
    sources above it out with their full repeats, until none is above.  A round is one aggregate; sums of whole numbers."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    placed = ranked(found, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = cut(placed.select(source_key(F.col("source")).alias("key"), "source_no", "size", "rows", weight.alias("weight")))
    total = share * (table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    full = F.col("size") * repeats
    level = float("inf")
    while True:
        closed = (F.col("size") == 0) | (F.lit(level) * F.col("weight") > full) if level < float("inf") else F.col("size") == 0
        taken, open_ = table.agg(F.coalesce(F.sum(F.when(closed, full)), F.lit(0)), F.coalesce(F.sum(F.when(~closed, F.col("weight"))), F.lit(0))).first()
        now = (total - taken) / open_ if open_ else float("inf")
        if now == level or not open_:
            break
        level = now
    target = F.when(F.col("size") == 0, F.lit(0.0)).when(F.lit(level) * F.col("weight") > full, full.cast("double")).otherwise(F.lit(level) * F.col("weight")) if level < float("inf") else full.cast("double")
    blocks = F.ceil(F.col("size") / block_words).cast("long")
    slots = F.when(F.col("size") > 0, F.least(repeats * F.col("blocks"), F.rint(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    return cut(table.withColumn("target", target).withColumn("blocks", blocks).withColumn("slots", slots).drop("weight"))


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def drawn(slots: list[int], sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """Slots of each source in each shard: a multinomial draw a shard, corrected to the given totals of both."""
    want = np.asarray(slots, dtype=np.int64)
    total, shards = int(want.sum()), len(sizes)
    if not total:
        return np.zeros((shards, len(want)), dtype=np.int64)
    counts = np.stack([np.random.default_rng([*seed, i]).multinomial(n, want / total) for i, n in enumerate(sizes.tolist())]).astype(np.int64)
    holes = np.zeros(shards, dtype=np.int64)
    for s in np.flatnonzero(counts.sum(axis=0) > want):
        over = int(counts[:, s].sum() - want[s])
        part = counts[:, s] * over // counts[:, s].sum()
        rest = over - int(part.sum())
        for i in np.argsort(-(counts[:, s] - part), kind="stable"):
            if not rest:
                break
            more = min(rest, 1 if rest <= shards else int(counts[i, s] - part[i]))
            part[i] += more
            rest -= more
        counts[:, s] -= part
        holes += part
    for s in np.flatnonzero(counts.sum(axis=0) < want):
        under = int(want[s] - counts[:, s].sum())
        reach = np.minimum(np.cumsum(holes), under)
        given = np.diff(reach, prepend=0)
        counts[:, s] += given
        holes -= given
    return counts


def even(total: int, shards: int) -> np.ndarray:
    sizes = np.full(shards, total // shards, dtype=np.int64)
    sizes[: total % shards] += 1
    return sizes


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: a Feistel network, walked until it is back in range."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, size=4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def slot_plan(sources: DataFrame, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """source_no, shard, slot (of the source), block for each slot of the mix.

    The driver draws slots of groups of sources, a number for each shard and SOURCES sources; the rest is drawn in tasks."""
    spark = sources.sparkSession
    grouped = sources.withColumn("group", F.floor(F.col("source_no") / SOURCES).cast("long"))
    sums = sorted((r["group"], r["slots"]) for r in grouped.groupBy("group").agg(F.sum("slots").alias("slots")).collect())
    outer = drawn([n for _, n in sums], even(sum(n for _, n in sums), shards), [seed])
    sizes = spark.createDataFrame([(g, outer[:, k].tolist()) for k, (g, _) in enumerate(sums)], "group long, sizes array<long>")
    named = grouped.where("slots > 0").join(F.broadcast(sizes), "group").select("group", "sizes", "source_no", "slots", "blocks")

    def draws(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source_no")
        counts = drawn(frame["slots"].tolist(), np.asarray(frame["sizes"].iloc[0], dtype=np.int64), [seed, int(frame["group"].iloc[0])])
        first = np.cumsum(counts, axis=0) - counts
        shard, place = np.nonzero(counts)
        return pd.DataFrame({"source_no": frame["source_no"].to_numpy()[place], "shard": shard, "first": first[shard, place], "slots": counts[shard, place], "blocks": frame["blocks"].to_numpy()[place]})

    segments = named.groupBy("group").applyInPandas(draws, "source_no long, shard long, first long, slots long, blocks long")
    runs = segments.select("source_no", "shard", "blocks", (F.col("first") + F.col("slots")).alias("stop"), F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1, F.lit(RUN))).alias("start"))
    runs = runs.repartition(shuffle_partitions(spark), "source_no", "start")

    def opened(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                slot = np.arange(r.start, min(r.start + RUN, r.stop), dtype=np.int64)
                block = np.empty_like(slot)
                for epoch in range(int(slot[0] // r.blocks), int(slot[-1] // r.blocks) + 1):
                    here = slot // r.blocks == epoch
                    block[here] = permuted(slot[here] % r.blocks, int(r.blocks), [seed, r.source_no, epoch])
                yield pd.DataFrame({"source_no": r.source_no, "shard": r.shard, "slot": slot, "block": block})

    return runs.mapInPandas(opened, "source_no long, shard long, slot long, block long")


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized (with doc_id, source, size, tie) and source_no, source_size, target and start: the place of the row's first word
    in its source.  A catalogue of few sources is broadcast after it was counted; a longer one is looked up by shuffles."""
    parts = shuffle_partitions(sized.sparkSession)
    count, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    table = sources.select("key", "source_no", F.col("size").alias("source_size"), "target", "rows")
    keyed = sized.withColumn("key", source_key(F.col("source")))
    if count <= BROADCAST_ROWS:
        named = keyed.join(F.broadcast(table.drop("rows")), "key")
    else:
        named = skew_safe_lookup(keyed, table, "key", ["source_no", "source_size", "target"], "rows", F.struct("doc_id", "tie"), hot_limit(total, parts))
    chunks = max(64, 2 * parts, total // 100_000)
    return numbered(named.drop("key"), ["source_no"], [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("tie")], F.struct("doc_id", "tie"), chunks, F.col("size"), "start")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a document reaches into, with its first word (from 0, in the document) and its words."""
    opened = rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long"))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return opened.withColumn("first_word", (low - F.col("start")).cast("long")).withColumn("words", (high - low).cast("long"))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it) for every row of docs."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")).fillna(0, ["size"]))
    sources = catalogue(sized, block_words)
    rows = packed(sized, sources)
    uses = slot_plan(sources, shards, seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    narrow = rows.select("doc_id", "size", "source_size", "target", "source_no", "start")
    taken = (
        pieces(narrow, block_words)
        .join(uses.hint("merge"), ["source_no", "block"], "left")  # as many rows as blocks: estimates from the small plan would broadcast it
        .groupBy("source_no", "start", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
    empty = narrow.where(F.col("size") == 0).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


def words_of(text: Column) -> Column:
    """The words of a text, each with the white space after it (the first also with what stands before it)."""
    return F.regexp_extract_all(text, F.lit(rf"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))


def _mixed(docs: DataFrame, id_: str, text_: str, source_: str, block_words: int, shards: int, seed: int) -> DataFrame:
    """docs (columns by place), a row for each slot and piece, with __shard, __slot, __source_no and __word."""
    held = [c for c in docs.columns if c != text_]
    sized = docs.select(F.struct(*held).alias("held"), F.col(text_).alias("text"), F.col(id_).alias("doc_id"), F.col(source_).alias("source"), word_count(F.col(text_)).alias("size"), F.xxhash64(text_).alias("tie")).fillna(0, ["size"])
    sources = catalogue(sized.select("source", "size"), block_words)
    rows = packed(sized, sources).where(F.col("size") > 0).select("held", "source_no", "size", "start", words_of(F.col("text")).alias("tokens"))
    blocks = F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long"))

    def piece(block: Column) -> Column:
        first = F.greatest(F.lit(0).cast("long"), block * block_words - F.col("start"))
        stop = F.least(F.col("size"), (block + 1) * block_words - F.col("start"))
        return F.struct(block.alias("block"), first.alias("first_word"), F.array_join(F.slice("tokens", first.cast("int") + 1, (stop - first).cast("int")), "").alias("text"))

    cut_up = rows.select("held", "source_no", F.inline(F.transform(blocks, piece)))
    mixed = slot_plan(sources, shards, seed).hint("merge").join(cut_up, ["source_no", "block"])
    kept = [F.col("text").alias(c) if c == text_ else F.col(f"held.{c}").alias(c) for c in docs.columns]
    return mixed.select(*kept, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), F.col("source_no").alias("__source_no"), F.col("first_word").alias("__word"))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED, placed: bool = True) -> DataFrame:
    """The mix itself: a row for each slot and document piece in its block, with the columns of docs; text is the piece's.

    Columns mix_shard, mix_slot, mix_source_no and mix_word place the piece, unless they aren't wanted; input columns of
    those names (in any case) give way to them.  Pieces of a document, in order, give its words and white space back."""
    moved, names = positional(docs)
    found = _mixed(moved, *[f"c{names.index(n)}" for n in ("doc_id", "text", "source")], block_words, shards, seed)
    if not placed:
        return found.select(moved.columns).toDF(*names)
    own = ["mix_shard", "mix_slot", "mix_source_no", "mix_word"]
    held = [(f"c{k}", n) for k, n in enumerate(names) if n.lower() not in own]
    return found.select(*[c for c, _ in held], "__shard", "__slot", "__source_no", "__word").toDF(*[n for _, n in held], *own)
