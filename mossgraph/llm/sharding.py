"""Sharding with near-equal bytes by Karmarkar-Karp differencing.

Groups (equal texts) are indivisible.  Differencing keeps partial partitions (one sum a part) and repeatedly combines the
two with the largest spread, the large parts of one with the small parts of the other.

At scale it is a tree of levels.  Groups are dealt by hash into chunks of CHUNK_GROUPS, and each chunk is differenced into
a sixteenth (FAN) as many bins; those are dealt out and differenced again until at most ``items`` are left, which
are differenced into the shards on the driver.  So no task's work grows with the table.  A group larger than a bin should
be gets a bin of its own, as differencing does anyway.

Defined results: a null text has no bytes and groups with the empty text; repeated rows count as often as they occur and
share a shard; slots run from 0 without gaps in each shard; an empty table gives an empty table.  A single group with
more than a shard's share of the bytes makes its shard larger, since a group is never split."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_limit, numbered, shuffle_partitions, skew_safe_lookup

#: Bytes that each row costs besides its text.
ROW_BYTES = 16
SHARDS = 40
#: Most partial partitions that the driver combines.
ITEMS = 32_768
#: Items a chunk should hold, and how many of them there are for each bin it is differenced into.
CHUNK_GROUPS, FAN = 4_096, 16


def differenced(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by differencing into ``parts`` parts.

    A partial partition is its sums in ascending order, and for every sum the items in it as a linked pair tree, so that
    combining costs O(parts)."""
    if parts <= 1 or not len(sizes):
        return [0] * len(sizes)
    # Only nonzero sums are stored; the zeros in front are implied.
    heap = [(-int(s), i, [(int(s), i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order, trees = len(heap), []
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a ascends from its largest at the end; b is laid against it the other way round.
        merged = []
        free = parts - len(a)
        for k, part in enumerate(reversed(b)):  # largest of b first, to the smallest slots of a
            if k < free:
                merged.append(part)
            else:
                s, t = a[k - free]
                trees.append((t, part[1]))
                merged.append((s + part[0], -len(trees)))
        used = max(0, len(b) - free)
        merged.extend(a[used:])
        merged.sort()
        spread = merged[-1][0] - (merged[0][0] if len(merged) == parts else 0)
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    result = [0] * len(sizes)
    for part, (_, tree) in enumerate(reversed(heap[0][2])):
        stack = [tree]
        while stack:
            t = stack.pop()
            if t >= 0:
                result[t] = part
            else:
                stack.extend(trees[-t - 1])
    return result


def _level(items: DataFrame, key: str, total: int) -> DataFrame:
    """items (key, bytes) with bin: the number of the bin that differencing puts each into, numbered over all chunks."""
    chunks = max(1, -(-total // CHUNK_GROUPS))
    bins = max(1, CHUNK_GROUPS // FAN)

    def binned(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["bytes", "key"], ignore_index=True)
        return pd.DataFrame({"key": chunk["key"], "bytes": chunk["bytes"], "bin": chunk["chunk"] * bins + np.asarray(differenced(chunk["bytes"].tolist(), bins), dtype="int64")})

    kind = items.schema[key].dataType.simpleString()
    dealt = items.select(F.col(key).alias("key"), "bytes", F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk"))
    return cut(dealt.groupBy("chunk").applyInPandas(binned, f"key {kind}, bytes long, bin long"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        )
    )
    total = rows.count()
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    levels = []
    left, count = groups.select("key", "bytes"), groups.count()
    while not levels or count > items:
        levels.append(_level(left, "key", count))
        left = cut(levels[-1].groupBy(F.col("bin").alias("key")).agg(F.sum("bytes").alias("bytes")))
        count = left.count()
    sums = left.orderBy("key").collect()
    shard = differenced([r["bytes"] for r in sums], shards)
    chosen = F.broadcast(spark.createDataFrame([(r["key"], s) for r, s in zip(sums, shard)], "bin long, shard int"))
    for level in reversed(levels):
        chosen = level.join(chosen, "bin").select(F.col("key").alias("bin"), "shard")
    table = groups.join(chosen.withColumnRenamed("bin", "own"), F.col("key") == F.col("own")).select("key", "rows", "shard")
    parts = shuffle_partitions(spark)
    found = skew_safe_lookup(rows, table, "key", ["shard"], "rows", F.col("doc_id"), hot_limit(total, parts))
    slotted = numbered(
        found, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], F.struct("doc_id", "text_crc32"), max(8, total // 100_000, parts // 4), F.lit(1).cast("long"), "slot"
    )
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
