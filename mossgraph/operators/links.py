"""Link resolution, backlinks, outgoing links, orphans and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def resolved(links: DataFrame, files: DataFrame, link_id: str = "link_id", target: str = "target") -> DataFrame:
    """links with file_id (null if none).  files: file_id, path, title.

    Tiers: exact path (with a Markdown ending), file name, title; the first tier wins, then the shortest path, then the
    path.  Each tier is an equi-join; different targets are resolved once."""
    wanted = links.select(F.col(target).alias("t")).where(F.col("t") != "").distinct()
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(md|markdown)$", "")
    keys = files.select(
        "file_id",
        "path",
        F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.regexp_replace("path", r"\.(md|markdown)$", "").alias("k")), F.struct(F.lit(1).alias("tier"), F.col("path").alias("k")), F.struct(F.lit(2).alias("tier"), name.alias("k")), F.struct(F.lit(3).alias("tier"), F.col("title").alias("k")))).alias("e"),
    ).select("file_id", "path", "e.tier", F.col("e.k").alias("k"))
    best = keys.groupBy("k").agg(F.min(F.struct("tier", F.length("path").alias("size"), "path", "file_id")).alias("won"))
    found = wanted.join(best, F.col("t") == F.col("k")).select("t", F.col("won.file_id").alias("file_id"), F.col("won.tier").alias("tier"))
    return links.join(found, F.col(target) == F.col("t"), "left").drop("t")


def backlinks(edges: DataFrame, nodes: DataFrame, target: Column, context: DataFrame | None = None) -> DataFrame:
    """Edges into a node with the source's columns; ``context`` (edge_id, text) is joined if there is any."""
    into = edges.where(F.col("dst") == target).join(nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src")
    return into.join(context, "edge_id", "left") if context is not None else into


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the target's columns, those without a target included."""
    return edges.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left").withColumn("is_resolved", F.col("dst_name").isNotNull())


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, within: list[str] | None = None, largest: int = ordered.LARGEST) -> DataFrame:
    """left with the value of the last right row of its key at or before it: a union in order, no range join; of right rows of
    one time the greatest value counts.

    Where a key has more rows than ``largest``, its rows lie in chunks by time and each hands its last value on."""
    keys = [key, *(within or [])]
    kept = [c for c in left.columns if c not in keys and c != at]
    a = left.select(*keys, at, F.struct(*kept).alias("__row"), F.lit(1).alias("__late"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*keys, at, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.lit(0).alias("__late"), F.col(value).alias("__v"))
    both = ordered.latest(a.unionByName(b), keys, [at, "__late", "__v"], "__v", f"{value}_as_of", largest)
    return both.where("__late = 1").select(*keys, at, *[F.col(f"__row.{c}").alias(c) for c in kept], f"{value}_as_of")


def to_blocks(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """links (file_id, block_ref) with target_block_id: the first block of the target that has the anchor, null if none has."""
    anchors = blocks.where(F.col("user_ref").isNotNull()).groupBy(F.col("file_id").alias("__file"), F.col("user_ref").alias("__ref")).agg(F.min_by("block_id", "order_index").alias("target_block_id"))
    return links.join(anchors, (F.col("file_id") == F.col("__file")) & (F.col("block_ref") == F.col("__ref")), "left").drop("__file", "__ref")


def in_context(links: DataFrame, blocks: DataFrame, source: str = "source") -> DataFrame:
    """links (source, line) with the block they stand in: block_id, block_type and context, the last that starts at or before
    the line; null where there is none.  blocks: the same source column, line, block_id, block_type, content."""
    found = as_of(links, blocks.select(source, "line", F.struct("block_id", "block_type", F.col("content").alias("context")).alias("block")), source, "line", "block")
    return found.select(*[c for c in found.columns if c != "block_as_of"], "block_as_of.*")
