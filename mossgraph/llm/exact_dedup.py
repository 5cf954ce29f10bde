"""Exact deduplication by content sort.  DataFrame functions only.

Sampled splitters range-partition the rows by the first characters of the normalised text (and its digest, for texts that
share them), an external sort by the whole normalised text places equal texts next to each other in a partition, and runs
of neighbours whose texts are equal in full keep the row with the smallest identifier.

A text with more rows than a partition should hold is found by counting digests, which only decides where rows go: its
rows are dealt by identifier over sub-runs, each of them compared in full as any other run.  The smallest identifier and
the size over all sub-runs come from an aggregate over just those texts, which also compares them in full, by their
smallest and largest text; a digest whose texts differ is not dealt out.

Defined results: a null text counts as empty; empty texts equal each other; of rows with the same text and the same
smallest identifier exactly one stays; a null identifier stays only if its whole group has none; an empty table gives an
empty table; columns of the input that are named like an output column (in any case) are replaced by it in
``exact_dedup``, while ``without_copies`` returns the input's columns as they were; all others pass through, whatever
their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_limit, nullable_text, positional, shuffle_partitions

#: Characters of the normalised text that the splitters see: a sample of them goes to the driver, so they are bounded.
PREFIX = 64
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space.  A single space needs no rewriting, so the pattern leaves it alone."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _hot(docs: DataFrame, digest: Column, text: Column, id_: str, parts: int) -> DataFrame:
    """__hot_digest, __hot_size, __hot_id of texts with more rows than a partition should hold: at most 4 * parts of them."""
    counted = cut(docs.groupBy(digest.alias("d")).agg(F.count(F.lit(1)).alias("n")))
    limit = hot_limit(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], parts)
    many = counted.where(F.col("n") > limit).select("d")
    if many.isEmpty():
        return docs.sparkSession.range(0).select(F.lit("").alias("__hot_digest"), F.col("id").alias("__hot_size"), F.lit(None).cast(docs.schema[id_].dataType).alias("__hot_id"))
    own = docs.select(digest.alias("d"), text.alias("t"), id_).join(F.broadcast(many), "d")
    whole = own.groupBy(F.col("d").alias("__hot_digest")).agg(F.count(F.lit(1)).alias("__hot_size"), F.min(id_).alias("__hot_id"), F.min("t").alias("a"), F.max("t").alias("b"))
    return cut(whole.where("a = b").drop("a", "b"))


def _judged(docs: DataFrame, id_: str, text_: str) -> DataFrame:
    """docs (columns by place) with __keep, __size, __kept and __digest."""
    parts = shuffle_partitions(docs.sparkSession)
    text = normalised(nullable_text(text_))
    digest = F.sha2(text.cast("binary"), 256)
    hot = _hot(docs, digest, text, id_, parts)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.substring(text, 1, PREFIX).alias("__prefix"), digest.alias("__digest"))
    salted = keyed.join(F.broadcast(hot), F.col("__digest") == F.col("__hot_digest"), "left").withColumn(
        "__salt", F.when(F.col("__hot_size").isNull(), F.lit(0).cast("long")).otherwise(F.lit(1).cast("long") + F.pmod(F.xxhash64(F.col(f"__row.{id_}")), F.lit(8 * parts)))
    )
    ranged = salted.repartitionByRange("__prefix", "__digest", "__salt").withColumn("__text", normalised(F.coalesce(F.col(f"__row.{text_}"), F.lit(""))))
    # The range partitioning clusters these keys, so no further shuffle follows; the sort is by the whole text.
    run = Window.partitionBy("__prefix", "__text", "__digest", "__salt")
    first = run.orderBy(F.col(f"__row.{id_}").asc_nulls_last())
    compared = ranged.select(
        "__row",
        "__digest",
        "__hot_size",
        "__hot_id",
        F.row_number().over(first).alias("__place"),
        F.first(f"__row.{id_}").over(first).alias("__run_id"),
        F.count(F.lit(1)).over(run).alias("__run_size"),
    )
    is_hot = F.col("__hot_size").isNotNull()
    keep = F.when(is_hot, F.col("__hot_id")).otherwise(F.col("__run_id"))
    return compared.select(
        "__row.*",
        keep.alias("__keep"),
        F.when(is_hot, F.col("__hot_size")).otherwise(F.col("__run_size")).cast("long").alias("__size"),
        ((F.col("__place") == 1) & F.col(f"__row.{id_}").eqNullSafe(keep)).alias("__kept"),
        "__digest",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with keep_id, group_size, kept and text_sha256."""
    moved, names = positional(docs)
    found = _judged(moved, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    held = [(f"c{k}", n) for k, n in enumerate(names) if n.lower() not in OUTPUT]
    return found.select(*[c for c, _ in held], "__keep", "__size", "__kept", "__digest").toDF(*[n for _, n in held], *OUTPUT)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that stay."""
    moved, names = positional(docs)
    found = _judged(moved, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    return found.where("__kept").select(moved.columns).toDF(*names)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1, false) AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
