"""Pieces shared by the operators: checkpoints, skew-safe lookups and numbering without a single task."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the operator contracts, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, where the session doesn't name any.
BATCH_BYTES = 8 << 20
#: Rows of a table that is broadcast after it was counted; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.  A temporary one is made only where it is unset and all
    executors are threads of this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mossgraph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder so that lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def for_python(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, ready to go to Python.

    Batches of long texts have to be bounded in bytes, and Spark reads that bound from the session when a plan runs: where
    the session names none, it is set to BATCH_BYTES for good."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return docs.select(*columns)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, and at its end freed memory goes back to the system: workers are kept, and later stages need the room."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: nothing to trim


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed by place, so that no name of theirs (in any case, with dots, or twice) can clash with
    an operator's own, and the names they had."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def nullable_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hot_limit(total: int, parts: int) -> int:
    """Rows of one key from which it counts as hot.  By counting, at most 4 * parts keys are hot."""
    return max(64, total // (4 * parts))


def skew_safe_lookup(rows: DataFrame, table: DataFrame, key: str, values: list[str], weight: str, spread: Column, limit: int) -> DataFrame:
    """Left join of rows with table (one row a key, weight: rows of that key) that no hot key slows down.

    At most total / limit keys weigh more than limit, so those are broadcast, whatever the size of the table;
    rows already served that way are dealt out by ``spread`` in the shuffled join that serves the rest."""
    held = F.struct(*values)
    hot = F.broadcast(table.where(F.col(weight) > limit).select(F.col(key).alias("__hot_key"), held.alias("__hot")))
    cold = table.where(F.col(weight) <= limit).select(F.col(key).alias("__cold_key"), F.lit(0).cast("long").alias("__cold_deal"), held.alias("__cold"))
    dealt = rows.join(hot, F.col(key) == F.col("__hot_key"), "left").withColumn(
        "__deal", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.lit(1).cast("long") + F.pmod(F.xxhash64(spread), F.lit(1 << 20)))
    )
    joined = dealt.join(cold, (F.col(key) == F.col("__cold_key")) & (F.col("__deal") == F.col("__cold_deal")), "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def numbered(df: DataFrame, group: list[str], order: list[Column], chunk_key: Column, chunks: int, add: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``add`` over the rows before this one in its group, in an order that is fixed by the data.

    A group is cut into chunks by a hash, so that a group with a third of all rows isn't sorted in one task;
    sums of whole chunks come from a table with one row a chunk.  Group columns are never null here, so that the join
    keeps the partitioning of the window."""
    cut_up = df.withColumn("__chunk", F.pmod(F.xxhash64(chunk_key), F.lit(chunks)))
    inner = Window.partitionBy(*group, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut_up.withColumn("__before", F.coalesce(F.sum(add).over(inner), F.lit(0).cast("long")))
    outer = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut_up.groupBy(*group, "__chunk").agg(F.sum(add).alias("__all"))
    starts = whole.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__chunk").alias("__g_chunk"), F.coalesce(F.sum("__all").over(outer), F.lit(0).cast("long")).alias("__start"))
    condition = F.col("__chunk") == F.col("__g_chunk")
    for g in group:
        condition = condition & (F.col(g) == F.col(f"__g_{g}"))
    return own.join(starts, condition, "left").select(*df.columns, (F.col("__before") + F.col("__start")).cast("long").alias(name))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of the row (from 0) in an order over the whole table, without a task that sees all rows.

    Rows are range-partitioned and kept; each partition numbers its own, and starts after those of the ones before it."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part").orderBy(*order)
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__start"))
    own = dealt.withColumn("__own", F.row_number().over(inner) - 1)
    return own.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__own") + F.col("__start")).cast("long").alias(name))
