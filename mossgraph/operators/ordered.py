"""Work on the rows of a key in order, where one key may have more rows than a task should hold.

``chunked`` range-partitions rows by key and order, so that a key with very many rows lies in several chunks that follow each
other.  What a row needs from earlier rows is then what its own chunk says, from a window over (key, chunk), and what the
chunks before it carry on.  Only a key at the border of a chunk can lie in two of them, so at most two keys a chunk carry
anything: that table has at most twice as many rows as there are chunks and is broadcast.

Orders should tell rows of a key apart: rows of one key and one order share a chunk.  Null keys are one key; null orders come
first.  An empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

CHUNK = "__chunk"
#: Rows of a key from which a plain window over the key is left for chunks.
LARGEST = 1_000_000
#: Rows of a block of a numbered key.
BLOCK = 1 << 16


def hot(rows: DataFrame, keys: list[str], largest: int = LARGEST) -> bool:
    """Whether a key has more rows than ``largest``: counted per partition before anything is shuffled."""
    return bool(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > largest).take(1))


def chunked(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with their chunk's number, the same however often they are read: they are kept in the checkpoint folder."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return graph.checkpointed(rows.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def _same(keys: list[str]) -> Column:
    both = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return both[0] if len(both) == 1 else both[0] & _same(keys[1:])


def carried(rows: DataFrame, keys: list[str], made: Column, before: Column) -> DataFrame:
    """rows of ``chunked`` with __carry: ``before`` (an aggregate of the column __made, over earlier chunks) of ``made`` (an
    aggregate of a key's rows in a chunk); null where there is no earlier chunk."""
    ends = rows.groupBy(CHUNK).agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b"))
    found = ends.select(CHUNK, F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    across = F.broadcast(found.where("n > 1").select(*[F.col(f"k.{k}").alias(f"__of_{k}") for k in keys]))
    sums = rows.join(across, _same(keys), "left_semi").groupBy(*keys, CHUNK).agg(made.alias("__made"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    told = sums.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col(CHUNK).alias("__of_chunk"), before.over(earlier).alias("__carry"))
    return rows.join(F.broadcast(told), _same(keys) & (F.col(CHUNK) == F.col("__of_chunk")), "left").drop(*[f"__of_{k}" for k in keys], "__of_chunk")


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, largest: int = LARGEST) -> DataFrame:
    """rows with the whole-numbered sum of ``value`` over the rows of the key before it."""
    before = Window.unboundedPreceding, -1
    valued = rows.withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    if not hot(rows, keys, largest):
        summed = F.sum("__value").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before))
        return valued.withColumn(name, F.coalesce(summed, F.lit(0).cast("long"))).drop("__value")
    by = carried(chunked(valued, keys, order), keys, F.sum("__value"), F.sum("__made"))
    inner = F.sum("__value").over(Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*before))
    return by.withColumn(name, F.coalesce("__carry", F.lit(0).cast("long")) + F.coalesce(inner, F.lit(0).cast("long"))).drop("__value", "__carry", CHUNK)


def ticked(rows: DataFrame, keys: list[str], order: list[str], name: str = "tick", largest: int = LARGEST) -> DataFrame:
    """rows with their number in their key, from 0."""
    return running(rows, keys, order, F.lit(1), name, largest)


def latest(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, largest: int = LARGEST) -> DataFrame:
    """rows with the last value that isn't null of the key's rows up to this one."""
    upto = Window.unboundedPreceding, 0
    if not hot(rows, keys, largest):
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    last = F.max_by(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))), F.when(F.col(value).isNotNull(), F.struct(*order)))
    by = carried(chunked(rows, keys, order), keys, last, F.last("__made", ignorenulls=True))
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*upto))
    return by.withColumn(name, F.coalesce(inner, F.col("__carry.v"))).drop("__carry", CHUNK)


def sliding(ticks: DataFrame, keys: list[str], size: int, made: dict[str, Column], by: str = "tick", block: int = BLOCK) -> DataFrame:
    """Rows numbered in their key with columns over windows: ``made`` gives them for a window over (key, __block) ordered by
    the number, whose frames reach back fewer than ``size`` rows.  A block's last rows go with the next one too, so that
    frames are whole; block >= size."""
    if block < size:
        raise ValueError("a block has to hold a frame")
    own = F.floor(F.col(by) / block).cast("long")
    again = F.when(F.pmod(F.col(by), F.lit(block)) >= block - size + 1, F.array(own, own + 1)).otherwise(F.array(own))
    spread = ticks.withColumn("__block", F.explode(again))
    return spread.withColumns(made).where(F.col("__block") == own).drop("__block")


def spaced(wanted: DataFrame, key: str, gap: int, carry: list[str] | None = None, by: str = "tick", block: int = BLOCK) -> DataFrame:
    """key, tick (and carry) of the firings among the ticks that want to fire: the first of a key, then each that is at least
    ``gap`` ticks after the last firing.

    What a block of ticks does depends only on how many ticks after its start the first firing is allowed, of which there are
    ``gap``: so each block finds the last firing for each such start on its own, the starts of a key's blocks follow from those by
    one short fold, and each block then fires by its start."""
    carry = carry or []
    blocks = wanted.groupBy(key, F.floor(F.col(by) / block).cast("long").alias("__block")).agg(F.sort_array(F.collect_list(F.struct(by, *carry))).alias("__ts"))

    def end(start: Column) -> Column:
        none = F.lit(None).cast("long")
        return F.aggregate("__ts", F.struct(start.alias("free"), none.alias("last")), lambda s, x: F.when(x[by] >= s["free"], F.struct((x[by] + gap).alias("free"), x[by].alias("last"))).otherwise(s))["last"]

    first = F.col("__block") * block
    ends = blocks.select(key, "__block", F.transform(F.sequence(F.lit(0), F.lit(gap - 1)), lambda e: end(first + e)).alias("ends"))
    maps = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__block", "ends"))).alias("__maps"))

    def follow(state: Column, x: Column) -> Column:
        start = F.greatest(F.lit(0).cast("long"), state["free"] - x["__block"] * block)
        last = F.get(x["ends"], start.cast("int"))
        told = F.struct(x["__block"].alias("block"), start.alias("start"))
        return F.struct(F.coalesce(last + gap, state["free"]).alias("free"), F.concat(state["told"], F.array(told)).alias("told"))

    begin = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast("array<struct<block:bigint,start:bigint>>").alias("told"))
    starts = maps.select(F.col(key).alias("__of"), F.explode(F.aggregate("__maps", begin, follow)["told"]).alias("s")).select("__of", F.col("s.block").alias("__at"), F.col("s.start").alias("__start"))
    both = blocks.join(starts, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at")))
    empty = F.filter(F.col("__ts"), lambda x: F.lit(False))

    def fire(s: Column, x: Column) -> Column:
        return F.when(x[by] >= s["free"], F.struct((x[by] + gap).alias("free"), F.concat(s["fired"], F.array(x)).alias("fired"))).otherwise(s)

    fired = F.aggregate("__ts", F.struct((first + F.col("__start")).alias("free"), empty.alias("fired")), fire)["fired"]
    return both.select(key, F.inline(fired))
