"""Structured Streaming forms: windowed counts, deduplication, state by key, triggers and changes of files."""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, ordered, state

LATE = "10 minutes"


def stream_of(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """A parquet table as a stream of its files; a table that is one file is read from its folder."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}?")
    # Watermarks need an instant; times without a zone are read in the session's zone.
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def shared_folder(spark: SparkSession) -> str:
    return f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream to the end of what there is and read its results; in update mode the last row of each key counts.

    Results go to Parquet in the shared folder: file sinks commit each batch once, so a restart repeats nothing."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out/*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = LATE) -> DataFrame:
    """Counts and sums by window and type; with an append sink a window comes out once the watermark has passed it.

    Without ``late`` no row counts as late, in whatever order files come: for update mode, with every window in the state."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = events.withWatermark("ts", late) if late else events
    made = timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    made = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = LATE) -> DataFrame:
    """The first row of each key; without ``late`` every key stays in the state and no row counts as late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def _timed(events: DataFrame, value: Column) -> DataFrame:
    """user_id, at, event_id, v: times as microseconds, those that are null first (as Spark sorts them)."""
    return events.select("user_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63))).alias("at"), F.col("event_id").cast("long").alias("event_id"), value.cast("long").alias("v"))


def _merged(held, frames: Iterator[pd.DataFrame]) -> tuple[list, int]:
    """A key's rows (at, event_id, v) in order of time, and how many of them, from the first, are as they were before."""
    old = list(zip(*(x.tolist() if hasattr(x, "tolist") else list(x) for x in held.get[:3]))) if held.exists else []
    new = sorted((a, e, v) for f in frames for a, e, v in zip(f["at"].tolist(), f["event_id"].tolist(), f["v"].tolist()))
    same = bisect.bisect_right(old, new[0]) if new else len(old)
    return old[:same] + sorted(old[same:] + new), same


def _apart(rows: list) -> tuple[list, list, list]:
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def moving_state(events: DataFrame, types: list[str], alpha: float = state.ALPHA) -> DataFrame:
    """user_id, steps, state after each batch, for update mode: the fold over the user's rows so far in order of time.

    The fold depends on the order and files may overlap in time, so a user's times and types are kept with the state: rows
    after all that were seen continue the fold, earlier ones make it begin again."""
    n = len(types)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows, same = _merged(held, frames)
        goes_on = held.exists and same == len(held.get[0])
        own = [float(x) for x in held.get[3]] if goes_on else [0.0] * n
        for _, _, kind in rows[same if goes_on else 0 :]:
            own = [alpha * h + (1 - alpha) * (kind == t) for t, h in enumerate(own)]
            norm = math.sqrt(sum(h * h for h in own))
            own = [h / norm for h in own] if norm > 1e-9 else own
        held.update((*_apart(rows), own))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [len(rows)], "state": [own]})

    place = F.coalesce(F.array_position(F.array(*map(F.lit, types)), F.col("event_type")), F.lit(0)) - 1
    return _timed(events, place).groupBy("user_id").applyInPandasWithState(step, "user_id long, steps long, state array<double>", "at array<long>, event_id array<long>, v array<long>, state array<double>", "update", "NoTimeout")


def triggers(events: DataFrame, least: float, gap: int) -> DataFrame:
    """user_id, ticks of all firings so far, after each batch, for update mode.

    A row that comes later but lies earlier moves the ticks behind it, so a user's times are kept and ticks can be withdrawn."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows, same = _merged(held, frames)
        fired = [int(t) for t in held.get[3] if t < same] if held.exists else []
        for tick in range(same, len(rows)):
            if rows[tick][2] and (not fired or tick - fired[-1] >= gap):
                fired.append(tick)
        held.update((*_apart(rows), fired))
        yield pd.DataFrame({"user_id": [key[0]], "ticks": [fired]})

    fires = F.coalesce(F.col("value") >= least, F.lit(False)).cast("int")
    return _timed(events, fires).groupBy("user_id").applyInPandasWithState(step, "user_id long, ticks array<long>", "at array<long>, event_id array<long>, v array<long>, ticks array<long>", "update", "NoTimeout")


def latest(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key in a batch (what a debounce leaves)."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """key, kind (created, modified, removed) between two snapshots; unchanged rows are left out."""
    joined = old.select(key, F.col(digest).alias("was")).join(new.select(key, F.col(digest).alias("now")), key, "full")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return joined.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def settled(events: DataFrame, key: str, at: str, kind: str, gap: str, order: str) -> DataFrame:
    """key, at, kind: the last change of each burst of a key's changes, which ends when none comes for ``gap``."""
    by = Window.partitionBy(key).orderBy(at, order)
    apart = F.coalesce(F.lead(at).over(by) >= F.col(at) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    return events.withColumn("__last", apart).where("__last").select(key, at, kind)


def conflated(events: DataFrame, tick: str, order: list[str], value: str, every: int = 1) -> DataFrame:
    """tick, value, seen of each tick from the first to the last: the latest observation of the tick wins, a tick without one
    has zero; with ``every``, only each so many-th tick."""
    latest = events.groupBy(tick).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count(F.lit(1)).alias("seen"))
    span = events.agg(F.min(tick).alias("a"), F.max(tick).alias("b"))
    ticks = span.select(F.explode(F.sequence("a", "b")).alias(tick))
    made = ticks.join(latest, tick, "left").fillna(0, ["seen"]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return made.where(F.pmod(F.col(tick), F.lit(every)) == 0)


def fires_twofold(rows: DataFrame, key: str, order: list[str], energy: str, progress: str, most: float, least: float, gap: int) -> DataFrame:
    """key, tick, reason of each firing: energy first, else falling progress, not within ``gap`` ticks of the last firing; the
    first is exempt."""
    why = F.when(F.col(energy) >= most, "energy").when(F.col(progress) <= least, "progress")
    ticks = ordered.ticked(rows.select(key, *order, why.alias("reason")), [key], order)
    return ordered.spaced(ticks.where("reason IS NOT NULL").select(key, "tick", "reason"), key, gap, ["reason"])
