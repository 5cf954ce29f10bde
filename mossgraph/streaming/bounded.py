"""Folds in order of event time whose state stays small: rows wait until the watermark passes them, then go into the fold for good.

A key's state is its fold (a few numbers) and the rows that came within the watermark's delay; a timer at the earliest of them
wakes the key.  So a stream without an end keeps no row longer than the delay, and what is out is never withdrawn.

Defined results: rows without a time are left out; rows behind the watermark are dropped as late; rows at or before the
watermark are out, later ones wait, also when a run ends: the next run on the same checkpoint goes on with them.  Equal times go by
number.  Null keys are one key.  Spark keeps this kind of state in RocksDB, which is set while a stream starts and runs."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..operators import state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = StructType([StructField(n, LongType()) for n in ("at", "number", "v")])


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The session with state in RocksDB, and as it was afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Ordered(StatefulProcessor):
    """Rows (at, number, v) of a key in order of time; ``fold`` says what a released row does."""

    #: The fold's state.
    FOLD: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.kept = handle.getValueState("fold", self.FOLD)

    def fold(self, held: tuple | None, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        """The fold's state after the rows, and what they put out (without the key)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [r for f in rows for r in zip(f["at"].tolist(), f["number"].tolist(), f["v"].tolist())]
        self.waiting.appendList(came)
        self.handle.registerTimer(-(-min(r[0] for r in came) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        out, later = [r for r in waiting if r[0] <= upto], [r for r in waiting if r[0] > upto]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        if out:
            held, made = self.fold(tuple(self.kept.get()) if self.kept.exists() else None, out)
            self.kept.update(held)
            if len(made):
                made.insert(0, "key", key[0])
                yield made

    def close(self) -> None:
        pass


class Firings(Ordered):
    """v says whether a row wants to fire; it does if no row of the ``gap`` before it did."""

    FOLD = StructType([StructField("seen", LongType()), StructField("last", LongType())])

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def fold(self, held, rows):
        seen, last = held or (0, -self.gap)
        fired = []
        for _, _, wants in rows:
            if wants and seen - last >= self.gap:
                last = seen
                fired.append(seen)
            seen += 1
        return (seen, last), pd.DataFrame({"tick": fired}, dtype="int64")


class Averages(Ordered):
    """v is the row's kind, one of ``kinds`` (others: -1); the state moves towards it and keeps length 1."""

    FOLD = StructType([StructField("steps", LongType()), StructField("state", ArrayType(DoubleType()))])

    def __init__(self, kinds: int, alpha: float) -> None:
        self.kinds, self.alpha = kinds, alpha

    def fold(self, held, rows):
        steps, own = held or (0, [0.0] * self.kinds)
        own = list(own)
        for _, _, kind in rows:
            own = [self.alpha * h + (1 - self.alpha) * (kind == t) for t, h in enumerate(own)]
            norm = math.sqrt(sum(h * h for h in own))
            own = [h / norm for h in own] if norm > 1e-9 else own
        return (steps + len(rows), own), pd.DataFrame({"steps": [steps + len(rows)], "state": [own]})


def _run(events: DataFrame, key: str, at: str, number: str, v, late: str, processor: Ordered, out: str) -> DataFrame:
    timed = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    rows = timed.select(F.col(key).cast("long").alias("key"), at, F.unix_micros(F.col(at)).alias("at"), F.col(number).cast("long").alias("number"), v.cast("long").alias("v"))
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key long, {out}", "append", "EventTime")


def firings(events: DataFrame, key: str, at: str, number: str, least: float, gap: int, late: str, value: str = "value") -> DataFrame:
    """key, tick of each firing, for append mode: rows whose value is at least ``least`` want to fire."""
    wants = F.coalesce(F.col(value) >= least, F.lit(False)).cast("int")
    return _run(events, key, at, number, wants, late, Firings(gap), "tick long")


def averages(events: DataFrame, key: str, at: str, number: str, kind: str, kinds: list[str], late: str, alpha: float = state.ALPHA) -> DataFrame:
    """key, steps, state each time rows of the key are released, for append mode; the largest steps are the latest."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)), F.lit(0)) - 1
    return _run(events, key, at, number, place, late, Averages(len(kinds), alpha), "steps long, state array<double>")


def appended(stream: DataFrame, out: str, log: str) -> DataFrame:
    """Run a stream to the end of what there is into the folder ``out`` with the checkpoint ``log``, and read all of ``out``."""
    spark = stream.sparkSession
    with rocks(spark):
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
