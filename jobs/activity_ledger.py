"""Daily ledger of what operations cost: takes new Parquet files of events, recomputes the days they touch.

The folder of events is a file stream; its checkpoint knows which files were taken.  A batch's sums by day and operation go to
its own partition of ``partials`` (day, batch), and the days it touches are summed again over all batches into ``daily``.
Sums are whole ledger units, so neither the order of files nor their split into batches changes a result, and late events
count on their day whenever they come.  Both tables are written by dynamic partition overwrite: a batch that is run again
after a failure replaces what it wrote.

    python -m jobs.activity_ledger --events PATH --ledger PATH --checkpoint PATH --cap-cents 2000
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import common
from mossgraph.operators import telemetry
from mossgraph.plans import ledger as plans
from mossgraph.streaming import jobs as streams

#: Sums of a day's operation.
SUMS = ["n", "cost", "input", "cache_write", "cache_read", "output"]


def partial_sums(events: DataFrame) -> DataFrame:
    """day, operation and sums; events without a time or a type count under ``unknown``."""
    rows = plans.ledger_of(events).select(F.coalesce("day", F.lit("unknown")).alias("day"), F.coalesce("operation", F.lit("unknown")).alias("operation"), *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS[1:]])
    return rows.groupBy("day", "operation").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS[1:]])


def daily(partials: DataFrame, cap: int) -> DataFrame:
    """operation, sums, hit_ratio (cache reads over input tokens), share of its day's cost, over (the day costs more than the
    cap in cents), day."""
    sums = partials.groupBy("day", "operation").agg(*[F.sum(c).alias(c) for c in SUMS])
    whole = F.sum("cost").over(Window.partitionBy("day"))  # a row an operation
    read = F.col("cache_read") + F.col("cache_write") + F.col("input")
    return sums.select(
        "operation", *SUMS, F.round(F.col("cache_read") / F.nullif(read, F.lit(0)), 6).alias("hit_ratio"), F.round(F.col("cost") / F.nullif(whole, F.lit(0)), 6).alias("share"), (whole > cap * telemetry.UNITS).alias("over"), "day"
    )


def run(spark: SparkSession, events: str, ledger: str, checkpoint: str, cap_cents: int = 2000, most_files: int = 64) -> DataFrame:
    """Take new files of events (ts, event_type, value, props, ...) into the ledger; returns its days as they then stand."""

    def overwrite(rows: DataFrame, name: str, *keys: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{ledger}/{name}")

    def take(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        overwrite(partial_sums(batch).withColumn("batch", F.lit(n).cast("long")).coalesce(1), "partials", "day", "batch")
        partials = session.read.schema(PARTIALS).parquet(f"{ledger}/partials")
        new = partials.where(F.col("batch") == n)
        days = new.select("day").distinct()
        overwrite(daily(partials.join(days, "day", "left_semi"), int(cap_cents)).repartition("day"), "daily", "day")
        counted = new.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("day")).first()
        common.log.info("activity_ledger: batch %d read %d events from %s and wrote %d days to %s", n, counted[0], events, counted[1], ledger)

    stream = streams.stream_of(spark, events, int(most_files))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return opened(spark, ledger)


PARTIALS = "operation string, " + ", ".join(f"{c} long" for c in SUMS) + ", day string, batch long"
DAILY = "operation string, " + ", ".join(f"{c} long" for c in SUMS) + ", hit_ratio double, share double, over boolean, day string"


def opened(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{ledger}/daily")


if __name__ == "__main__":
    common.main(run, __doc__, __file__)
