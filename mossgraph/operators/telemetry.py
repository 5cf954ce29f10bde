"""Token and cost ledger: costs, cache hits, budgets, and versions by their Wilson bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Cents a million tokens by model class (part of the name): input, cache write, cache read, output; fixed values.
PRICES = {"haiku": (100.0, 125.0, 10.0, 500.0), "opus": (1500.0, 1875.0, 150.0, 7500.0)}
#: Of models in none of the classes.
OTHER_PRICES = (300.0, 375.0, 30.0, 1500.0)
#: Ledger units a cent.
UNITS = 10_000
Z = 1.96


def cost_cents(model: Column, tokens: tuple[Column, Column, Column, Column], prices: dict = PRICES, other: tuple = OTHER_PRICES) -> Column:
    def total(rates: tuple) -> Column:
        parts = [F.coalesce(t, F.lit(0)) * r / 1e6 for t, r in zip(tokens, rates)]
        return parts[0] + parts[1] + parts[2] + parts[3]

    name, chosen = F.lower(F.coalesce(model, F.lit(""))), None
    for part, rates in prices.items():
        chosen = F.when(name.contains(part), total(rates)) if chosen is None else chosen.when(name.contains(part), total(rates))
    return chosen.otherwise(total(other)) if chosen is not None else total(other)


def units(cents: Column) -> Column:
    return F.round(cents * UNITS).cast("long")


def since_midnight(ledger: DataFrame, now: Column, at: str = "ts", cost: str = "cost", operations: list[str] | None = None) -> DataFrame:
    """One row: whole cents spent since the start of now's UTC day, by some operations or all.  ``now`` is given, so results repeat."""
    ledger = ledger.where(F.col("operation").isin(operations)) if operations is not None else ledger
    spent = ledger.where((F.col(at) >= F.date_trunc("day", now)) & (F.col(at) <= now)).agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("units"))
    return spent.select((F.col("units") / UNITS).cast("long").alias("cents"))


def cache_ratio(ledger: DataFrame, now: Column, hours: int, at: str = "ts", actor=None, operation: str | None = None) -> DataFrame:
    """One row: cache reads over all input tokens in the last hours (1 to 720), of an actor or operation or all; null if there
    are none."""
    for name, value in (("actor", actor), ("operation", operation)):
        ledger = ledger.where(F.col(name) == value) if value is not None else ledger
    hours = max(1, min(720, hours))
    recent = ledger.where((F.col(at) >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= now))
    sums = recent.agg(F.sum("cache_read").alias("r"), F.sum("cache_write").alias("w"), F.sum("input").alias("i"))
    return sums.select(F.round(F.col("r") / F.nullif(F.col("r") + F.col("w") + F.col("i"), F.lit(0)), 6).alias("ratio"))


def running_budget(ledger: DataFrame, cap: int, key: str = "day", at: str = "ts", order: str = "event_id", cost: str = "cost", largest: int = ordered.LARGEST) -> DataFrame:
    """ledger with what its day had spent before the row, and whether the row is let through.

    A day of more rows than ``largest`` lies in several chunks, to which the sums of those before are carried."""
    return ordered.running(ledger, [key], [at, order], F.col(cost), "spent_before", largest).withColumn("allowed", F.col("spent_before") < cap)


def wilson(positive: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share; 0 and 0 for no trials."""
    p, total = positive / F.nullif(n, F.lit(0)), n.cast("double")
    middle, spread, scale = p + z * z / (2 * total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)), 1 + z * z / total
    low, high = F.greatest((middle - spread) / scale, F.lit(0.0)), F.least((middle + spread) / scale, F.lit(1.0))
    return F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(0.0))


def promoted(scores: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """name, champion, challenger, promote: the newest version against the one before it, by lower bounds."""
    ranked = scores.withColumn("k", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(version))))
    new = ranked.where("k = 1").select(name, F.col(version).alias("challenger"), F.col("low").alias("new_low"))
    old = ranked.where("k = 2").select(name, F.col(version).alias("champion"), F.col("low").alias("old_low"))
    return new.join(old, name).select(name, "champion", "challenger", (F.col("new_low") > F.col("old_low")).alias("promote"))


def champions(versions: DataFrame, name: str, version: str, body: str) -> DataFrame:
    return versions.groupBy(name).agg(F.max_by(body, version).alias(body), F.max(version).alias(version))
