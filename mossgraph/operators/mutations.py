"""Changes to tables without a table format: a new version of the table is a plan over the old one and the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Rows by key: new values where there are any; ``kept`` columns of known keys stay as they were.

    The null key is a key like any other: a new row with it takes the place of the old one."""
    o, n = old.withColumn("__known", F.lit(True)).alias("o"), new.withColumn("__changed", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    changed, known = F.col("n.__changed").isNotNull(), F.col("o.__known").isNotNull()
    pick = lambda c: F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in kept or c == key else F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: str, changed: DataFrame | None = None) -> DataFrame:
    """All rows of the keys in ``changed`` (by default those in new) replaced by the rows of new."""
    keys = (changed if changed is not None else new).select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new)


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def cascaded(children: DataFrame, gone: DataFrame, foreign: str, key: str) -> DataFrame:
    return children.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def nulled(children: DataFrame, gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children of deleted rows stay, without their reference."""
    marked = children.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(foreign) == F.col("__gone"), "left")
    return marked.withColumn(foreign, F.when(F.col("__gone").isNull(), F.col(foreign))).drop("__gone")
