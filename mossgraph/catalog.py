"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

from .plans import graphs, images, indexes, ledger, numeric, retrieval, stores, streams, vaults

PARTS = [retrieval, indexes, graphs, ledger, streams, vaults, numeric, stores, images]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of the session's executors, once, so that they find it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_mossgraph_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mossgraph-"), "mossgraph.zip")  # the driver serves it to executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                archive.write(full := os.path.join(folder, name), os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._mossgraph_shipped = True


#: Bytes of an Arrow batch that goes to Python, where the session doesn't name any; rows of long texts would not fit otherwise.
BATCH_BYTES = 8 << 20


def bound(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str((1 << 63) - 1)):
        spark.conf.set(name, str(BATCH_BYTES))


def shipped(query: Callable) -> Callable:
    """The query, with the package sent first and batches bounded."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        bound(spark)
        return query(spark, sf_dir)

    return run
