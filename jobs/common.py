"""What the jobs share: the command line, the config file, a session and the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def main(run: Callable, doc: str, file: str) -> None:
    """Read settings from the config file beside the job (or --config) and the command line, which wins, and run the job."""
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(message)s")
    parser = argparse.ArgumentParser(description=doc)
    default = os.path.splitext(file)[0] + ".json"
    parser.add_argument("--config", default=default, help="JSON file with the settings")
    with open(default, encoding="utf-8") as config:
        names = list(json.load(config))
    for name in names:
        parser.add_argument(f"--{name.replace('_', '-')}")
    given = {k: v for k, v in vars(parser.parse_args()).items() if v is not None}
    with open(given.pop("config"), encoding="utf-8") as config:
        settings = json.load(config) | given
    spark = SparkSession.builder.appName(os.path.basename(file)).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
