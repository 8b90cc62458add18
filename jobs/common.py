"""What the jobs' command lines share: config files, arguments and a session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def defaults(job: str) -> dict:
    """The values of the config file beside a job."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{job}.json"), encoding="utf-8") as f:
        return json.load(f)


def command(job: str, run: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Runs a job by its command line: --config names a JSON file, --NAME VALUE replaces a value of it."""
    base = defaults(job)
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=run.__doc__)
    parser.add_argument("--config", help=f"a JSON file; jobs/{job}.json has all values there are")
    for name, value in base.items():
        parser.add_argument(f"--{name}", type=type(value) if value is not None else str)
    given = vars(parser.parse_args())
    config = dict(base)
    if given.pop("config") is not None:
        with open(parser.parse_args().config, encoding="utf-8") as f:
            config |= json.load(f)
    unknown = sorted(set(config) - set(base))
    if unknown:
        parser.error(f"unknown values in the config: {', '.join(unknown)}")
    config |= {k: v for k, v in given.items() if v is not None}
    missing = [k for k in ("source", "out") if not config.get(k)]
    if missing:
        parser.error(f"a value is needed for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"siftwork {job}").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
