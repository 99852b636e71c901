"""What the jobs share: settings from a small JSON file, logging, and the session of the command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

from skeinwork.sources import tables

S = TypeVar("S")


def settings(spark: SparkSession, path: str, kind: type[S], changes: dict[str, str]) -> S:
    """Settings of a JSON file, read by Spark, with the changes of the command line; unknown names are errors."""
    found = tables.read_json(spark, path) | {k: v for k, v in changes.items() if v is not None}
    unknown = set(found) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**found)


def main(kind: type[S], job: Callable[[SparkSession, S], dict], paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """Run a job from the command line: a config file, and options for its paths."""
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").strip().split("\n")[0])
    parser.add_argument("config", help="JSON file of settings")
    for p in paths:
        parser.add_argument(f"--{p.replace('_', '-')}", help=f"in place of the file's {p}")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(job.__name__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, settings(spark, given.pop("config"), kind, given))
    finally:
        spark.stop()
