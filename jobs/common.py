"""What jobs share: their configuration, their log and their session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def settings(name: str, stated: dict | None = None) -> dict:
    """The settings of a job: those of the file beside it, with ``stated`` ones in their place; an unknown one is an error."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if unknown := set(stated or {}) - set(found):
        raise ValueError(f"{name}: unknown settings {sorted(unknown)}")
    return found | (stated or {})


def log_of(name: str) -> logging.Logger:
    return logging.getLogger(f"readloom.jobs.{name}")


def read_table(spark: SparkSession, path: str, kind: str, columns: dict[str, str], schema: str | None = None) -> DataFrame:
    """The table at ``path`` (parquet, orc, json or csv) as ``columns``: the name of each and the SQL expression it is."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path).selectExpr(*[f"{expression} as `{name}`" for name, expression in columns.items()])


def command_line(about: str, paths: dict[str, str], run: Callable[..., dict], name: str, arguments: list[str] | None = None) -> int:
    """Parses paths and the configuration file, makes the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="a JSON file with the settings that differ from those beside the job")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=JSON", help="one setting")
    given = vars(parser.parse_args(arguments))
    stated = json.loads(Path(given.pop("config")).read_text()) if given["config"] else given.pop("config") or {}
    stated |= {k: json.loads(v) for k, _, v in (s.partition("=") for s in given.pop("set"))}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        log_of(name).info("done: %s", run(spark, **given, config=settings(name, stated)))
    finally:
        spark.stop()
    return 0
