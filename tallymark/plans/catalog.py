"""Registry of named queries over the given tables, with the SQL that must agree with each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    oracle: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in CATALOG:
            raise KeyError(f"query {name} is registered twice")
        CATALOG[name] = Entry(run, oracle)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
