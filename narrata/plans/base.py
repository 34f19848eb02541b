"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrata.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def literal(name: str, fixture: fx.Fixture, step: Callable[[DataFrame], object], column: str = "output") -> None:
    """A query that runs a step over a fixture's inputs; its SQL is the expected output."""
    def run(spark, sf_dir):
        rows = fixture.df(spark).drop(column)
        return rows.select("id", step(rows).alias(column))

    run.__name__ = name
    query(f"SELECT id, {column} FROM {fixture.sql()}")(run)
