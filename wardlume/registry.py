"""Where queries register themselves, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


class Derived(NamedTuple):
    """Columns made of a whole shipped table by expressions that Spark and DuckDB read alike."""

    source: str
    columns: dict[str, str]

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, self.source).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.source})"


def pick(value: str, *choices: str | None) -> str:
    """An expression that takes the choice numbered by ``value`` modulo their number."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else "'" + c.replace("'", "''") + "'") for i, c in enumerate(choices))
    return f"CASE {value} % {len(choices)} {cases} END"
