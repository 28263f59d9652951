"""Registered queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcela.plans.surrogates import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the data under its name."""

    def put(f: Callable[[Data], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLE[key] = oracle(sql)
        return f

    return put


def also_named(prefix: str, names: list[str]) -> None:
    """Registers queries under a second name."""
    for name in names:
        QUERIES[prefix + name] = QUERIES[name]
        if name in ORACLE:
            ORACLE[prefix + name] = ORACLE[name]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
