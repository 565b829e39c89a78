"""Registered queries: name -> Spark callable, and the checking SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pelagia.workload.views import Views, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: tidy(fn(Views(spark, folder)))
        if check is not None:
            CHECKS[name] = with_clause(check)
        return fn
    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, so that results compare across engines."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)


def r6(*names: str) -> str:
    """``round(x, 6) AS x`` for each name, for checking SQL."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
