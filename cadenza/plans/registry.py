"""Collects queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; sql gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that two engines agree in their last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def unrounded(sql: str, digits: int = DIGITS) -> str:
    """SQL without the rounding to so many digits, for use inside other SQL."""
    head, tail, at = "round(", f", {digits}", 0
    while (start := sql.find(head, at)) >= 0:
        depth, end = 1, start + len(head)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len(head) : end - 1]
        if inner.endswith(tail):
            sql = sql[:start] + "(" + inner[: -len(tail)] + ")" + sql[end:]
        at = start + 1
    return sql
