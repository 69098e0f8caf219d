"""Columns by position, so that helper columns can't clash with those of a table, and batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of whole texts that a Python worker gets at once.
TEXT_ROWS = 1000
#: Equal rows that one task makes of one row with a count.
COPIES = 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1, ... and the new name of each old one."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The old columns under their old names, and no others."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def copies(df: DataFrame, count: str, out: str, keys: list[str]) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in the column ``out``; no task makes more than
    ``COPIES`` rows of one."""
    step = F.lit(COPIES).cast("long")
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, step))).repartition(*keys, "__run")
    each = F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + step, F.col(count)) - 1))
    return runs.withColumn(out, each).drop("__run", count)


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs run inside send texts to Python workers by so many rows at once.

    A batch of Spark's default size holds tens of megabytes of text, once in the executor and
    once in its worker. The session's own setting holds again afterwards.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
