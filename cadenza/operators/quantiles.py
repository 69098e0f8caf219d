"""Exact quantiles of many groups at once, none of which is held by a task.

Equal values of a group are counted first. Each different value then covers a stretch of ranks,
which starts after the counts of the smaller values (running counts in ranges of equal depth);
a quantile lies between the values that cover the two ranks next to it. So sums and the two
values are all that is kept of a group, whatever its size and however its values are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import sums_before


def _covering(rank: Column) -> Column:
    """The value whose ranks hold the wanted one (aggregate)."""
    return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__rows")), F.col("__v")))


def grouped_quantiles(df: DataFrame, groups: list[str], value: str | Column, wanted: dict[str, float], limit: int | None = None) -> DataFrame:
    """One row per group with a column per wanted quantile: linear between the two nearest ranks.

    Nulls don't count; NaN is larger than any number. A group without values has nulls. Null
    groups are groups.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [f"__g{k}" for k in range(len(groups))]
    counts = df.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], value.cast("double").alias("__v")).agg(F.count("*").alias("__rows"))
    # the null of a group has no ranks, but keeps the group
    counts = counts.withColumn("__rows", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__rows")))
    placed = sums_before(counts, "__v", ["__rows"], keys, limit=limit).withColumnRenamed("before___rows", "__before")
    totals = placed.groupBy(*keys).agg(F.sum("__rows").alias("__all")).toDF(*[f"__t{k}" for k in range(len(keys))], "__all")
    match = F.lit(True)
    for k, key in enumerate(keys):
        match &= F.col(key).eqNullSafe(F.col(f"__t{k}"))
    placed = placed.join(totals, match)
    picks, out = [], []
    for k, (name, q) in enumerate(wanted.items()):
        place = F.lit(float(q)) * (F.col("__all") - 1)
        picks += [_covering(F.floor(place)).alias(f"__low{k}"), _covering(F.ceil(place)).alias(f"__high{k}"), F.max(place - F.floor(place)).alias(f"__part{k}")]
        low, high, part = F.col(f"__low{k}"), F.col(f"__high{k}"), F.col(f"__part{k}")
        out.append(F.when(low == high, low).otherwise((1.0 - part) * low + part * high).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], *out)


def with_quantile(df: DataFrame, group: str, value: str | Column, out: str, q: float = 0.5, limit: int | None = None) -> DataFrame:
    """Rows with the quantile of their group."""
    found = grouped_quantiles(df, [group], value, {out: q}, limit).withColumnRenamed(group, "__group")
    return df.join(found, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
