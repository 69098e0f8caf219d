"""Running sums, neighbours and ranks in two levels: inside ranges of the order, then over the
totals of the ranges.

Ranges are of equal depth, whatever the values: a group with more than ``RANGE_ROWS`` rows is
split at quantiles of its own values, and a range that still holds too many is split again.
A value that is a splitter has a range of its own, so repeated values never keep others from
being split. Ranges that can't be split by value (equal values) can be split by a second key
where the order among equals is free. Groups that fit into one range cost one plain window.

No window holds more than ``RANGE_ROWS`` rows of different values, or a row per range of a
group. The quantile sketches are of bounded size and made for large ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import discard, materialize

#: Rows of a group that one window takes.
RANGE_ROWS = 100_000
#: Ranges between splitters that one round makes of a range at most.
RANGES = 256


def _position(splits: Column, value: Column) -> Column:
    """Place among sorted splitters: even between two of them, odd on one.

    A binary search: each step moves on if the splitter it would pass isn't larger.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((RANGES - 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(splits, i + step - 1) <= value, i + step).otherwise(i))
    on = F.get(splits, below - 1).eqNullSafe(value) & (below > 0)
    return 2 * below - on.cast("int")


def _keyed(table: DataFrame, groups: list[str]) -> DataFrame:
    """The columns of the groups and the range under names of their own."""
    return table.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__range").alias("__of"), *[c for c in table.columns if c not in (*groups, "__range")])


def _matching(groups: list[str]) -> Column:
    out = F.col("__range") == F.col("__of")
    for g in groups:
        out &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return out


def _split(rows: DataFrame, value: str, groups: list[str], limit: int) -> DataFrame | None:
    """Rows with finer ranges, written; None if no range is too large and splittable."""
    v = F.col(value)
    sizes = rows.groupBy(*groups, "__range").agg(F.count("*").alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    large = materialize(sizes.where((F.col("__n") > limit) & (F.col("__low") < F.col("__high"))).drop("__low", "__high"), "large")
    if large.isEmpty():
        discard(large)
        return None
    held = rows.join(_keyed(large, groups), _matching(groups)).where(~F.isnan(v))
    cuts = held.groupBy(*groups, "__range").agg(F.max("__n").alias("__n"), F.percentile_approx(v, [k / RANGES for k in range(1, RANGES)], F.lit(20 * RANGES)).alias("__q"))
    ranges = F.least(F.lit(RANGES), F.ceil(2 * F.col("__n") / limit)).cast("int")
    picks = F.transform(F.sequence(F.lit(1), ranges - 1), lambda k: F.get("__q", F.floor(k * F.lit(RANGES) / ranges).cast("int") - 1))
    cuts = cuts.withColumn("__splits", F.array_sort(F.array_distinct(picks))).drop("__n", "__q")
    out = rows.join(_keyed(cuts, groups), _matching(groups), "left")
    place = F.when(F.col("__splits").isNotNull(), _position(F.col("__splits"), v)).otherwise(0)
    out = materialize(out.select(*[c for c in rows.columns if c != "__range"], (F.col("__range") * (2 * RANGES) + place).alias("__range")), "ranged")
    discard(large, rows)
    return out


def ranged(df: DataFrame, keys: list[Column], groups: list[str], limit: int | None = None) -> tuple[DataFrame, bool]:
    """Rows with ``__range``, in order of the first key (nulls first), and whether there is more
    than one range. The later keys split rows that agree in the earlier ones.

    The rows are written, so what led to them is computed once.
    """
    limit = RANGE_ROWS if limit is None else limit
    names = [f"__k{k}" for k in range(len(keys))]
    rows = df.select("*", *[k.cast("double").alias(n) for n, k in zip(names, keys, strict=True)])
    rows = materialize(rows.withColumn("__range", F.when(F.col(names[0]).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")), "rows")
    if rows.count() <= limit:
        return rows.drop(*names), False
    for name in names:
        while (finer := _split(rows, name, groups, limit)) is not None:
            rows = finer
    return rows.drop(*names), True


def sums_before(df: DataFrame, on: str, columns: list[str], groups: list[str] | None = None, then: list[Column] | None = None, falling: bool = False, limit: int | None = None) -> DataFrame:
    """Adds ``before_c`` for each of the columns: its sum over the rows of the group that come
    earlier in the order of ``on`` and ``then``; rows should differ in these."""
    groups = groups or []
    way = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    rows, many = ranged(df, [F.col(on)], groups, limit)
    by = [*groups, "__range"] if many else groups
    inner = Window.partitionBy(*by).orderBy(way(on), *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in columns]
    if not many:
        return rows.select(*df.columns, *[x.alias(f"before_{c}") for c, x in zip(columns, inside, strict=True)])
    totals = rows.groupBy(*groups, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    over = Window.partitionBy(*groups).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*groups, "__range", *[F.coalesce(F.sum(f"__t_{c}").over(over), F.lit(0)).alias(f"__a_{c}") for c in columns])
    out = rows.select("*", *[x.alias(f"__i_{c}") for c, x in zip(columns, inside, strict=True)]).join(_keyed(ahead, groups), _matching(groups))
    return out.select(*df.columns, *[(F.col(f"__a_{c}") + F.col(f"__i_{c}")).alias(f"before_{c}") for c in columns])


def neighbours(df: DataFrame, on: str, limit: int | None = None) -> DataFrame:
    """Adds ``before`` and ``after``: the next smaller and larger of the different values ``on``."""
    rows, many = ranged(df, [F.col(on)], [], limit)
    inner = Window.partitionBy("__range").orderBy(on)
    rows = rows.withColumn("__lag", F.lag(on).over(inner)).withColumn("__lead", F.lead(on).over(inner))
    # one range, and perhaps that of the null; or a row per range
    over = Window.orderBy("__range")
    ends = rows.groupBy("__range").agg(F.min(on).alias("__low"), F.max(on).alias("__high"))
    ends = ends.select("__range", F.lag("__high").over(over).alias("__below"), F.lead("__low").over(over).alias("__above"))
    out = rows.join(_keyed(ends, []), _matching([]))
    return out.select(*df.columns, F.coalesce("__lag", "__below").alias("before"), F.coalesce("__lead", "__above").alias("after"))


def ranked(df: DataFrame, group: str, order: Column, then: str, limit: int | None = None) -> DataFrame:
    """Adds ``__n`` (rows of the group) and ``__r`` (rank in it from 1) by an order that is a
    hexadecimal hash, then by a column, then in any order.

    Rows that agree in the hash (those without a key, or a repeated key) are told apart by
    all their columns where they are too many for one range.
    """
    rows = df.withColumn("__order", order)
    lead = F.conv(F.substring("__order", 1, 13), 16, 10).cast("double")
    rows, many = ranged(rows, [lead, F.xxhash64(*df.columns)], [group], limit)
    if not many:
        whole = Window.partitionBy(group)
        return rows.select(*df.columns, F.count("*").over(whole).alias("__n"), F.row_number().over(whole.orderBy("__order", then)).cast("long").alias("__r"))
    totals = rows.groupBy(group, "__range").agg(F.count("*").alias("__t"))
    whole = Window.partitionBy(group)
    ahead = totals.select(group, "__range", F.sum("__t").over(whole).alias("__n"), (F.sum("__t").over(whole.orderBy("__range")) - F.col("__t")).alias("__a"))
    inner = F.row_number().over(Window.partitionBy(group, "__range").orderBy("__order", then))
    out = rows.withColumn("__i", inner).join(_keyed(ahead, [group]), _matching([group]))
    return out.select(*df.columns, "__n", (F.col("__a") + F.col("__i")).alias("__r"))
