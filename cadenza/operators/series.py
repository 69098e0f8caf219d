"""Window operators over the ordered observations of an entity.

All take the name of the entity column, the order columns and the value column, and share
one partitioning: a chain of them needs one shuffle by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import TINY, clip01, logistic
from ..sources.scratch import materialize
from .quantiles import grouped_quantiles, with_quantile


def ordered(entity: str, order: list[str]):
    return Window.partitionBy(entity).orderBy(*order)


def numbered(df: DataFrame, entity: str, order: list[str], out: str = "seq") -> DataFrame:
    """Adds the place of each row within its entity, from 0."""
    return df.withColumn(out, F.row_number().over(ordered(entity, order)) - 1)


def smooth(x: Column, entity: str, order: list[str], k: int) -> Column:
    """Centred moving sum over k, always divided by k (zeros beyond the ends); series
    shorter than k stay as they are."""
    half = k // 2
    w = ordered(entity, order)
    total = F.sum(x).over(w.rowsBetween(-half, half))
    return F.when(F.count(F.lit(1)).over(Window.partitionBy(entity)) < k, x).otherwise(total / F.lit(float(k)))


def jitter(x: Column, entity: str, order: list[str]) -> Column:
    """Absolute first difference; null on the first row."""
    return F.abs(x - F.lag(x).over(ordered(entity, order)))


def acceleration(x: Column, entity: str, order: list[str]) -> Column:
    """Absolute second difference; null at both ends."""
    w = ordered(entity, order)
    return F.abs(F.lead(x).over(w) - F.lit(2.0) * x + F.lag(x).over(w))


def relative_acceleration(x: Column, entity: str, order: list[str], floor: float = 0.08) -> Column:
    """Second difference over the level, which counts as ``floor`` at least."""
    return acceleration(x, entity, order) / (F.greatest(x, F.lit(floor)) + F.lit(TINY))


def quantile(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation (aggregate)."""
    return F.percentile(x, F.lit(q))


def coefficient_of_variation(x: Column, absolute: bool = False) -> Column:
    """Population deviation over mean (aggregate)."""
    mean = F.abs(F.avg(x)) if absolute else F.avg(x)
    return F.stddev_pop(x) / (mean + F.lit(TINY))


def guarded_correlation(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Pearson correlation (aggregate); 0 if a side is constant."""
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.covar_pop(a, b) / F.when(scale > 0, scale + F.lit(eps)), F.lit(0.0))


def trend_residual(df: DataFrame, entity: str, order: list[str], value: str, least: int = 6) -> DataFrame:
    """Per entity: deviation of the residuals of a straight-line fit over the place, by the mean.

    Fewer than ``least`` rows give 0.
    """
    rows = numbered(df.select(entity, *order, value), entity, order)
    x, y = F.col("seq").cast("double"), F.col(value)
    w = Window.partitionBy(entity)
    slope = F.coalesce(F.covar_pop(x, y).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("slope", slope).withColumn("level", F.avg(y).over(w)).withColumn("mid", F.avg(x).over(w))
    fitted = F.col("level") + F.col("slope") * (x - F.col("mid"))
    out = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y - fitted).alias("sd"), F.avg(y).alias("mean"))
    return out.select(entity, F.when(F.col("n") >= least, F.col("sd") / (F.col("mean") + TINY)).otherwise(0.0).alias("trend_residual"))


def difference_acceleration(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Per entity: mean change of the absolute first difference; 0 for fewer than 3 differences."""
    rows = df.withColumn("d", jitter(F.col(value), entity, order)).where("d is not null")
    rows = rows.withColumn("a", F.abs(F.col("d") - F.lag("d").over(ordered(entity, order))))
    out = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"))
    return out.select(entity, F.when(F.col("n") > 2, F.col("a")).otherwise(0.0).alias("accel_mean"))


def dispersion(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Per entity: median, median absolute deviation and their ratio."""
    rows = materialize(with_quantile(df.select(entity, value), entity, value, "median"), "medians")
    away = grouped_quantiles(rows, [entity], F.abs(F.col(value) - F.col("median")), {"mad": 0.5}).withColumnRenamed(entity, "__e")
    out = rows.groupBy(entity).agg(F.max("median").alias("median")).join(away, F.col(entity).eqNullSafe(F.col("__e"))).drop("__e")
    return out.withColumn("dispersion", F.col("mad") / (F.col("median") + TINY))


def baseline_drift(df: DataFrame, entity: str, a: str, b: str, floor: float = 0.08) -> DataFrame:
    """Per entity: median distance of a / (b + floor) from its own median."""
    rows = materialize(df.select(entity, (F.col(a) / (F.col(b) + F.lit(floor))).alias("r")), "ratios")
    rows = with_quantile(rows, entity, "r", "med")
    return grouped_quantiles(rows, [entity], F.abs(F.col("r") - F.col("med")), {"drift": 0.5})


def valid_deviation(df: DataFrame, entity: str, order: list[str], value: str, valid: str, k: int, rise: tuple[float, float, float], away: tuple[float, float, float]) -> DataFrame:
    """Adds ``deviation``: how far the raw value stands from the median of the smoothed valid rows.

    rise, away: weight, centre and scale of the logistic of the distance above, and of the
    distance on either side. Rows that aren't valid count as 0 in the smoothing and score 0.
    """
    held = F.when(F.col(valid), F.col(value)).otherwise(0.0)
    rows = df.withColumn("held", held).withColumn("smoothed", smooth(F.col("held"), entity, order, k))
    rows = with_quantile(materialize(rows, "smoothed"), entity, F.when(F.col(valid), F.col("smoothed")), "baseline")
    gap = F.col("held") - F.col("baseline")
    score = F.lit(rise[0]) * logistic(F.greatest(gap, F.lit(0.0)), *rise[1:]) + F.lit(away[0]) * logistic(F.abs(gap), *away[1:])
    return rows.withColumn("deviation", F.when(F.col(valid), clip01(score)).otherwise(0.0))


def sign_reversals(df: DataFrame, entity: str, order: list[str], value: str, floor: float = 0.10) -> DataFrame:
    """Per entity: changes of sign between consecutive rows stronger than ``floor``."""
    strong = df.where(F.abs(F.col(value)) > floor).withColumn("s", F.signum(value))
    strong = strong.withColumn("flip", (F.col("s") * F.lag("s").over(ordered(entity, order)) < 0).cast("long"))
    counted = strong.groupBy(entity).agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("reversals"))
    return df.select(entity).distinct().join(counted, entity, "left").select(entity, F.coalesce("reversals", F.lit(0)).cast("long").alias("reversals"))


def mean_channel_deviation(df: DataFrame, entity: str, channels: list[str]) -> DataFrame:
    """Per entity: mean population deviation of several channels."""
    total = sum((F.stddev_pop(c) for c in channels[1:]), F.stddev_pop(channels[0]))
    return df.groupBy(entity).agg((total / F.lit(float(len(channels)))).alias("channel_deviation"))


def exponential_smoothing(df: DataFrame, entity: str, order: list[str], value: str, keep: float = 0.80) -> DataFrame:
    """Per entity one row: ``smoothed``, the array of keep * last + (1 - keep) * value.

    A series is gathered in one array, so this is for entities with a bounded number of rows
    (sampled frames); the streaming form keeps only the last value.
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])
    rows = df.groupBy(entity).agg(seq.alias("xs"))
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * F.lit(keep) + x * F.lit(1.0 - keep)))
    out = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.slice("xs", 1, 1), step)
    return rows.select(entity, out.alias("smoothed"))


def paired(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Each row with the value of the next row; the last row of an entity goes."""
    out = df.withColumn("next_value", F.lead(value).over(ordered(entity, order)))
    return out.where("next_value is not null")


def top_rows(df: DataFrame, entity: str | None, score: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest score of each entity; ties by the smaller ``tie``."""
    w = (Window.partitionBy(entity) if entity else Window.partitionBy()).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_mean(df: DataFrame, entity: str, score: str, tie: str, k: int = 3) -> DataFrame:
    """Mean of the k largest scores of each entity."""
    return top_rows(df, entity, score, tie, k).groupBy(entity).agg(F.avg(score).alias("top_mean"))
