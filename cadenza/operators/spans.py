"""Flags to spans, spans to merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rank of severities (fixed order).
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")


def severity_rank(severity: Column) -> Column:
    """0 for the gravest."""
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, k).otherwise(out)
    return out


def sustained_spans(df: DataFrame, entity: str, place: str, flag: Column, least: int = 2, gap: int = 1, score: Column | None = None) -> DataFrame:
    """Runs of flagged rows whose places are at most gap + 1 apart, ``least`` places long.

    Gives entity, start, end (inclusive) and, with a score, its peak inside the span. Only
    flagged rows are sorted.
    """
    rows = df.where(flag).select(entity, F.col(place).alias("i"), *([score.alias("score")] if score is not None else []))
    w = Window.partitionBy(entity).orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(w) <= gap + 1, 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    peak = [F.max("score").alias("peak")] if score is not None else []
    out = runs.groupBy(entity, "run").agg(F.min("i").alias("start"), F.max("i").alias("end"), *peak)
    return out.where(F.col("end") - F.col("start") + 1 >= least).drop("run")


def first_spans(spans: DataFrame, entity: str, k: int) -> DataFrame:
    """The k first spans of each entity, with the place in their middle."""
    w = Window.partitionBy(entity).orderBy("start")
    out = spans.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return out.withColumn("middle", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))


def merged_intervals(df: DataFrame, entity: str, kind: str = "violation_type", gap: int = 3) -> DataFrame:
    """Intervals of one kind that overlap or start at most ``gap`` after what came before merge.

    The furthest end, gravest severity and largest measured value, ratio and confidence stay;
    description and expected value are those of the first interval.
    """
    w = Window.partitionBy(entity, kind).orderBy("frame_start", "frame_end", "measured_value")
    reach = F.max("frame_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("new", F.when(F.col("frame_start") - reach <= gap, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("frame_start", "frame_end", "measured_value")
    out = rows.groupBy(entity, kind, "island").agg(
        F.min("frame_start").alias("frame_start"),
        F.max("frame_end").alias("frame_end"),
        F.min(severity_rank(F.col("severity"))).alias("grade"),
        F.max("measured_value").alias("measured_value"),
        F.min_by("expected_value", first).alias("expected_value"),
        F.max("violation_ratio").alias("violation_ratio"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("grade") + 1)
    return out.withColumn("severity", severity).drop("island", "grade")
