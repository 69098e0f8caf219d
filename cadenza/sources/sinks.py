"""Writers of feature tables, manifests, results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.spans import severity_rank


def write_features(df: DataFrame, path: str, digits: int = 5) -> None:
    """Features as CSV with a header; doubles are rounded."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, header=True)


def write_split_manifest(rows: DataFrame, splits: DataFrame, key: str, path: str) -> None:
    """Every row with its split, ``unused`` where it has none."""
    out = rows.join(splits.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("unused")))
    out.write.csv(path, header=True)


def as_json(*fields: Column) -> Column:
    """Fields as one JSON text; numbers rounded by the caller."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.option("ignoreNullFields", "false").json(path)


def violation_text(kind: Column, severity: Column, start: Column, end: Column, measured: Column, expected: Column, confidence: Column) -> Column:
    """One line about a finding."""
    return F.format_string("[%s] %s frames %d-%d measured %.3f expected %.3f confidence %.2f", severity, kind, start, end, measured, expected, confidence)


def text_report(summary: DataFrame, violations: DataFrame, key: str, most: int = 10) -> DataFrame:
    """One text per entity: verdict, score, and its gravest findings in order.

    summary: key, verdict, confidence, score. The findings of an entity are few by the time
    they are merged.
    """
    line = violation_text(*[F.col(c) for c in ("violation_type", "severity", "frame_start", "frame_end", "measured_value", "expected_value", "confidence")])
    ordered = violations.select(key, F.struct(severity_rank(F.col("severity")).alias("rank"), "frame_start", "violation_type", line.alias("line")).alias("v"))
    lines = ordered.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("v")), 1, most).alias("vs"))
    head = F.format_string("%s verdict %s (%s) score %.3f", F.col(key).cast("string"), "verdict", F.col("confidence"), "score")
    body = F.transform(F.coalesce("vs", F.array().cast("array<struct<rank:int,frame_start:bigint,violation_type:string,line:string>>")), lambda v: v["line"])
    return summary.join(lines, key, "left").select(key, F.concat_ws("\n", F.array(head), body).alias("report"))
