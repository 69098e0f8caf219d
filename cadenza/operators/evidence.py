"""Per-row evidence and intervals: merging, coverage, and the rollup to features.

Coverage and the largest covering confidence come from a sweep over places (``with_coverage``)
that takes entities with any number of rows and intervals. ``with_intervals`` puts the
intervals of an entity as an array beside its rows, for predicates on a few intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip01
from ..sources.scratch import materialize
from .scans import swept
from .series import top_mean

#: Fixed groups of violation types.
DYNAMIC = ("FACE_MOTION", "FACE_SCENE_DECOUPLING", "RIGID_BODY")
BOUNDARY = ("WARP_PREDICTION_ERROR", "FLOW_BOUNDARY_SEAM", "EDGE_INSTABILITY", "BOUNDARY_EDGE_FLICKER", "FACE_TEXTURE")


def merge_evidence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two evidence tables (``score``, ``flags``): the larger score, and the
    sorted different flags of both."""
    left = a.select(*keys, F.col("score").alias("s1"), F.col("flags").alias("f1"))
    right = b.select(*keys, F.col("score").alias("s2"), F.col("flags").alias("f2"))
    none = F.array().cast("array<string>")
    return left.join(right, keys, "full").select(
        *keys, F.greatest("s1", "s2").alias("score"), F.array_sort(F.array_union(F.coalesce("f1", none), F.coalesce("f2", none))).alias("flags")
    )


def zipped(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables side by side where all have the keys."""
    out = tables[0]
    for more in tables[1:]:
        out = out.join(more, keys)
    return out


def first_evidence(wanted: DataFrame, rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Each wanted key with the columns of its first row; null where there is none."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), place).alias("__first")).select(*keys, "__first.*")
    return wanted.join(first, keys, "left")


def gathered(intervals: DataFrame, entity: str) -> DataFrame:
    """One row per entity with its intervals as an array ``spans``."""
    fields = ["frame_start", "frame_end", "violation_type", "severity", "confidence", "violation_ratio"]
    return intervals.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))


def with_intervals(frames: DataFrame, intervals: DataFrame, entity: str) -> DataFrame:
    """Rows with the intervals of their entity; an empty array where there are none."""
    kind = "array<struct<frame_start:bigint,frame_end:bigint,violation_type:string,severity:string,confidence:double,violation_ratio:double>>"
    return frames.join(gathered(intervals, entity), entity, "left").withColumn("spans", F.coalesce(F.col("spans").cast(kind), F.array().cast(kind)))


def covered(place: Column, spans: Column, types: tuple[str, ...] | None = None, severity: str | None = None) -> Column:
    """Whether an interval of the wanted types and severity holds the place."""

    def holds(s: Column) -> Column:
        out = (s["frame_start"] <= place) & (place <= s["frame_end"])
        if types is not None:
            out &= s["violation_type"].isin(*types)
        return out & (s["severity"] == severity) if severity is not None else out

    return F.exists(spans, holds)


def covering_confidence(place: Column, spans: Column) -> Column:
    """The largest confidence of an interval that holds the place; 0 without one."""
    inside = F.filter(spans, lambda s: (s["frame_start"] <= place) & (place <= s["frame_end"]))
    return F.coalesce(F.array_max(F.transform(inside, lambda s: s["confidence"])), F.lit(0.0))


def with_coverage(frames: DataFrame, intervals: DataFrame, entity: str, place: str, limit: int | None = None) -> DataFrame:
    """Rows with in_any, in_major, in_critical, in_dynamic, in_boundary (whether such an interval
    holds the place) and covering_confidence."""
    severity, kind = F.col("severity"), F.col("violation_type")
    kinds = {"in_any": F.lit(True), "in_major": severity == "MAJOR", "in_critical": severity == "CRITICAL", "in_dynamic": kind.isin(*DYNAMIC), "in_boundary": kind.isin(*BOUNDARY)}
    return swept(frames, intervals, entity, place, kinds, limit=limit)


def share(flag: Column) -> Column:
    """Mean of a flag (aggregate)."""
    return F.avg(flag.cast("double"))


def timeline_features(frames: DataFrame, entity: str, place: str, score: str, flags: str) -> DataFrame:
    """Rollup of rows ``with_coverage`` to the timeline features of an entity."""
    top = top_mean(frames.select(entity, place, score), entity, score, place).select(F.col(entity).alias("__e"), clip01(F.col("top_mean")).alias("frame_anomaly_top3_mean"))
    out = frames.groupBy(entity).agg(
        share(F.col("in_any")).alias("violation_span_fraction"),
        share(F.col("in_major")).alias("major_span_fraction"),
        share(F.col("in_critical")).alias("critical_span_fraction"),
        share(F.col("in_dynamic")).alias("dynamic_span_fraction"),
        share(F.col("in_boundary")).alias("boundary_span_fraction"),
        clip01(F.avg("covering_confidence")).alias("confidence_weighted_span"),
        clip01(F.max(score)).alias("frame_anomaly_max"),
        share(F.col(score) >= 0.45).alias("frame_anomaly_peak_fraction"),
        clip01(F.avg(score)).alias("frame_anomaly_mean"),
        clip01(F.stddev_pop(score)).alias("frame_anomaly_std"),
        share(F.size(flags) >= 2).alias("frame_multi_evidence_fraction"),
    )
    return out.join(top, F.col(entity).eqNullSafe(F.col("__e"))).drop("__e")


def violation_features(intervals: DataFrame, entity: str) -> DataFrame:
    """Rollup of intervals to the violation features of an entity."""
    n = lambda *types: F.count_if(F.col("violation_type").isin(*types)).cast("double")
    motion, scene, rigid = n("FACE_MOTION"), n("FACE_SCENE_DECOUPLING"), n("RIGID_BODY")
    warp, seam, texture = n("WARP_PREDICTION_ERROR"), n("FLOW_BOUNDARY_SEAM"), n("FACE_TEXTURE")
    edge = n("EDGE_INSTABILITY", "BOUNDARY_EDGE_FLICKER")
    has = lambda c: (c > 0).cast("double")
    return intervals.groupBy(entity).agg(
        clip01(F.count(F.lit(1)) / 12.0).alias("violation_count"),
        clip01(F.count_if(F.col("severity") == "MAJOR") / 8.0).alias("major_violation_count"),
        clip01(F.count_if(F.col("severity") == "CRITICAL") / 4.0).alias("critical_violation_count"),
        F.least(F.lit(1.0), 0.20 * motion + 0.24 * scene + 0.20 * rigid + 0.08 * texture).alias("dynamic_violation_score"),
        F.least(F.lit(1.0), 0.24 * warp + 0.18 * seam + 0.18 * edge + 0.10 * texture).alias("boundary_violation_score"),
        clip01(F.avg("violation_ratio") / 8.0).alias("violation_ratio_mean"),
        clip01(F.max("violation_ratio") / 10.0).alias("violation_ratio_max"),
        has(motion).alias("has_face_motion"),
        has(scene).alias("has_face_scene_decoupling"),
        has(rigid).alias("has_rigid_body"),
        has(warp).alias("has_warp_prediction_error"),
        has(seam).alias("has_flow_boundary_seam"),
        has(n("EDGE_INSTABILITY", "BOUNDARY_EDGE_FLICKER")).alias("has_edge_instability"),
        has(texture).alias("has_face_texture"),
    )


def forensic_features(frames: DataFrame, intervals: DataFrame, entity: str, place: str, score: str, flags: str) -> DataFrame:
    """All rollup features; an entity without intervals has zeros."""
    by_time = timeline_features(materialize(with_coverage(frames, intervals, entity, place), "coverage"), entity, place, score, flags)
    by_kind = violation_features(intervals, entity)
    return by_time.join(by_kind, entity, "left").na.fill(0.0)


def interaction_features(warp: Column, seam: Column, color: Column, edge: Column, rigid: Column, physics: Column, divergence: Column) -> list[Column]:
    """Products and means of signals."""
    return [
        clip01(warp * seam).alias("warp_seam_interaction"),
        clip01(warp * color).alias("warp_color_interaction"),
        clip01(warp * edge).alias("warp_edge_interaction"),
        clip01(F.greatest(color, edge)).alias("boundary_peak_signal"),
        clip01((seam + color + edge) / 3.0).alias("boundary_mean_signal"),
        clip01(rigid * divergence).alias("rigid_motion_interaction"),
        clip01(physics * divergence).alias("physics_motion_interaction"),
        clip01(rigid * warp).alias("rigid_warp_interaction"),
    ]
