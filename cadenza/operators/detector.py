"""From frames with their signals to a verdict: all checks, levels, findings, fusion, abstention.

Every check runs over the frames and is written on its own, so a task sorts the frames of one
check and not those of all; each gives one row per entity, and the rows of all checks meet in one
grouping by entity. The number of tasks that frames are dealt to follows the number of frames.
Findings are rows of their own, a row per finding, and meet the levels again as a set of types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import TINY
from ..sources.scratch import discard, materialize
from . import checks, scoring, series

#: Frames that a task gets on average at most.
TASK_FRAMES = 250_000
FINDING = ["violation_type", "frame_start", "frame_end", "severity", "measured_value", "violation_ratio", "confidence"]


@dataclass(frozen=True)
class Signals:
    """Names of the columns of a table of frames.

    reliability of the region; activity and the two components of its motion; strength and
    direction of the motion of two parts; relations in time (light, color, edge, detail,
    asymmetry); colour distance; motion of region and scene; boundary seam, channels, warp and
    edge; and the frequency signals of region and background.
    """

    reliability: str
    activity: str
    vx: str
    vy: str
    face: tuple[str, str, str]
    neck: tuple[str, str, str]
    light: str
    color: str
    edge: str
    detail: str
    asymmetry: str
    distance: str
    moving: str
    scene: str
    seam: str
    channels: tuple[str, str, str]
    warp: str
    rim: str
    sharpness: str
    background_sharpness: str
    kurtosis: str
    wavelet: str
    block: str
    high: str
    background_high: str


def frequency_features(frames: DataFrame, entity: str, order: list[str], s: Signals) -> DataFrame:
    """One row per entity: the nine frequency components, from the frames' signals."""
    mean, cv = (lambda c: F.avg(c)), (lambda c: series.coefficient_of_variation(F.col(c)))
    ratio = lambda a, b: F.avg(a) / (F.avg(b) + F.lit(TINY))
    out = frames.groupBy(entity).agg(
        cv(s.kurtosis).alias("lap_kurtosis_cv"), mean(s.kurtosis).alias("lap_kurtosis_mean"), mean(s.wavelet).alias("wavelet_detail_ratio"), cv(s.wavelet).alias("wavelet_detail_ratio_cv"),
        cv(s.sharpness).alias("lap_var_temporal_cv"), ratio(s.sharpness, s.background_sharpness).alias("lap_var_ratio"), mean(s.block).alias("block_lap_consistency"), ratio(s.high, s.background_high).alias("dct_hf_ratio"),
    )
    trend = series.trend_residual(frames, entity, order, s.sharpness).withColumnRenamed("trend_residual", "lap_trend_residual_std")
    return out.join(trend, entity)


def dealt(frames: DataFrame, entity: str) -> DataFrame:
    """Frames dealt by entity to a number of tasks that follows their own.

    Few frames stay as they are: the session's number of tasks does, and adaptive execution may
    lower it.
    """
    tasks = -(-frames.count() // TASK_FRAMES)
    return frames.repartition(tasks, entity) if tasks > int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frames


def _named(df: DataFrame, entity: str, prefix: str) -> DataFrame:
    return df.select(entity, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != entity])


def _met(tables: list[DataFrame], entity: str) -> DataFrame:
    """Tables of one row per entity side by side, of all entities that any of them has.

    A column comes from one table only, so its first value that isn't null is its only one.
    """
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != entity])


@dataclass(frozen=True)
class Detection:
    """verdicts: one row per entity; findings: one row per finding that stays."""

    verdicts: DataFrame
    findings: DataFrame


def detect(frames: DataFrame, motion: DataFrame, entity: str, order: list[str], s: Signals, threshold: float = scoring.THRESHOLD) -> Detection:
    """Run all checks over the frames and decide.

    motion: one row per entity with ``l1`` and ``has_motion`` (sustained motion was found).
    Frames are read by each check; write them first where they are costly to make.
    """
    rel = s.reliability
    frames = dealt(frames, entity)
    rows = {
        "gravity": checks.gravity(frames, entity, order, s.vx, s.vy, s.activity),
        "rigid": checks.rigid_body(frames, entity, rel, s.face, s.neck),
        "light": checks.stability(frames, entity, order, rel, s.light, "LIGHT_SOURCE"),
        "skin": checks.skin_tone(frames, entity, rel, s.distance),
        "apart": checks.decoupling(frames, entity, rel, s.moving, s.scene),
        "color": checks.stability(frames, entity, order, rel, s.color, "COLOR_DRIFT"),
        "edge": checks.stability(frames, entity, order, rel, s.edge, "EDGE_INSTABILITY"),
        "texture": checks.texture(frames, entity, order, rel, s.detail, s.asymmetry),
        "rim": checks.boundary(frames, entity, rel, s.seam, s.channels, s.warp, s.rim),
        "freq": frequency_features(frames, entity, order, s),
    }
    share = lambda c: F.avg(c.cast("double"))
    whole = frames.groupBy(entity).agg(
        F.count("*").alias("frames"), F.avg(rel).alias("reliability"), share(F.col(rel) >= 0.60).alias("detected"), share(F.col(rel) >= 0.50).alias("frequency_support"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    tables = {"whole": whole, "motion": motion.select(entity, "l1", "has_motion")} | {name: _named(table, entity, name) for name, table in rows.items()}
    written = [materialize(table, name) for name, table in tables.items()]
    # motion may be known of entities without frames
    out = _met(written, entity).where("frames is not null").drop("frames").na.fill({"l1": 0.0, "has_motion": False})
    c = F.col
    for name, value in scoring.physics_score(c("gravity_score"), c("rigid_score"), c("light_score"), c("skin_score"), c("apart_score"), c("rigid_support"), c("apart_support"), c("light_support"), c("skin_support")).items():
        out = out.withColumn(name, value)
    parts = [c(f"rim_{p}_score") for p in ("seam", "flicker", "warp", "edge")]
    out = out.withColumn("boundary_support", sum((c(f"rim_{p}_support") for p in ("flicker", "warp", "edge")), c("rim_seam_support")) / 4.0)
    out = out.withColumn("raw_l3", scoring.semantic_score(c("color_score"), c("edge_score"), c("texture_score"))).withColumn("raw_l4", scoring.boundary_score(*parts, c("boundary_support")))
    third, fourth = scoring.weighted_down(c("raw_l3"), c("raw_l4"), c("reliability"), c("boundary_support"))
    out = out.withColumn("l3", third).withColumn("l4", fourth)
    out = out.withColumn("l5", scoring.frequency_score({n: c(f"freq_{n}") for n in scoring.FREQUENCY}, c("frequency_support")))
    out = out.withColumn("dynamic", c("has_motion") | c("rigid_severity").isNotNull())
    levels = materialize(out, "levels")
    discard(*written)
    found = materialize(_findings(frames, levels, entity, order, s), "findings")
    types = found.groupBy(entity).agg(F.array_sort(F.collect_set("violation_type")).alias("types"), F.count("*").alias("n_findings"), *[F.count_if(c("severity") == k).alias(f"n_{k.lower()}") for k in ("MAJOR", "MINOR")])
    out = levels.join(types, entity, "left").na.fill(0, ["n_findings", "n_major", "n_minor"]).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    artifact = scoring.overlaps(c("types"), scoring.ARTIFACT_TYPES)
    score = scoring.fused_score(c("l1"), c("l4"), c("l5"), *(c(f"rim_{p}_score") for p in ("warp", "seam", "flicker", "edge")), c("freq_lap_var_ratio"), c("freq_lap_var_temporal_cv"), c("frequency_support"), c("reliability"))
    reason = scoring.abstention(c("detected"), c("reliability"), c("rigid_support"), c("boundary_support"), c("l1"), c("l2"), c("l4"), scoring.overlaps(c("types"), scoring.DYNAMIC_TYPES), artifact)
    out = scoring.decided(out.withColumn("score", score).withColumn("reason", reason), "score", "reason", threshold)
    out = out.withColumn("note", scoring.comparison_note(c("score"), {"L1": c("l1"), "L2": c("l2"), "L3": c("l3"), "L4": c("l4"), "L5": c("l5")}, c("types"), c("reason")))
    kept = [entity, "l1", "l2", "l3", "l4", "l5", "reliability", "detected", "boundary_support", "types", "n_findings", "n_major", "n_minor", "score", "reason", "verdict", "confidence", "note"]
    return Detection(out.select(*kept), found)


def _findings(frames: DataFrame, levels: DataFrame, entity: str, order: list[str], s: Signals) -> DataFrame:
    """A row per finding; those of gated checks and lone static ones go as the levels say."""
    c = F.col

    def of(name: str, kind: str, fires: Column, start: str = "first", end: str = "last") -> DataFrame:
        names = [c(f"{name}_{f}").alias(f) for f in ("severity", "measured_value", "violation_ratio", "confidence")]
        return levels.where(fires & c(f"{name}_severity").isNotNull()).select(entity, F.lit(kind).alias("violation_type"), c(start).alias("frame_start"), c(end).alias("frame_end"), *names)

    always = F.lit(True)
    motion = levels.where("has_motion").select(
        entity, F.lit("FACE_MOTION").alias("violation_type"), c("first").alias("frame_start"), c("last").alias("frame_end"), F.lit("MAJOR").alias("severity"), c("l1").alias("measured_value"), (c("l1") / 0.45).alias("violation_ratio"), F.lit(0.80).alias("confidence")
    )
    out = motion
    for part in (
        of("gravity", "GRAVITY", always, "gravity_frame_start", "gravity_frame_end"), of("rigid", "RIGID_BODY", always), of("light", "LIGHT_SOURCE", c("light_kept"), "light_frame_start", "light_frame_end"),
        of("skin", "SKIN_TONE_MISMATCH", c("skin_kept")), of("apart", "FACE_SCENE_DECOUPLING", always),
    ):
        out = out.unionByName(part)
    # a union of tables dealt alike would put the frames of all three checks into one task
    color, edge, texture = (
        materialize(table, "static")
        for table in (
            checks.stability_findings(frames, entity, order, s.reliability, s.color, "COLOR_DRIFT"), checks.stability_findings(frames, entity, order, s.reliability, s.edge, "EDGE_INSTABILITY"),
            checks.texture_findings(frames, entity, order, s.reliability, s.detail, s.asymmetry),
        )
    )
    static = color.unionByName(edge).unionByName(texture)
    static = scoring.without_static(static.join(levels.select(entity, "dynamic", "reliability"), entity), c("dynamic"), c("reliability"))
    rim = scoring.boundary_violations(levels.select(entity, "first", "last", *[c(f"rim_{p}_score").alias(p) for p in ("seam", "flicker", "warp", "edge")]), [entity, "first", "last"], "seam", "flicker", "warp", "edge")
    rim = rim.withColumnRenamed("first", "frame_start").withColumnRenamed("last", "frame_end")
    return out.unionByName(static.select(entity, *FINDING)).unionByName(rim.select(entity, *FINDING))
