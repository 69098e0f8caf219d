"""Level scores, fusion, verdict and abstention as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import TINY, clip01, confidence_level, logistic, num
from .series import relative_acceleration, smooth

THRESHOLD = 0.42
#: Weight, centre and scale of each motion signal (fixed values).
MOTION = {"accel": (0.22, 0.55, 0.18), "divergence": (0.18, 0.72, 0.24), "flicker": (0.12, 0.18, 0.06), "mismatch": (0.28, 0.62, 0.16), "component": (0.20, 0.46, 0.12)}
#: Flag and limit of each motion signal (fixed values).
MOTION_FLAGS = {"accel": ("INERTIA", 1.00), "divergence": ("DIVERGENCE", 1.08), "flicker": ("FLICKER", 0.26), "mismatch": ("FACE_MOTION", 0.92), "component": ("FACE_COMPONENTS", 0.70)}
#: Weight, centre and scale of each frequency component (fixed values).
FREQUENCY = {
    "lap_kurtosis_cv": (0.20, 0.31, 0.05),
    "lap_kurtosis_mean": (0.15, 44.0, 15.0),
    "wavelet_detail_ratio": (0.15, 0.70, 0.06),
    "wavelet_detail_ratio_cv": (0.12, 0.078, 0.010),
    "lap_var_temporal_cv": (0.10, 0.160, 0.015),
    "lap_trend_residual_std": (0.08, 0.150, 0.015),
    "lap_var_ratio": (0.08, 1.35, 0.25),
    "block_lap_consistency": (0.06, 0.36, 0.03),
    "dct_hf_ratio": (0.06, 1.02, 0.04),
}
STATIC_TYPES = ("EDGE_INSTABILITY", "COLOR_DRIFT", "LIGHT_SOURCE", "FACE_TEXTURE", "SKIN_TONE_MISMATCH")
DYNAMIC_TYPES = ("FACE_MOTION", "RIGID_BODY")
ARTIFACT_TYPES = ("FLOW_BOUNDARY_SEAM", "COLOR_SEAM_FLICKER", "WARP_PREDICTION_ERROR", "BOUNDARY_EDGE_FLICKER", "EDGE_INSTABILITY")


def gate(support: Column, full: float) -> Column:
    """min(1, support / full); 0 without support."""
    return F.when(support > 0, F.least(F.lit(1.0), support / F.lit(full))).otherwise(0.0)


def motion_timeline(df: DataFrame, entity: str, order: list[str], energy: str, signals: dict[str, str], k: int = 5) -> DataFrame:
    """Adds ``level`` (smoothed energy), ``accel``, ``anomaly`` and ``flags``; first and last rows go.

    signals: columns of divergence, flicker, mismatch and component.
    """
    rows = df.withColumn("level", smooth(F.col(energy), entity, order, k))
    rows = rows.withColumn("accel", relative_acceleration(F.col("level"), entity, order)).where("accel is not null")
    cols = {"accel": F.col("accel")} | {name: F.col(c) for name, c in signals.items()}
    total = None
    for name, (weight, center, scale) in MOTION.items():
        part = F.lit(weight) * logistic(cols[name], center, scale)
        total = part if total is None else total + part
    raised = [F.when(cols[name] > limit, F.lit(flag)) for name, (flag, limit) in MOTION_FLAGS.items()]
    return rows.withColumn("anomaly", total).withColumn("flags", F.array_compact(F.array(*raised)))


def motion_score(anomaly: Column, has_motion: Column) -> Column:
    """Mean anomaly with a bonus where sustained face motion was found (aggregate inputs)."""
    return clip01(anomaly + F.when(has_motion, 0.03).otherwise(0.0))


def physics_score(gravity: Column, rigid: Column, light: Column, skin: Column, decoupling: Column, neck: Column, scene: Column, light_support: Column, skin_support: Column) -> dict[str, Column]:
    """The gated mix of the physics checks, and the gates below which findings are dropped."""
    dynamic = F.greatest(rigid, decoupling)
    light_gate = logistic(dynamic, 0.52, 0.12) * F.least(F.lit(1.0), light_support / 0.40)
    skin_gate = logistic(dynamic, 0.50, 0.14) * F.least(F.lit(1.0), skin_support / 0.40)
    score = 0.05 * gravity + 0.52 * rigid * gate(neck, 0.35) + 0.06 * light * light_gate + 0.12 * skin * skin_gate + 0.25 * decoupling * gate(scene, 0.35)
    return {"l2": clip01(score), "light_gate": light_gate, "skin_gate": skin_gate, "light_kept": light_gate >= 0.45, "skin_kept": skin_gate >= 0.45}


def semantic_score(color: Column, edge: Column, texture: Column) -> Column:
    return clip01(0.12 * color + 0.18 * edge + 0.70 * texture)


def semantic_frame_score(color: Column, edge: Column, texture: Column) -> Column:
    return 0.16 * color + 0.18 * edge + 0.66 * texture


def semantic_flags(color: Column, edge: Column, texture: Column) -> Column:
    return F.array_compact(F.array(F.when(color > 0.80, F.lit("COLOR_DRIFT")), F.when(edge > 0.80, F.lit("FACE_BOUNDARY")), F.when(texture > 0.82, F.lit("FACE_TEXTURE"))))


def boundary_agreement(seam: Column, color: Column, warp: Column, edge: Column) -> Column:
    """How many of the four boundary signals are raised."""
    return (seam >= 0.20).cast("int") + (color >= 0.15).cast("int") + (warp >= 0.40).cast("int") + (edge >= 0.15).cast("int")


def boundary_score(seam: Column, color: Column, warp: Column, edge: Column, support: Column) -> Column:
    """Boundary score: warp counts by what supports it, agreement is rewarded, lone signals lose."""
    other = F.greatest(seam, color, edge)
    n = boundary_agreement(seam, color, warp, edge)
    base = 0.46 * warp * (0.40 + 0.60 * other) + 0.20 * color + 0.18 * edge + 0.16 * seam
    both = F.least(warp, other)
    base = F.when(n >= 3, base + 0.04 * both).when(n == 2, base + 0.03 * both).otherwise(base * 0.88)
    lone_warp = (warp > 0.44) & (color < 0.10) & (edge < 0.10) & (seam < 0.18)
    lone_seam = (seam > 0.55) & (warp < 0.28) & (color < 0.14) & (edge < 0.14)
    terms = [
        (lone_warp, -0.06),
        (lone_seam, -0.07),
        ((warp > 0.50) & (seam > 0.20), 0.03),
        ((edge > 0.22) & (color > 0.15) & ((warp > 0.34) | (seam > 0.24)), 0.03),
        ((warp > 0.58) & (other > 0.18), 0.02),
    ]
    for test, amount in terms:
        base = base + F.when(test, F.lit(amount)).otherwise(0.0)
    return clip01(clip01(base) * gate(support, 0.35))


#: Type, trigger limit, needs agreement, major limit, expected, confidence base, slope, cap (fixed values).
BOUNDARY_RULES = (
    ("FLOW_BOUNDARY_SEAM", "seam", 0.54, True, 0.68, 0.18, 0.55, 0.30, 0.94),
    ("COLOR_SEAM_FLICKER", "color", 0.52, True, 0.68, 0.15, 0.52, 0.28, 0.92),
    ("WARP_PREDICTION_ERROR", "warp", 0.48, False, 0.70, 0.18, 0.50, 0.30, 0.90),
    ("BOUNDARY_EDGE_FLICKER", "edge", 0.56, True, 0.70, 0.10, 0.50, 0.26, 0.88),
)


def boundary_violations(df: DataFrame, keys: list[str], seam: str, color: str, warp: str, edge: str) -> DataFrame:
    """A row for each boundary rule that an input row meets."""
    cols = {"seam": F.col(seam), "color": F.col(color), "warp": F.col(warp), "edge": F.col(edge)}
    n = boundary_agreement(cols["seam"], cols["color"], cols["warp"], cols["edge"])
    found = []
    for kind, name, limit, needs, major, expected, base, slope, cap in BOUNDARY_RULES:
        x = cols[name]
        hit = (x > limit) & (n >= 2) if needs else x > limit
        row = F.struct(
            F.lit(kind).alias("violation_type"),
            F.when(x > major, "MAJOR").otherwise("MINOR").alias("severity"),
            x.alias("measured_value"),
            F.lit(expected).alias("expected_value"),
            (x / F.lit(expected)).alias("violation_ratio"),
            F.least(F.lit(base) + F.lit(slope) * x, F.lit(cap)).alias("confidence"),
        )
        found.append(F.when(hit, row))
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("__found")).select(*keys, "__found.*")


def frequency_score(values: dict[str, Column], support: Column) -> Column:
    """Weighted mean of the components that are present (above 0), by support."""
    total, mass = F.lit(0.0), F.lit(0.0)
    for name, (weight, center, scale) in FREQUENCY.items():
        x = values[name]
        total = total + F.when(x > 0, F.lit(weight) * logistic(x, center, scale)).otherwise(0.0)
        mass = mass + F.when(x > 0, F.lit(weight)).otherwise(0.0)
    return F.when(mass > 0, clip01(total / F.greatest(mass, F.lit(TINY))) * F.least(F.lit(1.0), support / 0.40)).otherwise(0.0)


def corroboration(warp: Column, seam: Column, color: Column, edge: Column) -> Column:
    side = F.greatest(color, edge)
    return clip01(F.greatest(F.least(warp, side), F.least(seam, side), 0.75 * F.least(warp, seam)))


#: Weights of the fused score (fixed values); a caller may pass its own.
FUSION = {"l5": 0.72, "l4": 0.10, "l5_warp": 0.10, "l1": 0.05, "corroboration": 0.03}


def fused_score(l1: Column, l4: Column, l5: Column, warp: Column, seam: Column, color: Column, edge: Column, lap_ratio: Column, lap_cv: Column, freq_support: Column, reliability: Column, weights: dict[str, float] | None = None) -> Column:
    """Frequency-anchored fusion with its bonuses and penalties."""
    w = FUSION | (weights or {})
    raw = w["l5"] * l5 + w["l4"] * l4 + w["l5_warp"] * (l5 * clip01(warp)) + w["l1"] * l1 + w["corroboration"] * corroboration(warp, seam, color, edge)
    bonus = F.when((l5 > 0.55) & (warp > 0.35), 0.03).otherwise(0.0) + F.when((lap_ratio > 1.45) & (lap_cv > 0.165), 0.02).otherwise(0.0)
    penalty = F.when(freq_support < 0.35, 0.05).otherwise(0.0) + F.when(reliability < 0.25, 0.03).otherwise(0.0)
    return clip01(raw + bonus - penalty)


#: Default weights of the smoke fusion (fixed values).
SMOKE = {"L1": 0.28, "L2": 0.26, "L3": 0.16, "L4": 0.30}
SMOKE_THRESHOLD = 0.39


def smoke_boundary_score(seam: Column, color: Column, warp: Column, edge: Column, support: Column) -> Column:
    """Boundary score of the smoke track; low warp error counts as suspicious there."""
    odd = clip01(1.0 - warp)
    n = sum(((x >= 0.38).cast("int") for x in (color, odd, edge)), (seam >= 0.38).cast("int"))
    few = (0.72 * seam + 0.18 * color + 0.10 * odd) * 0.55
    return F.when(n < 2, few).otherwise(0.42 * seam + 0.24 * color + 0.22 * odd + 0.12 * edge) * gate(support, 0.35)


def smoke_fused_score(l1: Column, l2: Column, l3: Column, l4: Column, types: Column, critical: Column, major: Column, minor: Column, reliability: Column, detected: Column, boundary_support: Column, neck: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted fusion of the smoke track with its bonuses and penalties."""
    w = SMOKE | (weights or {})
    has = lambda t: F.array_contains(types, t)
    motion, rigid, light = has("FACE_MOTION"), has("RIGID_BODY"), has("LIGHT_SOURCE")
    dynamic, artifact = overlaps(types, DYNAMIC_TYPES), overlaps(types, ARTIFACT_TYPES)
    only = lambda t: (F.size(types) == 1) & has(t)
    raised = [
        (motion, 0.06),
        (motion & (l1 > 0.30), 0.04),
        (rigid & motion & (neck >= 0.25), 0.02),
        (motion & (reliability > 0.50), 0.02),
        (artifact & (l4 > 0.32) & (boundary_support >= 0.25), 0.02),
        (subset(types, STATIC_TYPES) & (F.size(types) > 0) & (l1 < 0.30) & (l2 < 0.30) & (l4 < 0.26), -0.10),
        (rigid & ~motion & (l1 < 0.22), -0.06),
        (reliability < 0.30, -0.05),
        (detected < 0.30, -0.06),
        (boundary_support < 0.18, -0.04),
        ((neck < 0.18) & ~rigid, -0.04),
        (~dynamic & ~artifact & (l3 > 0.50), -0.08),
        (only("GRAVITY"), -0.06),
        (only("LIGHT_SOURCE"), -0.06),
        (light & ~dynamic & ~artifact, -0.05),
    ]
    out = w["L1"] * l1 + w["L2"] * l2 + w["L3"] * l3 + w["L4"] * l4
    out = out + F.least(F.lit(0.025), 0.010 * critical + 0.004 * major + 0.001 * minor)
    for test, amount in raised:
        out = out + F.when(test, F.lit(amount)).otherwise(0.0)
    return clip01(out)


def overlaps(types: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(t) for t in wanted]))


def subset(types: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(types, F.array(*[F.lit(t) for t in allowed]))) == 0


def weighted_down(l3: Column, l4: Column, reliability: Column, boundary_support: Column, smoke: bool = False) -> tuple[Column, Column]:
    """Level 3 by reliability and level 4 by boundary support where those are weak."""
    least = 0.15 if smoke else 0.35
    third = F.when(reliability < 0.75, l3 * F.greatest(F.lit(least), reliability / 0.75)).otherwise(l3)
    fourth = F.when(boundary_support < 0.22, l4 * (0.45 + 0.55 * F.least(F.lit(1.0), boundary_support / 0.22))).otherwise(l4)
    return third, fourth


def without_static(violations: DataFrame, dynamic: Column, reliability: Column) -> DataFrame:
    """Where nothing dynamic supports them, static findings go but confident texture ones,
    which count as minor."""
    keep = (F.col("violation_type") == "FACE_TEXTURE") & (F.col("confidence") >= 0.82) & (reliability >= 0.80)
    out = violations.where(dynamic | keep)
    severity = F.when(dynamic, F.col("severity")).otherwise("MINOR")
    confidence = F.when(dynamic, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.82)))
    return out.withColumn("severity", severity).withColumn("confidence", confidence)


def abstention(detected: Column, reliability: Column, neck: Column, boundary_support: Column, l1: Column, l2: Column, l4: Column, dynamic: Column, artifact: Column) -> Column:
    """Why no verdict is given; empty if one is."""
    return (
        F.when((detected < 0.22) & (reliability < 0.45), "weak_face_support")
        .when(reliability < 0.35, "unreliable_face_roi")
        .when((neck < 0.14) & (boundary_support < 0.14), "insufficient_face_context")
        .when(~dynamic & ~artifact & (F.greatest(l1, l2, l4) < 0.18), "unsupported_open_world_content")
        .otherwise("")
    )


def verdict(score: Column, threshold: Column | float, reason: Column) -> Column:
    return F.when(reason != "", "INCONCLUSIVE").when(score >= threshold, "AI_GENERATED").otherwise("AUTHENTIC")


def decided(df: DataFrame, score: str, reason: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds verdict and confidence."""
    return df.withColumn("verdict", verdict(F.col(score), threshold, F.col(reason))).withColumn("confidence", confidence_level(F.col(score), num(threshold)))


def comparison_note(score: Column, levels: dict[str, Column], types: Column, reason: Column) -> Column:
    """A sentence per fact: levels, up to six types, why it abstained, and the score."""
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.format_number(v, 3)) for k, v in levels.items()])
    names = F.slice(F.array_sort(F.array_distinct(types)), 1, 6)
    return F.concat_ws(
        " ",
        F.concat(F.lit("Levels: "), told, F.lit(".")),
        F.when(F.size(names) > 0, F.concat(F.lit("Found: "), F.concat_ws(", ", names), F.lit("."))),
        F.when(reason != "", F.concat(F.lit("Inconclusive: "), reason, F.lit("."))),
        F.concat(F.lit("Score="), F.format_number(score, 3), F.lit(".")),
    )
