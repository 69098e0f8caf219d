"""Checks of an entity's frames: gravity, rigid motion, stability in time, boundaries.

Each takes a table of frames with their signals and gives one row per entity: score, support
(share of usable frames) and, where the check fires, what it found. A check without enough
usable frames scores 0 and finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import TINY, clip01, logistic
from .series import jitter, ordered, quantile, smooth
from .spans import first_spans, sustained_spans

#: Flags of a stability check stand above this deviation; runs of two make a span.
FLAG = 0.82
GRAVE_PEAK = 0.92


@dataclass(frozen=True)
class Stability:
    """Constants of a check (fixed values): least reliability; weight, centre and scale of the
    jitter; of the rise above the median and of the distance from it; how many spans count;
    expected value; base, slope and limit of the confidence."""

    reliability: float
    jitter: tuple[float, float, float]
    rise: tuple[float, float, float]
    away: tuple[float, float, float]
    spans: int
    expected: float
    confidence: tuple[float, float, float]


STABILITY = {
    "LIGHT_SOURCE": Stability(0.70, (0.55, 0.065, 0.025), (0.20, 0.12, 0.05), (0.80, 0.055, 0.022), 1, 0.20, (0.52, 0.16, 0.84)),
    "COLOR_DRIFT": Stability(0.68, (0.65, 0.045, 0.018), (0.18, 0.09, 0.035), (0.82, 0.05, 0.020), 1, 0.30, (0.54, 0.16, 0.86)),
    "EDGE_INSTABILITY": Stability(0.72, (0.60, 0.09, 0.032), (0.12, 0.18, 0.07), (0.88, 0.10, 0.036), 2, 0.28, (0.54, 0.16, 0.86)),
}
TEXTURE_RELIABILITY = 0.60
TEXTURE = Stability(TEXTURE_RELIABILITY, (0, 0, 0), (0, 0, 0), (0, 0, 0), 2, 0.28, (0.56, 0.16, 0.88))


def _found(fires: Column, severity: Column, measured: Column, ratio: Column, confidence: Column) -> list[Column]:
    """severity, measured_value, violation_ratio and confidence; null where nothing is found."""
    values = {"severity": severity, "measured_value": measured, "violation_ratio": ratio, "confidence": confidence}
    return [F.when(fires, c).alias(n) for n, c in values.items()]


def _correlation(a: Column, b: Column) -> Column:
    """Correlation with a tiny number beside the product of norms (aggregate)."""
    return F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + F.lit(1e-8) / F.count(a))


def gravity(frames: DataFrame, entity: str, order: list[str], vx: str, vy: str, activity: str) -> DataFrame:
    """Vertical motion that reverses again and again while it dominates."""
    place = order[0]
    strong = frames.where(F.col(activity) > 0.22)
    strong = strong.withColumn("__s", smooth(F.col(vy), entity, order, 5))
    strong = strong.withColumn("__s", F.when(F.abs("__s") > 0.10, F.signum("__s")))
    earlier = ordered(entity, order).rowsBetween(Window.unboundedPreceding, -1)
    strong = strong.withColumn("__flip", F.col("__s") * F.last("__s", ignorenulls=True).over(earlier) < 0)
    sums = strong.groupBy(entity).agg(
        F.count("*").alias("n"), F.count("__s").alias("signs"), F.count_if("__flip").cast("double").alias("reversals"),
        (F.median(F.abs(F.col(vy))) / (F.median(F.abs(F.col(vx))) + TINY)).alias("dominance"), F.min(place).alias("start"), F.max(place).alias("end"),
    )
    out = frames.select(entity).distinct().join(sums.where("n >= 5 and signs >= 4"), entity, "left")
    turns = F.col("reversals") * F.greatest(F.lit(0.0), F.col("dominance") - 1.0)
    fires = (F.col("reversals") >= 2) & (F.col("dominance") > 1.55)
    return out.select(
        entity, F.when(F.col("reversals").isNotNull(), clip01(logistic(turns, 1.5, 0.9) * 0.38)).otherwise(0.0).alias("score"), F.when(fires, F.col("start")).alias("frame_start"), F.when(fires, F.col("end") + 1).alias("frame_end"),
        *_found(fires, F.lit("MAJOR"), F.col("reversals"), F.greatest(F.lit(1.0), F.col("reversals")), F.lit(0.56)),
    )


def rigid_body(frames: DataFrame, entity: str, reliability: str, face: tuple[str, str, str], neck: tuple[str, str, str]) -> DataFrame:
    """Motion of two regions (strength, x, y each) that should move as one."""
    rel = F.col(reliability)
    (fm, fx, fy), (nm, nx, ny) = ([F.col(c) for c in part] for part in (face, neck))
    ok = (rel >= 0.40) & (fm >= 0.05) & (nm >= 0.025)
    gap = rel * F.sqrt((fx - nx) * (fx - nx) + (fy - ny) * (fy - ny)) / (F.sqrt(nx * nx + ny * ny) + 0.08)
    rows = frames.select(entity, ok.alias("ok"), *[F.when(ok, c).alias(n) for n, c in (("f", rel * fm), ("k", rel * nm), ("gap", gap))])
    sums = rows.groupBy(entity).agg(
        F.count_if("ok").alias("n"), F.avg(F.col("ok").cast("double")).alias("support"), _correlation(F.col("f"), F.col("k")).alias("corr"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd")
    )
    n, apart = F.col("n"), 1.0 - F.col("corr")
    spread = F.when(n >= 3, F.col("sd")).otherwise(0.0)
    score = 0.56 * clip01(logistic(apart, 0.48, 0.18)) + 0.44 * clip01(0.60 * logistic(F.col("mean"), 0.52, 0.20) + 0.40 * logistic(spread, 0.22, 0.09))
    out = sums.withColumn("score", F.when((n >= 4) & (F.col("support") >= 0.18), score).otherwise(0.0))
    s = F.col("score")
    return out.select(entity, clip01(s).alias("score"), "support", *_found(s > 0.46, F.when(s > 0.62, "MAJOR").otherwise("MINOR"), apart, apart / 0.28, F.least(0.52 + 0.32 * s, F.lit(0.94))))


def stability(frames: DataFrame, entity: str, order: list[str], reliability: str, value: str, kind: str) -> DataFrame:
    """A relation of two regions that changes in time; ``kind`` names the constants.

    Unreliable frames count as 0 in the smoothed series. Of several spans of deviation that
    with the largest peak among the first ones is reported.
    """
    c = STABILITY[kind]
    score = F.lit(c.jitter[0]) * logistic(F.coalesce(quantile(F.col("j"), 0.88), F.lit(0.0)), *c.jitter[1:])
    return _steady(_deviating(frames, entity, order, reliability, value, c), entity, order[0], score, c)


def stability_findings(frames: DataFrame, entity: str, order: list[str], reliability: str, value: str, kind: str) -> DataFrame:
    """A row per finding of ``stability``: the first spans of deviation, each on its own."""
    c = STABILITY[kind]
    return _span_findings(_deviating(frames, entity, order, reliability, value, c), entity, order[0], c, kind)


def _deviating(frames: DataFrame, entity: str, order: list[str], reliability: str, value: str, c: Stability) -> DataFrame:
    """Rows with ``ok, n, j, off``: usable, usable rows of the entity, jitter, deviation."""
    ok = F.col(reliability) >= c.reliability
    rows = frames.select(entity, *order, ok.alias("ok"), F.when(ok, F.col(value)).otherwise(0.0).alias("x"))
    rows = rows.withColumn("s", smooth(F.col("x"), entity, order, 5))
    whole = Window.partitionBy(entity)
    rows = rows.withColumn("j", jitter(F.col("s"), entity, order)).withColumn("med", F.median(F.when(F.col("ok"), F.col("s"))).over(whole)).withColumn("n", F.count_if("ok").over(whole))
    gap = F.col("x") - F.col("med")
    off = c.rise[0] * logistic(F.greatest(gap, F.lit(0.0)), *c.rise[1:]) + c.away[0] * logistic(F.abs(gap), *c.away[1:])
    return rows.withColumn("off", F.when(F.col("ok") & (F.col("n") >= 4), clip01(off)).otherwise(0.0))


def _span_findings(rows: DataFrame, entity: str, place: str, c: Stability, kind: str) -> DataFrame:
    """entity, violation_type, frame_start, frame_end and what was found, a row per span."""
    spans = first_spans(sustained_spans(rows, entity, place, F.col("off") > FLAG, 2, 1, F.col("off")), entity, c.spans)
    peak, (base, slope, most) = F.col("peak"), c.confidence
    return spans.select(
        entity, F.lit(kind).alias("violation_type"), F.col("start").alias("frame_start"), F.col("end").alias("frame_end"),
        *_found(F.lit(True), F.when(peak < GRAVE_PEAK, "MINOR").otherwise("MAJOR"), peak, peak / c.expected, F.least(base + slope * peak, F.lit(most))),
    )


def _steady(rows: DataFrame, entity: str, place: str, score: Column, c: Stability) -> DataFrame:
    """Score, support and first spans of rows with ``ok, n, off``."""
    sums = rows.groupBy(entity).agg(F.max("n").alias("n"), F.avg(F.col("ok").cast("double")).alias("support"), score.alias("score"))
    spans = first_spans(sustained_spans(rows, entity, place, F.col("off") > FLAG, 2, 1, F.col("off")), entity, c.spans)
    spans = spans.groupBy(entity).agg(F.max("peak").alias("peak"), F.min("start").alias("frame_start"), F.max("end").alias("frame_end"), F.count("*").alias("n_spans"))
    out = sums.join(spans, entity, "left")
    peak, (base, slope, most) = F.col("peak"), c.confidence
    return out.select(
        entity, F.when(F.col("n") >= 4, clip01(F.col("score"))).otherwise(0.0).alias("score"), "support", "frame_start", "frame_end", F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        *_found(peak.isNotNull(), F.when(peak < GRAVE_PEAK, "MINOR").otherwise("MAJOR"), peak, peak / c.expected, F.least(base + slope * peak, F.lit(most))),
    )


def texture(frames: DataFrame, entity: str, order: list[str], reliability: str, detail: str, asymmetry: str) -> DataFrame:
    """Fine detail and symmetry of a region that jump in time."""
    p88 = lambda c: F.coalesce(quantile(F.col(c), 0.88), F.lit(0.0))
    score = 0.62 * logistic(p88("ja"), 0.060, 0.022) + 0.38 * logistic(p88("jb"), 0.040, 0.016)
    return _steady(_jumping(frames, entity, order, reliability, detail, asymmetry), entity, order[0], score, TEXTURE)


def texture_findings(frames: DataFrame, entity: str, order: list[str], reliability: str, detail: str, asymmetry: str) -> DataFrame:
    """A row per finding of ``texture``."""
    return _span_findings(_jumping(frames, entity, order, reliability, detail, asymmetry), entity, order[0], TEXTURE, "FACE_TEXTURE")


def _jumping(frames: DataFrame, entity: str, order: list[str], reliability: str, detail: str, asymmetry: str) -> DataFrame:
    """Rows with ``ok, n, ja, jb, off``."""
    ok = F.col(reliability) >= TEXTURE_RELIABILITY
    rows = frames.select(entity, *order, ok.alias("ok"), *[F.when(ok, F.col(c)).otherwise(0.0).alias(n) for n, c in (("a", detail), ("b", asymmetry))])
    whole = Window.partitionBy(entity)
    rows = rows.withColumn("n", F.count_if("ok").over(whole))
    for n in ("a", "b"):
        rows = rows.withColumn(f"s{n}", smooth(F.col(n), entity, order, 5))
        rows = rows.withColumn(f"j{n}", jitter(F.col(f"s{n}"), entity, order)).withColumn(f"m{n}", F.median(F.when(F.col("ok"), F.col(f"s{n}"))).over(whole))
    off = 0.54 * logistic(F.abs(F.col("a") - F.col("ma")), 0.060, 0.022) + 0.36 * logistic(F.abs(F.col("b") - F.col("mb")), 0.035, 0.015) + 0.10 * logistic(F.abs("a"), 0.24, 0.09)
    return rows.withColumn("off", F.when(F.col("ok") & (F.col("n") >= 4), clip01(off)).otherwise(0.0))


def skin_tone(frames: DataFrame, entity: str, reliability: str, distance: str) -> DataFrame:
    """Spread in time of the colour distance of two regions."""
    ok = F.col(reliability) >= 0.72
    rows = frames.select(entity, F.when(ok, F.col(distance)).alias("x"))
    rows = rows.withColumn("med", F.median("x").over(Window.partitionBy(entity)))
    sums = rows.groupBy(entity).agg(F.count("x").alias("n"), (F.count("x") / F.count("*")).alias("support"), F.stddev_pop("x").alias("sd"), F.avg(F.abs(F.col("x") - F.col("med"))).alias("off"))
    score = F.when(F.col("n") >= 4, 0.72 * logistic(F.col("sd"), 3.2, 1.1) + 0.28 * logistic(F.col("off"), 1.4, 0.55)).otherwise(0.0)
    s = F.col("score")
    return sums.withColumn("score", score).select(
        entity, clip01(s).alias("score"), "support", *_found(s > 0.50, F.when(s > 0.68, "MAJOR").otherwise("MINOR"), F.col("sd"), F.col("sd") / 1.5, F.least(0.50 + 0.28 * s, F.lit(0.90)))
    )


def decoupling(frames: DataFrame, entity: str, reliability: str, face: str, scene: str) -> DataFrame:
    """Motion of a region that drifts from its own relation to the scene."""
    ok = (F.col(reliability) >= 0.72) & (F.col(face) >= 0.05) & (F.col(scene) >= 0.05)
    rows = frames.select(entity, F.when(ok, F.col(face)).alias("f"), F.when(ok, F.col(scene)).alias("g"))
    rows = rows.withColumn("r", F.col("f") / (F.col("g") + 0.08)).withColumn("med", F.median("r").over(Window.partitionBy(entity)))
    sums = rows.groupBy(entity).agg(
        F.count("r").alias("n"), (F.count("r") / F.count("*")).alias("support"), _correlation(F.col("f"), F.col("g")).alias("corr"), F.median(F.abs(F.col("r") - F.col("med"))).alias("drift")
    )
    score = F.when(F.col("n") >= 5, 0.35 * logistic(1.0 - F.col("corr"), 0.78, 0.18) + 0.65 * logistic(F.col("drift"), 0.18, 0.07)).otherwise(0.0)
    s, drift = F.col("score"), F.col("drift")
    return sums.withColumn("score", score).select(
        entity, clip01(s).alias("score"), "support",
        *_found((s > 0.58) & (drift > 0.16), F.when(s > 0.70, "MAJOR").otherwise("MINOR"), drift, drift / 0.08, F.least(0.50 + 0.28 * s, F.lit(0.90))),
    )


def boundary(frames: DataFrame, entity: str, reliability: str, seam: str, channels: tuple[str, str, str], warp: str, edge: str) -> DataFrame:
    """Scores and supports of the four boundary parts; a frame without a value isn't usable.

    seam: median; channels: mean deviation of three colour differences; warp: a small median
    error is what is suspicious; edge: deviation over mean.
    """
    rel = F.col(reliability)
    firm, clear = rel >= 0.50, rel >= 0.52
    color = clear & F.col(channels[0]).isNotNull()
    rows = frames.select(
        entity, F.when(firm, rel * F.col(seam)).alias("seam"), F.when(firm, rel * F.col(warp)).alias("warp"), F.when(clear, F.col(edge)).alias("edge"), *[F.when(color, F.col(c)).alias(f"c{k}") for k, c in enumerate(channels)]
    )
    flicker = (F.stddev_pop("c0") + F.stddev_pop("c1") + F.stddev_pop("c2")) / 3.0
    sums = rows.groupBy(entity).agg(
        *[(F.count(c) / F.count("*")).alias(f"{n}_support") for n, c in (("seam", "seam"), ("flicker", "c0"), ("warp", "warp"), ("edge", "edge"))], *[F.count(c).alias(f"n_{c}") for c in ("seam", "c0", "warp", "edge")],
        F.median("seam").alias("seam"), flicker.alias("flicker"), F.median("warp").alias("warp"), (F.stddev_pop("edge") / (F.avg("edge") + TINY)).alias("edge"),
    )
    gate = lambda n, least, s: F.when(F.col(n) >= least, clip01(s)).otherwise(0.0)
    return sums.select(
        entity, gate("n_seam", 3, logistic(F.col("seam"), 0.62, 0.14)).alias("seam_score"), gate("n_c0", 4, logistic(F.col("flicker"), 9.0, 3.0)).alias("flicker_score"),
        gate("n_warp", 3, 1.0 - logistic(F.col("warp"), 0.20, 0.08)).alias("warp_score"), gate("n_edge", 4, logistic(F.col("edge"), 0.24, 0.07)).alias("edge_score"),
        "seam_support", "flicker_support", "warp_support", "edge_support",
    )
