"""Queries over timelines: smoothing, jitter, spans, intervals, evidence, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import boxes, scalars
from ..operators import evidence, quantiles, scans, scoring, series, spans
from ..sources.scratch import materialize
from .registry import query, rounded
from .views import SC, TL, clip, scored, sig, table, timeline

ORDER = ["seq"]


@query(f"WITH {TL} SELECT v, seq, round(CASE WHEN count(*) OVER (PARTITION BY v) < 5 THEN x ELSE sum(x) OVER (PARTITION BY v ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE END, 6) AS smoothed FROM tl")
def smooth_series(spark: SparkSession, d: str) -> DataFrame:
    """Centred moving sums over five observations."""
    tl = timeline(spark, d)
    return rounded(tl.select("v", "seq", series.smooth(F.col("x"), "v", ORDER, 5).alias("smoothed")))


@query(f"WITH {TL}, j AS (SELECT v, abs(x - lag(x) OVER (PARTITION BY v ORDER BY seq)) AS j FROM tl) SELECT v, round(quantile_cont(j, 0.88), 6) AS p88, round(avg(j), 6) AS mean FROM j GROUP BY v")
def jitter_p88(spark: SparkSession, d: str) -> DataFrame:
    """88th percentile and mean of the absolute first difference."""
    tl = timeline(spark, d).withColumn("j", series.jitter(F.col("x"), "v", ORDER))
    tl = materialize(tl.select("v", "j"), "jitter")
    p88 = quantiles.grouped_quantiles(tl, ["v"], "j", {"p88": 0.88})
    return rounded(p88.join(tl.groupBy("v").agg(F.avg("j").alias("mean")), "v"))


@query(
    f"WITH {TL}, a AS (SELECT v, seq, x, abs(lead(x) OVER w - 2 * x + lag(x) OVER w) AS a FROM tl WINDOW w AS (PARTITION BY v ORDER BY seq)) "
    "SELECT v, seq, round(a, 6) AS accel, round(a / (greatest(x, 0.08::DOUBLE) + 1e-6), 6) AS relative FROM a WHERE a IS NOT NULL"
)
def second_diff(spark: SparkSession, d: str) -> DataFrame:
    """Second difference, plain and by the level."""
    tl = timeline(spark, d)
    out = tl.select("v", "seq", series.acceleration(F.col("x"), "v", ORDER).alias("accel"), series.relative_acceleration(F.col("x"), "v", ORDER).alias("relative"))
    return rounded(out.where("accel is not null"))


@query(
    f"WITH {TL}, d AS (SELECT v, seq, abs(x - lag(x) OVER (PARTITION BY v ORDER BY seq)) AS d FROM tl), e AS (SELECT * FROM d WHERE d IS NOT NULL), "
    "a AS (SELECT v, abs(d - lag(d) OVER (PARTITION BY v ORDER BY seq)) AS a FROM e) "
    "SELECT v, round(CASE WHEN count(*) > 2 THEN avg(a) ELSE 0 END, 6) AS accel_mean FROM a GROUP BY v"
)
def accel_of_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.difference_acceleration(timeline(spark, d), "v", ORDER, "x"))


@query(
    f"WITH {TL}, m AS (SELECT v, seq, x, avg(x) OVER w AS my, avg(CAST(seq AS DOUBLE)) OVER w AS mx FROM tl WINDOW w AS (PARTITION BY v)), "
    "b AS (SELECT v, sum((seq - mx) * (x - my)) / nullif(sum((seq - mx) * (seq - mx)), 0) AS b FROM m GROUP BY v) "
    "SELECT m.v, round(CASE WHEN count(*) >= 6 THEN stddev_pop(x - (my + coalesce(b, 0) * (seq - mx))) / (avg(x) + 1e-6) ELSE 0 END, 6) AS trend_residual "
    "FROM m JOIN b ON m.v = b.v GROUP BY m.v"
)
def trend_residual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.trend_residual(timeline(spark, d), "v", ORDER, "x"))


@query(f"WITH {TL} SELECT v, round(stddev_pop(x) / (avg(x) + 1e-6), 6) AS cv, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(coalesce(kurtosis_pop(x), 0), 4) AS kurt FROM tl GROUP BY v HAVING count(*) >= 4")
def coefficient_of_variation(spark: SparkSession, d: str) -> DataFrame:
    tl = timeline(spark, d).groupBy("v").agg(F.count(F.lit(1)).alias("n"), series.coefficient_of_variation(F.col("x")).alias("cv"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.coalesce(F.kurtosis("x"), F.lit(0.0)).alias("kurt"))
    out = rounded(tl.where("n >= 4").drop("n"))
    return out.withColumn("kurt", F.round("kurt", 4))


@query(
    f"WITH {TL}, m AS (SELECT v, x, median(x) OVER (PARTITION BY v) AS med FROM tl) "
    "SELECT v, round(median(x), 6) AS median, round(median(abs(x - med)), 6) AS mad, round(median(abs(x - med)) / (median(x) + 1e-6), 6) AS dispersion FROM m GROUP BY v"
)
def mad_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.dispersion(timeline(spark, d), "v", "x"))


@query(
    f"WITH {TL}, p AS (SELECT v, x / (n + 0.08::DOUBLE) AS r FROM (SELECT v, x, lead(x) OVER (PARTITION BY v ORDER BY seq) AS n FROM tl) WHERE n IS NOT NULL), "
    "m AS (SELECT v, r, median(r) OVER (PARTITION BY v) AS med FROM p) SELECT v, round(median(abs(r - med)), 6) AS drift FROM m GROUP BY v"
)
def baseline_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the ratio of consecutive observations."""
    pairs = series.paired(timeline(spark, d), "v", ORDER, "x")
    return rounded(series.baseline_drift(pairs, "v", "x", "next_value"))


@query(
    f"WITH {TL}, h AS (SELECT *, CASE WHEN ok THEN x ELSE 0 END AS h FROM tl), "
    "s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY v) < 3 THEN h ELSE sum(h) OVER (PARTITION BY v ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE END AS sm FROM h), "
    "b AS (SELECT *, median(CASE WHEN ok THEN sm END) OVER (PARTITION BY v) AS base FROM s) "
    f"SELECT v, seq, round(CASE WHEN ok THEN {clip(f'0.2 * {sig('greatest(h - base, 0.0)', 0.12, 0.05)} + 0.8 * {sig('abs(h - base)', 0.055, 0.022)}')} ELSE 0 END, 6) AS deviation FROM b"
)
def deviation_from_valid_median(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each observation from the median of the valid smoothed ones."""
    out = series.valid_deviation(timeline(spark, d), "v", ORDER, "x", "ok", 3, (0.20, 0.12, 0.05), (0.80, 0.055, 0.022))
    return rounded(out.select("v", "seq", "deviation"))


@query(
    f"WITH {TL}, c AS (SELECT v, seq, x - median(x) OVER (PARTITION BY v) AS z FROM tl), s AS (SELECT v, seq, sign(z) AS s FROM c WHERE abs(z) > 0.10), "
    "f AS (SELECT v, CASE WHEN s * lag(s) OVER (PARTITION BY v ORDER BY seq) < 0 THEN 1 ELSE 0 END AS f FROM s), g AS (SELECT v, sum(f) AS n FROM f GROUP BY v) "
    "SELECT u.v, CAST(coalesce(n, 0) AS BIGINT) AS reversals FROM (SELECT DISTINCT v FROM tl) u LEFT JOIN g ON u.v = g.v"
)
def sign_reversals(spark: SparkSession, d: str) -> DataFrame:
    tl = quantiles.with_quantile(timeline(spark, d), "v", "x", "middle").withColumn("z", F.col("x") - F.col("middle"))
    return series.sign_reversals(tl, "v", ORDER, "z")


@query(
    f"WITH {TL}, p AS (SELECT v, x, lead(x) OVER (PARTITION BY v ORDER BY seq) AS n FROM tl) "
    "SELECT v, round(coalesce(covar_pop(x, n) / nullif(stddev_pop(x) * stddev_pop(n), 0), 0), 6) AS correlation FROM p WHERE n IS NOT NULL GROUP BY v"
)
def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of neighbouring observations, 0 if a side is constant."""
    pairs = series.paired(timeline(spark, d), "v", ORDER, "x")
    return rounded(pairs.groupBy("v").agg(series.guarded_correlation(F.col("x"), F.col("next_value")).alias("correlation")))


@query(
    f"WITH {TL}, c AS (SELECT v, x, CASE WHEN kind = 'click' THEN x ELSE 0 END AS a, CASE WHEN kind = 'view' THEN x ELSE 0 END AS b FROM tl) "
    "SELECT v, round((stddev_pop(x) + stddev_pop(a) + stddev_pop(b)) / 3.0::DOUBLE, 6) AS channel_deviation FROM c GROUP BY v"
)
def channel_deviation(spark: SparkSession, d: str) -> DataFrame:
    tl = timeline(spark, d)
    for name, kind in (("a", "click"), ("b", "view")):
        tl = tl.withColumn(name, F.when(F.col("kind") == kind, F.col("x")).otherwise(0.0))
    return rounded(series.mean_channel_deviation(tl, "v", ["x", "a", "b"]))


@query(
    f"WITH RECURSIVE {TL}, e AS (SELECT v, seq, x AS s FROM tl WHERE seq = 0 UNION ALL SELECT t.v, t.seq, 0.8::DOUBLE * e.s + 0.2::DOUBLE * t.x FROM e JOIN tl t ON t.v = e.v AND t.seq = e.seq + 1) "
    "SELECT v, seq, round(s, 6) AS smoothed FROM e"
)
def ema_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Running exponential smoothing, a row per observation."""
    return rounded(scans.smoothed(timeline(spark, d), "v", ORDER, "x").select("v", "seq", "smoothed"))


@query(
    "WITH RECURSIVE b AS (SELECT l_orderkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (l_partkey % 40)::INT AS x1, (l_suppkey % 30)::INT AS y1, (l_partkey % 40 + 2 + l_quantity % 23)::INT AS x2, (l_suppkey % 30 + 3 + l_linenumber * 4)::INT AS y2, l_discount::DOUBLE AS r FROM lineitem), "
    "e AS (SELECT v, i, x1, y1, x2, y2, r FROM b WHERE i = 1 UNION ALL SELECT v, i, x1, y1, greatest(x1 + 1, least(x2, 64)), greatest(y1 + 1, least(y2, 48)), r FROM ("
    "SELECT b.v, b.i, greatest(0, least(round_even(0.8::DOUBLE * e.x1 + 0.2::DOUBLE * b.x1, 0)::INT, 63)) AS x1, greatest(0, least(round_even(0.8::DOUBLE * e.y1 + 0.2::DOUBLE * b.y1, 0)::INT, 47)) AS y1, "
    "round_even(0.8::DOUBLE * e.x2 + 0.2::DOUBLE * b.x2, 0)::INT AS x2, round_even(0.8::DOUBLE * e.y2 + 0.2::DOUBLE * b.y2, 0)::INT AS y2, 0.82::DOUBLE * e.r + 0.18::DOUBLE * b.r AS r FROM e JOIN b ON b.v = e.v AND b.i = e.i + 1)) "
    "SELECT v, i, x1, y1, x2, y2, round(r, 6) AS reliability FROM e"
)
def box_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and their reliability smoothed along each order's lines, rounded at each step."""
    c = F.col
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("v"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    rows = series.numbered(rows, "v", ["l_linenumber", "l_partkey", "l_suppkey"], "i").withColumn("i", (c("i") + 1).cast("long"))
    x, y = c("l_partkey") % 40, c("l_suppkey") % 30
    rows = rows.select("v", "i", *[e.cast("int").alias(n) for n, e in (("x1", x), ("y1", y), ("x2", x + 2 + c("l_quantity") % 23), ("y2", y + 3 + c("l_linenumber") * 4))], c("l_discount").cast("double").alias("reliability"))
    out = scans.smoothed_boxes(rows, "v", ["i"], 64, 48)
    return rounded(out.select("v", "i", *[c(f"s_{n}").alias(n) for n in ("x1", "y1", "x2", "y2", "reliability")]))


_SPANS = f"""{TL}, f AS (SELECT v, seq, x FROM tl WHERE x > 0.5),
 n AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY v ORDER BY seq) <= 2 THEN 0 ELSE 1 END AS n FROM f),
 r AS (SELECT *, sum(n) OVER (PARTITION BY v ORDER BY seq) AS run FROM n),
 sp AS (SELECT v, min(seq) AS s, max(seq) AS e, max(x) AS peak FROM r GROUP BY v, run HAVING max(seq) - min(seq) + 1 >= 2)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.sustained_spans(timeline(spark, d), "v", "seq", F.col("x") > 0.5, 2, 1, F.col("x"))


@query(f'WITH {_SPANS} SELECT v, s AS "start", e AS "end", round(peak, 6) AS peak FROM sp')
def sustained_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of high observations, short gaps bridged."""
    return rounded(_spans(spark, d))


@query(f'WITH {_SPANS} SELECT v, s AS "start", e AS "end", round(peak, 6) AS peak, nth, (s + e) // 2 AS middle FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s) AS nth FROM sp) WHERE nth <= 3')
def first_k_spans(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spans.first_spans(_spans(spark, d), "v", 3))


#: Findings made of the spans of each kind of event.
_FOUND = f"""{TL}, f AS (SELECT v, kind, seq, x FROM tl WHERE x > 0.5),
 n AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY v, kind ORDER BY seq) <= 7 THEN 0 ELSE 1 END AS n FROM f),
 r AS (SELECT *, sum(n) OVER (PARTITION BY v, kind ORDER BY seq) AS run FROM n),
 vio AS (SELECT v, CASE kind WHEN 'click' THEN 'FACE_MOTION' WHEN 'view' THEN 'RIGID_BODY' WHEN 'error' THEN 'WARP_PREDICTION_ERROR' WHEN 'purchase' THEN 'FACE_TEXTURE' ELSE 'EDGE_INSTABILITY' END AS violation_type,
   min(seq) AS frame_start, max(seq) AS frame_end, max(x) AS measured_value, 0.45::DOUBLE AS expected_value, max(x) / 0.45::DOUBLE AS violation_ratio,
   least(0.56::DOUBLE + 0.15::DOUBLE * max(x), 0.95::DOUBLE) AS confidence, CASE WHEN max(x) > 1.05 THEN 'MAJOR' ELSE 'MINOR' END AS severity
   FROM r GROUP BY v, kind, run)"""
_TYPES = {"click": "FACE_MOTION", "view": "RIGID_BODY", "error": "WARP_PREDICTION_ERROR", "purchase": "FACE_TEXTURE"}


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each entity: spans of high observations by kind of event."""
    tl = timeline(spark, d).withColumn("key", F.struct("v", "kind"))
    found = spans.sustained_spans(tl, "key", "seq", F.col("x") > 0.5, 1, 6, F.col("x"))
    kind = F.lit("EDGE_INSTABILITY")
    for k, name in _TYPES.items():
        kind = F.when(F.col("key.kind") == k, name).otherwise(kind)
    peak = F.col("peak")
    return found.select(
        F.col("key.v").alias("v"), kind.alias("violation_type"), F.col("start").alias("frame_start"), F.col("end").alias("frame_end"), peak.alias("measured_value"), F.lit(0.45).alias("expected_value"),
        (peak / 0.45).alias("violation_ratio"), F.least(0.56 + 0.15 * peak, F.lit(0.95)).alias("confidence"), F.when(peak > 1.05, "MAJOR").otherwise("MINOR").alias("severity"),
    )


_MERGED = """w AS (SELECT *, max(frame_end) OVER (PARTITION BY v, violation_type ORDER BY frame_start, frame_end, measured_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM vio),
 x AS (SELECT *, sum(CASE WHEN frame_start - reach <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY v, violation_type ORDER BY frame_start, frame_end, measured_value ROWS UNBOUNDED PRECEDING) AS island FROM w),
 mg AS (SELECT v, violation_type, min(frame_start) AS frame_start, max(frame_end) AS frame_end, max(measured_value) AS measured_value, min(expected_value) AS expected_value, max(violation_ratio) AS violation_ratio,
   max(confidence) AS confidence, count(*) AS n_merged, CASE WHEN bool_or(severity = 'MAJOR') THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM x GROUP BY v, violation_type, island)"""


@query(f"WITH {_FOUND}, {_MERGED} SELECT v, violation_type, frame_start, frame_end, round(measured_value, 6) AS measured_value, round(expected_value, 6) AS expected_value, round(violation_ratio, 6) AS violation_ratio, round(confidence, 6) AS confidence, n_merged, severity FROM mg")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Findings of one type that are close to each other as one."""
    return rounded(spans.merged_intervals(findings(spark, d), "v"))


@query(f"WITH {TL} SELECT v, seq, round(x, 6) AS x, rank FROM (SELECT v, seq, x, row_number() OVER (PARTITION BY v ORDER BY x DESC, seq) AS rank FROM tl) WHERE rank <= 8")
def top_k_frames(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.top_rows(timeline(spark, d), "v", "x", "seq", 8).select("v", "seq", "x", "rank"))


@query(f"WITH {TL} SELECT v, round(avg(x), 6) AS top_mean FROM (SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY x DESC, seq) AS r FROM tl) WHERE r <= 3 GROUP BY v")
def top3_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.top_mean(timeline(spark, d), "v", "x", "seq"))


#: Motion signals made of an observation and its neighbours.
_MOTION = f"""{TL}, sg AS (SELECT v, seq, x, abs(x - lag(x, 1, x) OVER w) AS dv, {clip("x / 3.0::DOUBLE")} AS fl, abs(x - lead(x, 1, x) OVER w) AS mm, {clip("x")} * 0.9::DOUBLE AS cp FROM tl WINDOW w AS (PARTITION BY v ORDER BY seq)),
 lv AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY v) < 5 THEN x ELSE sum(x) OVER (PARTITION BY v ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE END AS level FROM sg),
 ac AS (SELECT *, abs(lead(level) OVER w - 2 * level + lag(level) OVER w) / (greatest(level, 0.08::DOUBLE) + 1e-6) AS accel FROM lv WINDOW w AS (PARTITION BY v ORDER BY seq)),
 mo AS (SELECT v, seq, level, accel, 0.22 * {sig("accel", 0.55, 0.18)} + 0.18 * {sig("dv", 0.72, 0.24)} + 0.12 * {sig("fl", 0.18, 0.06)} + 0.28 * {sig("mm", 0.62, 0.16)} + 0.20 * {sig("cp", 0.46, 0.12)} AS anomaly,
   concat_ws(',', CASE WHEN accel > 1.0 THEN 'INERTIA' END, CASE WHEN dv > 1.08 THEN 'DIVERGENCE' END, CASE WHEN fl > 0.26 THEN 'FLICKER' END, CASE WHEN mm > 0.92 THEN 'FACE_MOTION' END, CASE WHEN cp > 0.70 THEN 'FACE_COMPONENTS' END) AS flags,
   (accel > 1.0)::INT + (dv > 1.08)::INT + (fl > 0.26)::INT + (mm > 0.92)::INT + (cp > 0.70)::INT AS n_flags, mm, cp
   FROM ac WHERE accel IS NOT NULL)"""


def motion(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("v").orderBy("seq")
    x = F.col("x")
    tl = timeline(spark, d).withColumn("dv", F.abs(x - F.coalesce(F.lag("x").over(w), x))).withColumn("fl", scalars.clip01(x / 3.0))
    tl = tl.withColumn("mm", F.abs(x - F.coalesce(F.lead("x").over(w), x))).withColumn("cp", scalars.clip01(x) * 0.9)
    return scoring.motion_timeline(tl, "v", ORDER, "x", {"divergence": "dv", "flicker": "fl", "mismatch": "mm", "component": "cp"})


@query(f"WITH {_MOTION} SELECT v, seq, round(level, 6) AS level, round(accel, 6) AS accel, round(anomaly, 6) AS anomaly, flags FROM mo")
def frame_anomaly_l1(spark: SparkSession, d: str) -> DataFrame:
    """Motion anomaly and flags of each observation."""
    return rounded(motion(spark, d).select("v", "seq", "level", "accel", "anomaly", F.concat_ws(",", "flags").alias("flags")))


@query(
    f"WITH {_MOTION}, sm AS (SELECT v, seq FROM mo WHERE greatest(mm, cp) > 0.94), g AS (SELECT v, seq, CASE WHEN seq - lag(seq) OVER (PARTITION BY v ORDER BY seq) <= 2 THEN 0 ELSE 1 END AS n FROM sm), "
    "h AS (SELECT v, seq, sum(n) OVER (PARTITION BY v ORDER BY seq) AS run FROM g), k AS (SELECT DISTINCT v FROM (SELECT v FROM h GROUP BY v, run HAVING max(seq) - min(seq) >= 1)), "
    "a AS (SELECT v, avg(anomaly) AS m FROM mo GROUP BY v) "
    f"SELECT a.v, round({clip('m + CASE WHEN k.v IS NULL THEN 0 ELSE 0.03 END')}, 6) AS l1, k.v IS NOT NULL AS has_motion FROM a LEFT JOIN k ON a.v = k.v"
)
def l1_score(spark: SparkSession, d: str) -> DataFrame:
    """Motion level of an entity, with a bonus for sustained motion."""
    return rounded(motion_levels(spark, d))


def motion_levels(spark: SparkSession, d: str) -> DataFrame:
    """v, l1, has_motion."""
    # read twice, so it is written
    mo = materialize(motion(spark, d).select("v", "seq", "anomaly", (F.greatest("mm", "cp") > 0.94).alias("moves")), "motion")
    held = spans.sustained_spans(mo, "v", "seq", F.col("moves"), 2, 1).select("v").distinct().withColumn("has_motion", F.lit(True))
    out = mo.groupBy("v").agg(F.avg("anomaly").alias("m")).join(held, "v", "left").withColumn("has_motion", F.coalesce("has_motion", F.lit(False)))
    return out.select("v", scoring.motion_score(F.col("m"), F.col("has_motion")).alias("l1"), "has_motion")


#: Signals of an entity in [0, 1] that stand in for the checks of the levels.
_SIGNALS = f"""{TL}, sn AS (SELECT v,
   {clip("avg(x)")} AS a, {clip("stddev_pop(x)")} AS b, {clip("max(x) / 4.0::DOUBLE")} AS c, {clip("median(x)")} AS e,
   avg(ok::INT) AS support, avg((kind = 'click')::INT) AS clicks, avg((kind = 'view')::INT) AS views, avg((x > 0.5)::INT) AS high FROM tl GROUP BY v)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return timeline(spark, d).groupBy("v").agg(
        scalars.clip01(F.avg("x")).alias("a"), scalars.clip01(F.stddev_pop("x")).alias("b"), scalars.clip01(F.max("x") / 4.0).alias("c"), scalars.clip01(F.median("x")).alias("e"),
        share(F.col("ok")).alias("support"), share(F.col("kind") == "click").alias("clicks"), share(F.col("kind") == "view").alias("views"), share(F.col("x") > 0.5).alias("high"),
    )


@query(
    f"WITH {_SIGNALS}, g AS (SELECT *, {sig('greatest(b, c)', 0.52, 0.12)} * least(1.0, support / 0.40) AS lg, {sig('greatest(b, c)', 0.50, 0.14)} * least(1.0, high / 0.40) AS sg FROM sn) "
    f"SELECT v, round({clip('0.05 * a + 0.52 * b * (CASE WHEN clicks > 0 THEN least(1.0, clicks / 0.35) ELSE 0 END) + 0.06 * e * lg + 0.12 * a * sg + 0.25 * c * (CASE WHEN views > 0 THEN least(1.0, views / 0.35) ELSE 0 END)')}, 6) AS l2, "
    "round(lg, 6) AS light_gate, round(sg, 6) AS skin_gate, lg >= 0.45 AS light_kept, sg >= 0.45 AS skin_kept FROM g"
)
def level2_physics(spark: SparkSession, d: str) -> DataFrame:
    """Gated mix of five checks."""
    c = F.col
    parts = scoring.physics_score(c("a"), c("b"), c("e"), c("a"), c("c"), c("clicks"), c("views"), c("support"), c("high"))
    return rounded(signals(spark, d).select("v", *[x.alias(n) for n, x in parts.items()]))


@query(
    f"WITH {_SIGNALS} SELECT v, round({clip('0.12 * a + 0.18 * b + 0.70 * c')}, 6) AS l3, round(0.16 * a + 0.18 * b + 0.66 * c, 6) AS frame_score, "
    "concat_ws(',', CASE WHEN a > 0.80 THEN 'COLOR_DRIFT' END, CASE WHEN b > 0.80 THEN 'FACE_BOUNDARY' END, CASE WHEN c > 0.82 THEN 'FACE_TEXTURE' END) AS flags FROM sn"
)
def level3_semantic(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rounded(
        signals(spark, d).select(
            "v", scoring.semantic_score(c("a"), c("b"), c("c")).alias("l3"), scoring.semantic_frame_score(c("a"), c("b"), c("c")).alias("frame_score"),
            F.concat_ws(",", scoring.semantic_flags(c("a"), c("b"), c("c"))).alias("flags"),
        )
    )


_L4 = f"""nn AS (SELECT *, (e >= 0.20)::INT + (a >= 0.15)::INT + (c >= 0.40)::INT + (b >= 0.15)::INT AS n, greatest(e, a, b) AS o FROM sn),
 bb AS (SELECT *, 0.46 * c * (0.40 + 0.60 * o) + 0.20 * a + 0.18 * b + 0.16 * e AS z FROM nn),
 cc AS (SELECT *, (CASE WHEN n >= 3 THEN z + 0.04 * least(c, o) WHEN n = 2 THEN z + 0.03 * least(c, o) ELSE z * 0.88 END)
   + (CASE WHEN c > 0.44 AND a < 0.10 AND b < 0.10 AND e < 0.18 THEN -0.06 ELSE 0 END) + (CASE WHEN e > 0.55 AND c < 0.28 AND a < 0.14 AND b < 0.14 THEN -0.07 ELSE 0 END)
   + (CASE WHEN c > 0.50 AND e > 0.20 THEN 0.03 ELSE 0 END) + (CASE WHEN b > 0.22 AND a > 0.15 AND (c > 0.34 OR e > 0.24) THEN 0.03 ELSE 0 END) + (CASE WHEN c > 0.58 AND o > 0.18 THEN 0.02 ELSE 0 END) AS y FROM bb),
 l4 AS (SELECT *, {clip(f"{clip('y')} * (CASE WHEN support > 0 THEN least(1.0, support / 0.35) ELSE 0 END)")} AS l4 FROM cc)"""


def _boundary(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("n", scoring.boundary_agreement(c("e"), c("a"), c("c"), c("b"))).withColumn("l4", scoring.boundary_score(c("e"), c("a"), c("c"), c("b"), c("support")))


@query(f"WITH {_SIGNALS}, {_L4} SELECT v, n AS agreement, round(l4, 6) AS l4 FROM l4")
def level4_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Boundary level from four signals."""
    return rounded(_boundary(signals(spark, d)).select("v", F.col("n").alias("agreement"), "l4"))


def _rule(kind, col, limit, needs, major, expected, base, slope, cap) -> str:
    return (
        f"SELECT v, '{kind}' AS violation_type, CASE WHEN {col} > {major} THEN 'MAJOR' ELSE 'MINOR' END AS severity, {col} AS measured_value, {expected}::DOUBLE AS expected_value, "
        f"{col} / {expected}::DOUBLE AS violation_ratio, least({base}::DOUBLE + {slope}::DOUBLE * {col}, {cap}::DOUBLE) AS confidence FROM l4 WHERE {col} > {limit}" + (" AND n >= 2" if needs else "")
    )


_SIDE = {"seam": "e", "color": "a", "warp": "c", "edge": "b"}
_RULES = " UNION ALL ".join(_rule(k, _SIDE[n], *rest) for k, n, *rest in scoring.BOUNDARY_RULES)


@query(f"WITH {_SIGNALS}, {_L4}, r AS ({_RULES}) SELECT v, violation_type, severity, round(measured_value, 9) AS measured_value, round(expected_value, 9) AS expected_value, round(violation_ratio, 9) AS violation_ratio, round(confidence, 9) AS confidence FROM r")
def boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the four boundary rules."""
    return rounded(scoring.boundary_violations(signals(spark, d), ["v"], "e", "a", "c", "b"), 9)


@query(
    f"WITH {_SIGNALS}, {_L4}, w AS (SELECT v, l4, a, support, clicks FROM l4) SELECT v, "
    "round(CASE WHEN support < 0.75 THEN a * greatest(0.35, support / 0.75) ELSE a END, 6) AS l3_down, round(CASE WHEN clicks < 0.22 THEN l4 * (0.45 + 0.55 * least(1.0, clicks / 0.22)) ELSE l4 END, 6) AS l4_down FROM w"
)
def reliability_weighting(spark: SparkSession, d: str) -> DataFrame:
    """Levels three and four where their support is weak."""
    third, fourth = scoring.weighted_down(F.col("a"), F.col("l4"), F.col("support"), F.col("clicks"))
    return rounded(_boundary(signals(spark, d)).select("v", third.alias("l3_down"), fourth.alias("l4_down")))


@query(
    f"WITH {_SIGNALS}, {_FOUND.replace(TL + ', ', '')} SELECT vio.v, violation_type, CASE WHEN high > 0.35 THEN severity ELSE 'MINOR' END AS severity, round(CASE WHEN high > 0.35 THEN confidence ELSE least(confidence, 0.82) END, 6) AS confidence "
    "FROM vio JOIN sn ON vio.v = sn.v WHERE high > 0.35 OR (violation_type = 'FACE_TEXTURE' AND confidence >= 0.82 AND support >= 0.80)"
)
def static_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Findings that stay where nothing dynamic supports them."""
    rows = findings(spark, d).join(signals(spark, d).select("v", "high", "support"), "v")
    out = scoring.without_static(rows, F.col("high") > 0.35, F.col("support"))
    return rounded(out.select("v", "violation_type", "severity", "confidence"))


#: Fusion over the signals: l1 = high, l5 = e, warp = c, seam = e, colour = a, edge = b.
_FUSED = f"""{_SIGNALS}, {_L4},
 fu AS (SELECT *, {clip("greatest(least(c, greatest(a, b)), least(e, greatest(a, b)), 0.75 * least(c, e))")} AS co FROM l4),
 tc AS (SELECT *, {clip("0.72 * e + 0.10 * l4 + 0.10 * (e * " + clip("c") + ") + 0.05 * high + 0.03 * co + (CASE WHEN e > 0.55 AND c > 0.35 THEN 0.03 ELSE 0 END) + (CASE WHEN a * 3 > 1.45 AND b > 0.165 THEN 0.02 ELSE 0 END) - (CASE WHEN support < 0.35 THEN 0.05 ELSE 0 END) - (CASE WHEN clicks < 0.25 THEN 0.03 ELSE 0 END)")} AS score FROM fu)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score = scoring.fused_score(c("high"), c("l4"), c("e"), c("c"), c("e"), c("a"), c("b"), c("a") * 3.0, c("b"), c("support"), c("clicks"))
    return _boundary(signals(spark, d)).withColumn("score", score)


@query(f"WITH {_FUSED} SELECT v, round(score, 6) AS score, round(l4, 6) AS l4, round(co, 6) AS corroboration FROM tc")
def tcs_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of each entity."""
    c = F.col
    return rounded(fused(spark, d).select("v", "score", "l4", scoring.corroboration(c("c"), c("e"), c("a"), c("b")).alias("corroboration")))


_REASON = """rs AS (SELECT *, CASE WHEN clicks < 0.12 AND support < 0.85 THEN 'low' ELSE '' END AS dummy,
   CASE WHEN clicks < 0.22 AND support < 0.45 THEN 'weak_face_support' WHEN support < 0.35 THEN 'unreliable_face_roi' WHEN views < 0.14 AND clicks < 0.14 THEN 'insufficient_face_context'
   WHEN NOT (high > 0.35) AND NOT (b > 0.5) AND greatest(high, a, l4) < 0.18 THEN 'unsupported_open_world_content' ELSE '' END AS reason FROM tc)"""


@query(
    f"WITH {_FUSED}, {_REASON} SELECT v, round(score, 6) AS score, reason, CASE WHEN reason <> '' THEN 'INCONCLUSIVE' WHEN score >= 0.42 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END AS verdict, "
    "CASE WHEN abs(score - 0.42) > 0.20 THEN 'HIGH' WHEN abs(score - 0.42) > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM rs"
)
def entity_anomaly_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Score, abstention, verdict and confidence of each entity."""
    c = F.col
    reason = scoring.abstention(c("clicks"), c("support"), c("views"), c("clicks"), c("high"), c("a"), c("l4"), c("high") > 0.35, c("b") > 0.5)
    out = scoring.decided(fused(spark, d).withColumn("reason", reason), "score", "reason")
    return rounded(out.select("v", "score", "reason", "verdict", "confidence"))


@query(
    f"WITH {_SIGNALS}, {_FOUND.replace(TL + ', ', '')}, ty AS (SELECT v, list(DISTINCT violation_type) AS t, sum((severity = 'MAJOR')::INT) AS major, sum((severity = 'MINOR')::INT) AS minor FROM vio GROUP BY v), "
    "m0 AS (SELECT sn.*, coalesce(t, []::VARCHAR[]) AS t, coalesce(major, 0) AS major, coalesce(minor, 0) AS minor FROM sn LEFT JOIN ty ON sn.v = ty.v), "
    f"o AS (SELECT *, {clip('1.0 - c')} AS od FROM m0), n4 AS (SELECT *, (e >= 0.38)::INT + (a >= 0.38)::INT + (od >= 0.38)::INT + (b >= 0.38)::INT AS n FROM o), "
    "l AS (SELECT *, (CASE WHEN n < 2 THEN (0.72 * e + 0.18 * a + 0.10 * od) * 0.55 ELSE 0.42 * e + 0.24 * a + 0.22 * od + 0.12 * b END) * (CASE WHEN support > 0 THEN least(1.0, support / 0.35) ELSE 0 END) AS l4, "
    "list_contains(t, 'FACE_MOTION') AS fm, list_contains(t, 'RIGID_BODY') AS rb, list_has_any(t, ['WARP_PREDICTION_ERROR', 'EDGE_INSTABILITY']) AS art, "
    "len(t) > 0 AND NOT list_has_any(t, ['FACE_MOTION', 'RIGID_BODY', 'WARP_PREDICTION_ERROR']) AS sta FROM n4) "
    "SELECT v, round(l4, 6) AS l4, round(" + clip(
        "0.28 * high + 0.26 * b + 0.16 * a + 0.30 * l4 + least(0.025, 0.004 * major + 0.001 * minor) + (CASE WHEN fm THEN 0.06 ELSE 0 END) + (CASE WHEN fm AND high > 0.30 THEN 0.04 ELSE 0 END) "
        "+ (CASE WHEN rb AND fm AND views >= 0.25 THEN 0.02 ELSE 0 END) + (CASE WHEN fm AND support > 0.50 THEN 0.02 ELSE 0 END) + (CASE WHEN art AND l4 > 0.32 AND support >= 0.25 THEN 0.02 ELSE 0 END) "
        "- (CASE WHEN sta AND high < 0.30 AND b < 0.30 AND l4 < 0.26 THEN 0.10 ELSE 0 END) - (CASE WHEN rb AND NOT fm AND high < 0.22 THEN 0.06 ELSE 0 END) - (CASE WHEN support < 0.30 THEN 0.05 ELSE 0 END) "
        "- (CASE WHEN clicks < 0.30 THEN 0.06 ELSE 0 END) - (CASE WHEN support < 0.18 THEN 0.04 ELSE 0 END) - (CASE WHEN views < 0.18 AND NOT rb THEN 0.04 ELSE 0 END) - (CASE WHEN NOT fm AND NOT rb AND NOT art AND a > 0.50 THEN 0.08 ELSE 0 END)"
    ) + ", 6) AS score FROM l"
)
def smoke_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of the smoke track, with the types found."""
    c = F.col
    types = findings(spark, d).groupBy("v").agg(F.collect_set("violation_type").alias("t"), F.count_if(F.col("severity") == "MAJOR").alias("major"), F.count_if(F.col("severity") == "MINOR").alias("minor"))
    rows = signals(spark, d).join(types, "v", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>"))).na.fill(0, ["major", "minor"])
    rows = rows.withColumn("l4", scoring.smoke_boundary_score(c("e"), c("a"), c("c"), c("b"), c("support")))
    score = scoring.smoke_fused_score(c("high"), c("b"), c("a"), c("l4"), c("t"), F.lit(0), c("major"), c("minor"), c("support"), c("clicks"), c("support"), c("views"))
    return rounded(rows.select("v", "l4", score.alias("score")))


@query(
    f"WITH {TL}, a AS (SELECT v, seq // 4 AS bin, max(x) AS s, list_sort(list(DISTINCT kind)) AS f FROM tl WHERE ok GROUP BY ALL), b AS (SELECT v, seq // 4 AS bin, max(x) AS s, list_sort(list(DISTINCT kind)) AS f FROM tl WHERE NOT ok GROUP BY ALL) "
    "SELECT coalesce(a.v, b.v) AS v, coalesce(a.bin, b.bin) AS bin, round(greatest(a.s, b.s), 6) AS score, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.f, []), coalesce(b.f, [])))), ',') AS flags FROM a FULL JOIN b ON a.v = b.v AND a.bin = b.bin"
)
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of two detectors by place: the larger score, all flags."""
    tl = timeline(spark, d).withColumn("bin", F.floor(F.col("seq") / 4))
    side = lambda ok: tl.where(F.col("ok") == ok).groupBy("v", "bin").agg(F.max("x").alias("score"), F.array_sort(F.collect_set("kind")).alias("flags"))
    out = evidence.merge_evidence(side(True), side(False), ["v", "bin"])
    return rounded(out.select("v", "bin", "score", F.concat_ws(",", "flags").alias("flags")))


_COVER = f"""{_FOUND}, cv AS (SELECT t.v, t.seq, t.x,
   coalesce(bool_or(f.v IS NOT NULL), false) AS any_v, coalesce(bool_or(severity = 'MAJOR'), false) AS maj, coalesce(bool_or(violation_type IN ('FACE_MOTION', 'FACE_SCENE_DECOUPLING', 'RIGID_BODY')), false) AS dyn,
   coalesce(bool_or(violation_type IN ('WARP_PREDICTION_ERROR', 'FLOW_BOUNDARY_SEAM', 'EDGE_INSTABILITY', 'BOUNDARY_EDGE_FLICKER', 'FACE_TEXTURE')), false) AS bou, coalesce(max(confidence), 0) AS conf
   FROM tl t LEFT JOIN vio f ON f.v = t.v AND f.frame_start <= t.seq AND t.seq <= f.frame_end GROUP BY t.v, t.seq, t.x)"""


@query(f"WITH {_COVER} SELECT v, round(avg(any_v::INT), 6) AS covered, round(avg(maj::INT), 6) AS major, round(avg(dyn::INT), 6) AS dynamic, round(avg(bou::INT), 6) AS boundary FROM cv GROUP BY v")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Part of an entity's observations that findings cover."""
    rows = evidence.with_coverage(timeline(spark, d), findings(spark, d), "v", "seq")
    return rounded(rows.groupBy("v").agg(*[evidence.share(F.col(f"in_{c}")).alias(n) for n, c in (("covered", "any"), ("major", "major"), ("dynamic", "dynamic"), ("boundary", "boundary"))]))


@query(f"WITH {_COVER} SELECT v, round(avg(conf), 5) AS confidence_span FROM cv GROUP BY v")
def confidence_span(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the largest covering confidence."""
    rows = evidence.with_coverage(timeline(spark, d), findings(spark, d), "v", "seq")
    return rounded(rows.groupBy("v").agg(F.avg("covering_confidence").alias("confidence_span")), 5)


def _n(*types: str) -> str:
    return "sum((violation_type IN (" + ", ".join(f"'{t}'" for t in types) + "))::INT)"


@query(
    f"WITH {_COVER}, fl AS (SELECT cv.*, (x >= 0.45)::INT + (x >= 0.8)::INT + (x >= 1.5)::INT AS nf, {clip('x')} AS sc, row_number() OVER (PARTITION BY v ORDER BY {clip('x')} DESC, seq) AS rk FROM cv), "
    "a AS (SELECT v, avg(any_v::INT) AS violation_span_fraction, avg(maj::INT) AS major_span_fraction, 0.0::DOUBLE AS critical_span_fraction, avg(dyn::INT) AS dynamic_span_fraction, avg(bou::INT) AS boundary_span_fraction, avg(conf) AS confidence_weighted_span, "
    "max(sc) AS frame_anomaly_max, avg(CASE WHEN rk <= 3 THEN sc END) AS frame_anomaly_top3_mean, avg((sc >= 0.45)::INT) AS frame_anomaly_peak_fraction, avg(sc) AS frame_anomaly_mean, stddev_pop(sc) AS frame_anomaly_std, avg((nf >= 2)::INT) AS frame_multi_evidence_fraction FROM fl GROUP BY v), "
    f"b AS (SELECT v, {clip('count(*) / 12.0::DOUBLE')} AS violation_count, {clip(_n('X') + ' / 4.0::DOUBLE')} AS critical_violation_count, " + clip("sum((severity = 'MAJOR')::INT) / 8.0::DOUBLE") + " AS major_violation_count, "
    f"least(1.0::DOUBLE, 0.20 * {_n('FACE_MOTION')} + 0.20 * {_n('RIGID_BODY')} + 0.08 * {_n('FACE_TEXTURE')}) AS dynamic_violation_score, least(1.0::DOUBLE, 0.24 * {_n('WARP_PREDICTION_ERROR')} + 0.18 * {_n('EDGE_INSTABILITY')} + 0.10 * {_n('FACE_TEXTURE')}) AS boundary_violation_score, "
    f"{clip('avg(violation_ratio) / 8.0::DOUBLE')} AS violation_ratio_mean, {clip('max(violation_ratio) / 10.0::DOUBLE')} AS violation_ratio_max, ({_n('FACE_MOTION')} > 0)::INT AS has_face_motion, ({_n('RIGID_BODY')} > 0)::INT AS has_rigid_body, "
    f"({_n('WARP_PREDICTION_ERROR')} > 0)::INT AS has_warp_prediction_error, ({_n('EDGE_INSTABILITY')} > 0)::INT AS has_edge_instability, ({_n('FACE_TEXTURE')} > 0)::INT AS has_face_texture FROM vio GROUP BY v) "
    "SELECT a.v, " + ", ".join(
        f"round({c}, 12) AS {c}"
        for c in ("violation_span_fraction", "major_span_fraction", "critical_span_fraction", "dynamic_span_fraction", "boundary_span_fraction", "confidence_weighted_span", "frame_anomaly_max", "frame_anomaly_top3_mean", "frame_anomaly_peak_fraction", "frame_anomaly_mean", "frame_anomaly_std", "frame_multi_evidence_fraction")
    ) + ", " + ", ".join(
        f"round(coalesce({c}, 0)::DOUBLE, 12) AS {c}"
        for c in ("violation_count", "major_violation_count", "critical_violation_count", "dynamic_violation_score", "boundary_violation_score", "violation_ratio_mean", "violation_ratio_max", "has_face_motion", "has_rigid_body", "has_warp_prediction_error", "has_edge_instability", "has_face_texture")
    ) + ", 0.0::DOUBLE AS has_face_scene_decoupling, 0.0::DOUBLE AS has_flow_boundary_seam FROM a LEFT JOIN b ON a.v = b.v"
)
def forensic_features(spark: SparkSession, d: str) -> DataFrame:
    """All rollup features of each entity."""
    x = F.col("x")
    flags = F.array_compact(F.array(*[F.when(x >= t, F.lit(f"f{k}")) for k, t in enumerate((0.45, 0.8, 1.5))]))
    rows = timeline(spark, d).withColumn("sc", scalars.clip01(x)).withColumn("flags", flags)
    return rounded(evidence.forensic_features(rows, findings(spark, d), "v", "seq", "sc", "flags"), 12)  # means of 64 rows end at the tenth digit


@query(
    f"WITH {_SIGNALS} SELECT v, round(c * e, 9) AS warp_seam_interaction, round(c * a, 9) AS warp_color_interaction, round(c * b, 9) AS warp_edge_interaction, round(greatest(a, b), 9) AS boundary_peak_signal, "
    "round((e + a + b) / 3.0::DOUBLE, 9) AS boundary_mean_signal, round(high * support, 9) AS rigid_motion_interaction, round(clicks * support, 9) AS physics_motion_interaction, round(high * c, 9) AS rigid_warp_interaction FROM sn"
)
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rounded(signals(spark, d).select("v", *evidence.interaction_features(c("c"), c("e"), c("a"), c("b"), c("high"), c("clicks"), c("support"))), 9)


@query(f"WITH {TL}, n AS (SELECT v, count(*) AS total FROM tl GROUP BY v), s AS (SELECT *, greatest(1, floor(total / greatest(12, least(24, floor(greatest(total / 25.0::DOUBLE, 1.0) * 6))))) AS stride FROM n) SELECT v, CAST(unnest(range(0, least(24, CAST(ceil(total / stride) AS BIGINT)))) AS INT) AS seq, stride::INT AS stride, total FROM s")
def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Which observations of an entity a sampled decode reads."""
    from ..sources.media import sampled_indices

    n = timeline(spark, d).groupBy("v").agg(F.count(F.lit(1)).alias("total")).withColumn("fps", F.lit(25.0))
    return sampled_indices(n, "total", "fps", 6.0, 24).select("v", F.col("seq"), "stride", "total")


@query(
    "WITH b AS (SELECT p_partkey, p_size AS x1, p_partkey % 40 AS y1, p_size + 5 + p_partkey % 17 AS x2, p_partkey % 40 + 3 + p_size % 11 AS y2 FROM part), "
    "c AS (SELECT *, least(greatest(x1, 0), 63) AS cx1, least(greatest(y1, 0), 63) AS cy1 FROM b), "
    "k AS (SELECT *, greatest(cx1 + 1, least(x2, 64)) AS cx2, greatest(cy1 + 1, least(y2, 64)) AS cy2 FROM c), "
    "i AS (SELECT *, greatest(least(cx2, 40) - greatest(cx1, 8), 0) * greatest(least(cy2, 40) - greatest(cy1, 8), 0) AS i FROM k) "
    "SELECT p_partkey, CAST(cx1 AS INT) AS x1, CAST(cy1 AS INT) AS y1, CAST(cx2 AS INT) AS x2, CAST(cy2 AS INT) AS y2, (x1 + x2) * 0.5::DOUBLE AS cx, "
    "round(CASE WHEN i > 0 THEN i / (greatest(1, (cx2 - cx1) * (cy2 - cy1)) + 1024.0::DOUBLE - i) ELSE 0 END, 6) AS iou FROM i"
)
def box_ops(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clipped to an image, their centres and their overlap with a fixed box."""
    c = F.col
    p = table(spark, d, "part").select("p_partkey", boxes.box(c("p_size"), c("p_partkey") % 40, c("p_size") + 5 + c("p_partkey") % 17, c("p_partkey") % 40 + 3 + c("p_size") % 11).alias("b"))
    fixed = boxes.box(F.lit(8), F.lit(8), F.lit(40), F.lit(40))
    p = p.withColumn("k", boxes.clip_box(c("b"), F.lit(64), F.lit(64))).withColumn("iou", boxes.iou(c("k"), fixed))
    return rounded(p.select("p_partkey", "k.x1", "k.y1", "k.x2", "k.y2", boxes.center(c("b"))["x"].alias("cx"), "iou"))


@query(
    "WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x1, (p_size + 4 + p_partkey % 9)::DOUBLE AS x2 FROM part), g AS (SELECT p_partkey, (x1 + x2) * 0.5 - greatest(2.0, (x2 - x1) * 1.5::DOUBLE) * 0.5 AS lo, (x1 + x2) * 0.5 + greatest(2.0, (x2 - x1) * 1.5::DOUBLE) * 0.5 AS hi FROM b), "
    "h AS (SELECT p_partkey, least(greatest(CAST(round_even(lo, 0) AS INT), 0), 63) AS x1, CAST(round_even(hi, 0) AS INT) AS h FROM g) SELECT p_partkey, x1, greatest(x1 + 1, least(h, 64)) AS x2 FROM h"
)
def box_expand(spark: SparkSession, d: str) -> DataFrame:
    """Boxes grown about their centre."""
    c = F.col
    p = table(spark, d, "part").select("p_partkey", boxes.box(c("p_size"), F.lit(10), c("p_size") + 4 + c("p_partkey") % 9, F.lit(20)).alias("b"))
    return p.withColumn("g", boxes.expand_box(c("b"), 1.5, F.lit(64), F.lit(64))).select("p_partkey", "g.x1", "g.x2")
