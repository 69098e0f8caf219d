"""Queries that check timelines as if each observation were a frame with signals.

rel, a, b and c of a frame are fixed arithmetic over its place and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import checks, detector, scoring
from ..sources.scratch import materialize
from . import timeline_queries
from .registry import SQL, query, rounded, unrounded
from .views import TL, clip, sig, timeline

FS = f"""{TL}, fs AS (SELECT v, seq, 0.45::DOUBLE + 0.55::DOUBLE * ((seq * 7) % 11) / 10.0::DOUBLE AS rel, x AS a,
  x * (0.4::DOUBLE + ((seq * 5) % 7) / 7.0::DOUBLE) AS b, CASE WHEN seq % 4 < 2 THEN x ELSE -x END AS c FROM tl)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """v, seq, rel, a, b, c."""
    x, seq = F.col("x"), F.col("seq")
    return timeline(spark, d).select(
        "v", "seq", (0.45 + F.lit(0.55) * ((seq * 7) % 11) / 10.0).alias("rel"), x.alias("a"), (x * (0.4 + ((seq * 5) % 7) / 7.0)).alias("b"), F.when(seq % 4 < 2, x).otherwise(-x).alias("c")
    )


def _fires(when: str, severity: str, measured: str, ratio: str, confidence: str) -> str:
    values = {"measured_value": measured, "violation_ratio": ratio, "confidence": confidence}
    return f"CASE WHEN {when} THEN {severity} END AS severity, " + ", ".join(f"round(CASE WHEN {when} THEN {x} END, 6) AS {n}" for n, x in values.items())


@query(
    f"WITH {FS}, st AS (SELECT * FROM fs WHERE a > 0.22), sm AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY v) < 5 THEN c ELSE sum(c) OVER (PARTITION BY v ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE END AS s FROM st), "
    "sg AS (SELECT v, seq, sign(s) AS s, lag(sign(s)) OVER (PARTITION BY v ORDER BY seq) AS p FROM sm WHERE abs(s) > 0.10), g AS (SELECT v, count(*) AS signs, count(*) FILTER (s * p < 0)::DOUBLE AS r FROM sg GROUP BY v), "
    "m AS (SELECT v, median(abs(c)) / (median(abs(0.3::DOUBLE * b)) + 1e-6) AS dom, min(seq) AS s0, max(seq) AS s1 FROM st GROUP BY v HAVING count(*) >= 5), q AS (SELECT m.*, r FROM m JOIN g ON m.v = g.v AND signs >= 4) "
    f"SELECT u.v, round(CASE WHEN r IS NULL THEN 0 ELSE {clip(sig('r * greatest(0.0::DOUBLE, dom - 1.0::DOUBLE)', 1.5, 0.9) + ' * 0.38::DOUBLE')} END, 6) AS score, CASE WHEN r >= 2 AND dom > 1.55 THEN s0 END AS frame_start, CASE WHEN r >= 2 AND dom > 1.55 THEN s1 + 1 END AS frame_end, "
    + _fires("r >= 2 AND dom > 1.55", "'MAJOR'", "r", "greatest(1.0::DOUBLE, r)", "0.56::DOUBLE")
    + " FROM (SELECT DISTINCT v FROM fs) u LEFT JOIN q ON u.v = q.v"
)
def check_gravity(spark: SparkSession, d: str) -> DataFrame:
    """Vertical motion that keeps reversing."""
    return rounded(checks.gravity(frames(spark, d).withColumn("side", 0.3 * F.col("b")), "v", ["seq"], "side", "c", "a"))


_CORR = "covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1}) + 1e-8 / count({0}))"


@query(
    f"WITH {FS}, r AS (SELECT v, rel >= 0.40 AND a >= 0.05 AND b >= 0.025 AS ok, rel * a AS f, rel * b AS k, rel * sqrt((c - a) * (c - a) + (b - c) * (b - c)) / (sqrt(a * a + c * c) + 0.08::DOUBLE) AS gap FROM fs), "
    f"g AS (SELECT v, count(*) FILTER (ok) AS n, avg(ok::INT) AS support, {_CORR.format('(CASE WHEN ok THEN f END)', '(CASE WHEN ok THEN k END)')} AS corr, avg(gap) FILTER (ok) AS m, stddev_pop(gap) FILTER (ok) AS sd FROM r GROUP BY v), "
    f"s AS (SELECT *, CASE WHEN n >= 4 AND support >= 0.18 THEN 0.56::DOUBLE * {sig('1.0::DOUBLE - corr', 0.48, 0.18)} + 0.44::DOUBLE * {clip(f'0.60::DOUBLE * {sig('m', 0.52, 0.20)} + 0.40::DOUBLE * {sig('CASE WHEN n >= 3 THEN sd ELSE 0.0 END', 0.22, 0.09)}')} ELSE 0 END AS score FROM g) "
    "SELECT v, round(score, 6) AS score, round(support, 6) AS support, "
    + _fires("score > 0.46", "CASE WHEN score > 0.62 THEN 'MAJOR' ELSE 'MINOR' END", "1.0::DOUBLE - corr", "(1.0::DOUBLE - corr) / 0.28::DOUBLE", "least(0.52::DOUBLE + 0.32::DOUBLE * score, 0.94::DOUBLE)")
    + " FROM s"
)
def check_rigid_body(spark: SparkSession, d: str) -> DataFrame:
    """Two regions that don't move as one."""
    return rounded(checks.rigid_body(frames(spark, d), "v", "rel", ("a", "c", "b"), ("b", "a", "c")))


_SMOOTH = "CASE WHEN count(*) OVER (PARTITION BY v) < 5 THEN {0} ELSE sum({0}) OVER (PARTITION BY v ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE END"


def _spans(c: checks.Stability, score: str, off: str, series: str) -> str:
    """SQL of a check over rows ``pr`` (v, seq, ok, n and series) with their deviation."""
    return (
        f", df AS (SELECT *, CASE WHEN ok AND n >= 4 THEN {clip(off)} ELSE 0 END AS off FROM {series}), fl AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY v ORDER BY seq) <= 2 THEN 0 ELSE 1 END AS new FROM df WHERE off > {checks.FLAG}), "
        "rn AS (SELECT *, sum(new) OVER (PARTITION BY v ORDER BY seq) AS run FROM fl), sp AS (SELECT v, min(seq) AS s0, max(seq) AS s1, max(off) AS peak FROM rn GROUP BY v, run HAVING max(seq) - min(seq) + 1 >= 2), "
        f"nt AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s0) AS nth FROM sp), fs1 AS (SELECT v, max(peak) AS peak, min(s0) AS s0, max(s1) AS s1, count(*) AS k FROM nt WHERE nth <= {c.spans} GROUP BY v), "
        f"ag AS (SELECT v, max(n) AS n, avg(ok::INT) AS support, {score} AS score FROM df GROUP BY v) "
        f"SELECT ag.v, round(CASE WHEN n >= 4 THEN {clip('score')} ELSE 0 END, 6) AS score, round(support, 6) AS support, s0 AS frame_start, s1 AS frame_end, coalesce(k, 0)::BIGINT AS n_spans, "
        + _fires("peak IS NOT NULL", f"CASE WHEN peak < {checks.GRAVE_PEAK} THEN 'MINOR' ELSE 'MAJOR' END", "peak", f"peak / {c.expected}::DOUBLE", f"least({c.confidence[0]}::DOUBLE + {c.confidence[1]}::DOUBLE * peak, {c.confidence[2]}::DOUBLE)")
        + " FROM ag LEFT JOIN fs1 ON ag.v = fs1.v"
    )


def _stability_sql(kind: str, value: str) -> str:
    c = checks.STABILITY[kind]
    rows = (
        f"WITH {FS}, h AS (SELECT v, seq, rel >= {c.reliability} AS ok, CASE WHEN rel >= {c.reliability} THEN {value} ELSE 0 END AS x FROM fs), sm AS (SELECT *, {_SMOOTH.format('x')} AS s FROM h), "
        "pr AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY v ORDER BY seq)) AS j, median(CASE WHEN ok THEN s END) OVER (PARTITION BY v) AS med, count(*) FILTER (ok) OVER (PARTITION BY v) AS n FROM sm)"
    )
    off = f"{c.rise[0]}::DOUBLE * {sig('greatest(x - med, 0.0::DOUBLE)', *c.rise[1:])} + {c.away[0]}::DOUBLE * {sig('abs(x - med)', *c.away[1:])}"
    return rows + _spans(c, f"{c.jitter[0]}::DOUBLE * {sig('coalesce(quantile_cont(j, 0.88), 0.0::DOUBLE)', *c.jitter[1:])}", off, "pr")


@query(_stability_sql("LIGHT_SOURCE", "b / 4.0::DOUBLE"))
def check_light_source(spark: SparkSession, d: str) -> DataFrame:
    """Light of a region against its context, in time."""
    return rounded(checks.stability(frames(spark, d).withColumn("x", F.col("b") / 4.0), "v", ["seq"], "rel", "x", "LIGHT_SOURCE"))


@query(_stability_sql("COLOR_DRIFT", "a / 8.0::DOUBLE"))
def check_color_drift(spark: SparkSession, d: str) -> DataFrame:
    """Colour of a region against its context, in time."""
    return rounded(checks.stability(frames(spark, d).withColumn("x", F.col("a") / 8.0), "v", ["seq"], "rel", "x", "COLOR_DRIFT"))


@query(_stability_sql("EDGE_INSTABILITY", "b"))
def check_edge_stability(spark: SparkSession, d: str) -> DataFrame:
    """Energy of a seam, in time."""
    return rounded(checks.stability(frames(spark, d), "v", ["seq"], "rel", "b", "EDGE_INSTABILITY"))


@query(
    f"WITH {FS}, h AS (SELECT v, seq, rel >= 0.60 AS ok, CASE WHEN rel >= 0.60 THEN c / 4.0::DOUBLE ELSE 0 END AS a, CASE WHEN rel >= 0.60 THEN b / 6.0::DOUBLE ELSE 0 END AS b FROM fs), sm AS (SELECT *, {_SMOOTH.format('a')} AS sa, {_SMOOTH.format('b')} AS sb FROM h), "
    "pr AS (SELECT *, abs(sa - lag(sa) OVER w) AS ja, abs(sb - lag(sb) OVER w) AS jb, median(CASE WHEN ok THEN sa END) OVER (PARTITION BY v) AS ma, median(CASE WHEN ok THEN sb END) OVER (PARTITION BY v) AS mb, count(*) FILTER (ok) OVER (PARTITION BY v) AS n FROM sm WINDOW w AS (PARTITION BY v ORDER BY seq))"
    + _spans(
        checks.Stability(0.60, (0, 0, 0), (0, 0, 0), (0, 0, 0), 2, 0.28, (0.56, 0.16, 0.88)),
        f"0.62::DOUBLE * {sig('coalesce(quantile_cont(ja, 0.88), 0.0::DOUBLE)', 0.060, 0.022)} + 0.38::DOUBLE * {sig('coalesce(quantile_cont(jb, 0.88), 0.0::DOUBLE)', 0.040, 0.016)}",
        f"0.54::DOUBLE * {sig('abs(a - ma)', 0.060, 0.022)} + 0.36::DOUBLE * {sig('abs(b - mb)', 0.035, 0.015)} + 0.10::DOUBLE * {sig('abs(a)', 0.24, 0.09)}",
        "pr",
    )
)
def check_texture(spark: SparkSession, d: str) -> DataFrame:
    """Fine detail and symmetry of a region, in time."""
    rows = frames(spark, d).withColumn("x", F.col("c") / 4.0).withColumn("y", F.col("b") / 6.0)
    return rounded(checks.texture(rows, "v", ["seq"], "rel", "x", "y"))


@query(
    f"WITH {FS}, m AS (SELECT v, CASE WHEN rel >= 0.72 THEN 5 * b END AS x FROM fs), n AS (SELECT *, median(x) OVER (PARTITION BY v) AS med FROM m), "
    "g AS (SELECT v, count(x) AS n, count(x) / count(*)::DOUBLE AS support, stddev_pop(x) AS sd, avg(abs(x - med)) AS off FROM n GROUP BY v), "
    f"s AS (SELECT *, CASE WHEN n >= 4 THEN 0.72::DOUBLE * {sig('sd', 3.2, 1.1)} + 0.28::DOUBLE * {sig('off', 1.4, 0.55)} ELSE 0 END AS score FROM g) SELECT v, round(score, 6) AS score, round(support, 6) AS support, "
    + _fires("score > 0.50", "CASE WHEN score > 0.68 THEN 'MAJOR' ELSE 'MINOR' END", "sd", "sd / 1.5::DOUBLE", "least(0.50::DOUBLE + 0.28::DOUBLE * score, 0.90::DOUBLE)")
    + " FROM s"
)
def check_skin_tone(spark: SparkSession, d: str) -> DataFrame:
    """Spread of a colour distance in time."""
    return rounded(checks.skin_tone(frames(spark, d).withColumn("x", 5 * F.col("b")), "v", "rel", "x"))


@query(
    f"WITH {FS}, m AS (SELECT v, CASE WHEN rel >= 0.72 AND a >= 0.05 AND b >= 0.05 THEN a END AS f, CASE WHEN rel >= 0.72 AND a >= 0.05 AND b >= 0.05 THEN b END AS g FROM fs), "
    "n AS (SELECT *, f / (g + 0.08::DOUBLE) AS r FROM m), o AS (SELECT *, median(r) OVER (PARTITION BY v) AS med FROM n), "
    f"g AS (SELECT v, count(r) AS n, count(r) / count(*)::DOUBLE AS support, {_CORR.format('f', 'g')} AS corr, median(abs(r - med)) AS drift FROM o GROUP BY v), "
    f"s AS (SELECT *, CASE WHEN n >= 5 THEN 0.35::DOUBLE * {sig('1.0::DOUBLE - corr', 0.78, 0.18)} + 0.65::DOUBLE * {sig('drift', 0.18, 0.07)} ELSE 0 END AS score FROM g) SELECT v, round(score, 6) AS score, round(support, 6) AS support, "
    + _fires("score > 0.58 AND drift > 0.16", "CASE WHEN score > 0.70 THEN 'MAJOR' ELSE 'MINOR' END", "drift", "drift / 0.08::DOUBLE", "least(0.50::DOUBLE + 0.28::DOUBLE * score, 0.90::DOUBLE)")
    + " FROM s"
)
def check_decoupling(spark: SparkSession, d: str) -> DataFrame:
    """A region that drifts from its relation to the scene."""
    return rounded(checks.decoupling(frames(spark, d), "v", "rel", "a", "b"))


@query(
    f"WITH {FS}, m AS (SELECT v, CASE WHEN rel >= 0.50 THEN rel * b END AS seam, CASE WHEN rel >= 0.50 THEN rel * (a / 4.0::DOUBLE) END AS warp, CASE WHEN rel >= 0.52 THEN a END AS edge, "
    "CASE WHEN rel >= 0.52 THEN 9 * a END AS c0, CASE WHEN rel >= 0.52 THEN 9 * b END AS c1, CASE WHEN rel >= 0.52 THEN 9 * c END AS c2 FROM fs), "
    "g AS (SELECT v, count(*)::DOUBLE AS n, count(seam) AS ns, count(c0) AS nc, count(edge) AS ne, median(seam) AS seam, median(warp) AS warp, stddev_pop(edge) / (avg(edge) + 1e-6) AS edge, (stddev_pop(c0) + stddev_pop(c1) + stddev_pop(c2)) / 3.0::DOUBLE AS fl FROM m GROUP BY v) "
    f"SELECT v, round(CASE WHEN ns >= 3 THEN {sig('seam', 0.62, 0.14)} ELSE 0 END, 6) AS seam_score, round(CASE WHEN nc >= 4 THEN {sig('fl', 9.0, 3.0)} ELSE 0 END, 6) AS flicker_score, round(CASE WHEN ns >= 3 THEN 1.0::DOUBLE - {sig('warp', 0.20, 0.08)} ELSE 0 END, 6) AS warp_score, "
    f"round(CASE WHEN ne >= 4 THEN {sig('edge', 0.24, 0.07)} ELSE 0 END, 6) AS edge_score, round(ns / n, 6) AS seam_support, round(nc / n, 6) AS flicker_support, round(ns / n, 6) AS warp_support, round(ne / n, 6) AS edge_support FROM g"
)
def check_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The four boundary parts and their supports."""
    rows = frames(spark, d).withColumn("w", F.col("a") / 4.0)
    for k, c in enumerate("abc"):
        rows = rows.withColumn(f"x{k}", 9 * F.col(c))
    return rounded(checks.boundary(rows, "v", "rel", "b", ("x0", "x1", "x2"), "w", "a"))


def _rows_sql(sql: str, kind: str, c: checks.Stability) -> str:
    """SQL of the findings of a check, a row per span, from that of the check."""
    head = unrounded(sql)[: unrounded(sql).index(", fs1 AS")]
    peak = f"least({c.confidence[0]}::DOUBLE + {c.confidence[1]}::DOUBLE * peak, {c.confidence[2]}::DOUBLE)"
    return f"SELECT v, '{kind}' AS violation_type, s0 AS frame_start, s1 AS frame_end, CASE WHEN peak < {checks.GRAVE_PEAK} THEN 'MINOR' ELSE 'MAJOR' END AS severity, peak AS measured_value, peak / {c.expected}::DOUBLE AS violation_ratio, {peak} AS confidence FROM ({head} SELECT * FROM nt WHERE nth <= {c.spans})"


_STATIC = " UNION ALL ".join(
    _rows_sql(SQL[name], kind, c)
    for name, kind, c in (("check_color_drift", "COLOR_DRIFT", checks.STABILITY["COLOR_DRIFT"]), ("check_edge_stability", "EDGE_INSTABILITY", checks.STABILITY["EDGE_INSTABILITY"]), ("check_texture", "FACE_TEXTURE", checks.TEXTURE))
)


@query(f"SELECT v, violation_type, frame_start, frame_end, severity, round(measured_value, 6) AS measured_value, round(violation_ratio, 6) AS violation_ratio, round(confidence, 6) AS confidence FROM ({_STATIC})")
def check_findings(spark: SparkSession, d: str) -> DataFrame:
    """A row per finding of the checks of colour, edges and texture."""
    rows = _signals(spark, d)
    out = checks.stability_findings(rows, "v", ["seq"], "rel", "color", "COLOR_DRIFT").unionByName(checks.stability_findings(rows, "v", ["seq"], "rel", "b", "EDGE_INSTABILITY"))
    return rounded(out.unionByName(checks.texture_findings(rows, "v", ["seq"], "rel", "detail", "asymmetry")))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a column per signal of the detector."""
    a, b, c = (F.col(x) for x in "abc")
    columns = {
        "side": 0.3 * b, "light": b / 4.0, "color": a / 8.0, "detail": c / 4.0, "asymmetry": b / 6.0, "distance": 5 * b, "warp": a / 4.0, "x0": 9 * a, "x1": 9 * b, "x2": 9 * c,
        "sharp": 10.0 + b, "back": 8.0 + a, "kurt": 30.0 + 20.0 * a, "wave": 0.6 + b / 10.0, "block": 0.3 + a / 10.0, "high": 5.0 + a, "back_high": 5.0 + b,
    }
    return frames(spark, d).withColumns(columns)


SIGNALS = detector.Signals(
    "rel", "a", "side", "c", ("a", "c", "b"), ("b", "a", "c"), "light", "color", "b", "detail", "asymmetry", "distance", "a", "b", "b", ("x0", "x1", "x2"), "warp", "a", "sharp", "back", "kurt", "wave", "block", "high", "back_high"
)


def _detection(spark: SparkSession, d: str) -> detector.Detection:
    """The detector over timelines as frames; what is said of their motion is level 1."""
    motion = timeline_queries.motion_levels(spark, d)
    return detector.detect(materialize(_signals(spark, d), "frames"), motion, "v", ["seq"], SIGNALS)


_CV = "stddev_pop({0}) / (avg({0}) + 1e-6)"
_LEVELS = (
    ", ".join(f"{name} AS ({unrounded(SQL[q])})" for name, q in (("ml", "l1_score"), ("gr", "check_gravity"), ("rb", "check_rigid_body"), ("li", "check_light_source"), ("sk", "check_skin_tone"), ("de", "check_decoupling"), ("co", "check_color_drift"), ("ed", "check_edge_stability"), ("te", "check_texture"), ("bo", "check_boundary")))
    + f", {FS}, q0 AS (SELECT v, seq, rel, 10.0::DOUBLE + b AS sharp, 8.0::DOUBLE + a AS back, 30.0::DOUBLE + 20.0::DOUBLE * a AS kurt, 0.6::DOUBLE + b / 10.0::DOUBLE AS wave, 0.3::DOUBLE + a / 10.0::DOUBLE AS block, 5.0::DOUBLE + a AS high, 5.0::DOUBLE + b AS bhigh FROM fs), "
    "q1 AS (SELECT q0.*, avg(sharp) OVER w AS ms, avg(seq::DOUBLE) OVER w AS mq, coalesce(covar_pop(seq::DOUBLE, sharp) OVER w / nullif(var_pop(seq::DOUBLE) OVER w, 0), 0) AS slope FROM q0 WINDOW w AS (PARTITION BY v)), "
    f"fq AS (SELECT v, avg(rel) AS reliability, avg((rel >= 0.60)::INT) AS detected, avg((rel >= 0.50)::INT) AS frequency_support, {_CV.format('kurt')} AS lap_kurtosis_cv, avg(kurt) AS lap_kurtosis_mean, avg(wave) AS wavelet_detail_ratio, {_CV.format('wave')} AS wavelet_detail_ratio_cv, "
    f"{_CV.format('sharp')} AS lap_var_temporal_cv, avg(sharp) / (avg(back) + 1e-6) AS lap_var_ratio, avg(block) AS block_lap_consistency, avg(high) / (avg(bhigh) + 1e-6) AS dct_hf_ratio, CASE WHEN count(*) >= 6 THEN stddev_pop(sharp - (ms + slope * (seq - mq))) / (avg(sharp) + 1e-6) ELSE 0 END AS lap_trend_residual_std FROM q1 GROUP BY v), "
    "lv AS (SELECT fq.*, coalesce(ml.l1, 0) AS l1, coalesce(has_motion, false) AS has_motion, gr.severity AS gs, rb.severity AS rs, rb.support AS neck, li.severity AS ls, sk.severity AS ss, de.severity AS ds, gr.score AS g0, rb.score AS r0, li.score AS l0, sk.score AS s0, de.score AS d0, de.support AS scene, li.support AS lsup, sk.support AS ssup, "
    "co.score AS c0, ed.score AS e0, te.score AS t0, seam_score AS seam, flicker_score AS color, warp_score AS warp, edge_score AS edge, (seam_support + flicker_support + warp_support + edge_support) / 4.0::DOUBLE AS bsup "
    "FROM fq LEFT JOIN ml USING (v) JOIN gr USING (v) JOIN rb USING (v) JOIN li USING (v) JOIN sk USING (v) JOIN de USING (v) JOIN co USING (v) JOIN ed USING (v) JOIN te USING (v) JOIN bo USING (v)), "
    f"p2 AS (SELECT *, {sig('greatest(r0, d0)', 0.52, 0.12)} * least(1.0, lsup / 0.40) AS lg, {sig('greatest(r0, d0)', 0.50, 0.14)} * least(1.0, ssup / 0.40) AS sg FROM lv), "
    f"p3 AS (SELECT *, {clip('0.05 * g0 + 0.52 * r0 * (CASE WHEN neck > 0 THEN least(1.0, neck / 0.35) ELSE 0 END) + 0.06 * l0 * lg + 0.12 * s0 * sg + 0.25 * d0 * (CASE WHEN scene > 0 THEN least(1.0, scene / 0.35) ELSE 0 END)')} AS l2, "
    f"{clip('0.12 * c0 + 0.18 * e0 + 0.70 * t0')} * (CASE WHEN reliability < 0.75 THEN greatest(0.35, reliability / 0.75) ELSE 1.0 END) AS l3, (seam >= 0.20)::INT + (color >= 0.15)::INT + (warp >= 0.40)::INT + (edge >= 0.15)::INT AS n, greatest(seam, color, edge) AS o FROM p2), "
    "p4 AS (SELECT *, 0.46 * warp * (0.40 + 0.60 * o) + 0.20 * color + 0.18 * edge + 0.16 * seam AS z FROM p3), "
    "p5 AS (SELECT *, (CASE WHEN n >= 3 THEN z + 0.04 * least(warp, o) WHEN n = 2 THEN z + 0.03 * least(warp, o) ELSE z * 0.88 END) + (CASE WHEN warp > 0.44 AND color < 0.10 AND edge < 0.10 AND seam < 0.18 THEN -0.06 ELSE 0 END) + (CASE WHEN seam > 0.55 AND warp < 0.28 AND color < 0.14 AND edge < 0.14 THEN -0.07 ELSE 0 END) "
    "+ (CASE WHEN warp > 0.50 AND seam > 0.20 THEN 0.03 ELSE 0 END) + (CASE WHEN edge > 0.22 AND color > 0.15 AND (warp > 0.34 OR seam > 0.24) THEN 0.03 ELSE 0 END) + (CASE WHEN warp > 0.58 AND o > 0.18 THEN 0.02 ELSE 0 END) AS y FROM p4), "
    f"p6 AS (SELECT *, {clip(clip('y') + ' * (CASE WHEN bsup > 0 THEN least(1.0, bsup / 0.35) ELSE 0 END)')} * (CASE WHEN bsup < 0.22 THEN 0.45 + 0.55 * least(1.0, bsup / 0.22) ELSE 1.0 END) AS l4, "
    + " + ".join(f"(CASE WHEN {n} > 0 THEN {w}::DOUBLE * {sig(n, m, s)} ELSE 0 END)" for n, (w, m, s) in scoring.FREQUENCY.items())
    + " AS f0, " + " + ".join(f"(CASE WHEN {n} > 0 THEN {w}::DOUBLE ELSE 0 END)" for n, (w, _, _) in scoring.FREQUENCY.items()) + " AS f1 FROM p5), "
    f"p7 AS (SELECT *, CASE WHEN f1 > 0 THEN {clip('f0 / greatest(f1, 1e-6)')} * least(1.0, frequency_support / 0.40) ELSE 0 END AS l5, {clip('greatest(least(warp, greatest(color, edge)), least(seam, greatest(color, edge)), 0.75 * least(warp, seam))')} AS cor FROM p6), "
    f"p8 AS (SELECT *, {clip('0.72 * l5 + 0.10 * l4 + 0.10 * (l5 * ' + clip('warp') + ') + 0.05 * l1 + 0.03 * cor + (CASE WHEN l5 > 0.55 AND warp > 0.35 THEN 0.03 ELSE 0 END) + (CASE WHEN lap_var_ratio > 1.45 AND lap_var_temporal_cv > 0.165 THEN 0.02 ELSE 0 END) - (CASE WHEN frequency_support < 0.35 THEN 0.05 ELSE 0 END) - (CASE WHEN reliability < 0.25 THEN 0.03 ELSE 0 END)')} AS score FROM p7), "
    f"st AS ({_STATIC}), fd AS (SELECT v, 'FACE_MOTION' AS k, 'MAJOR' AS severity FROM p8 WHERE has_motion UNION ALL SELECT v, 'GRAVITY', gs FROM p8 WHERE gs IS NOT NULL UNION ALL SELECT v, 'RIGID_BODY', rs FROM p8 WHERE rs IS NOT NULL UNION ALL SELECT v, 'LIGHT_SOURCE', ls FROM p8 WHERE ls IS NOT NULL AND lg >= 0.45 "
    "UNION ALL SELECT v, 'SKIN_TONE_MISMATCH', ss FROM p8 WHERE ss IS NOT NULL AND sg >= 0.45 UNION ALL SELECT v, 'FACE_SCENE_DECOUPLING', ds FROM p8 WHERE ds IS NOT NULL "
    "UNION ALL SELECT st.v, violation_type, CASE WHEN has_motion OR rs IS NOT NULL THEN st.severity ELSE 'MINOR' END FROM st JOIN p8 ON st.v = p8.v WHERE has_motion OR rs IS NOT NULL OR (violation_type = 'FACE_TEXTURE' AND st.confidence >= 0.82 AND reliability >= 0.80) "
    + " ".join(f"UNION ALL SELECT v, '{kind}', CASE WHEN {x} > {major} THEN 'MAJOR' ELSE 'MINOR' END FROM p8 WHERE {x} > {limit}" + (" AND n >= 2" if needs else "") for kind, x, limit, needs, major, *_ in scoring.BOUNDARY_RULES)
    + "), tp AS (SELECT v, list_sort(list(DISTINCT k)) AS t, count(*) AS n_findings, count(*) FILTER (severity = 'MAJOR') AS n_major, count(*) FILTER (severity = 'MINOR') AS n_minor FROM fd GROUP BY v), "
    "p9 AS (SELECT p8.* EXCLUDE (n), coalesce(t, []) AS t, coalesce(n_findings, 0) AS n_findings, coalesce(n_major, 0) AS n_major, coalesce(n_minor, 0) AS n_minor FROM p8 LEFT JOIN tp ON p8.v = tp.v), "
    "pa AS (SELECT *, CASE WHEN detected < 0.22 AND reliability < 0.45 THEN 'weak_face_support' WHEN reliability < 0.35 THEN 'unreliable_face_roi' WHEN neck < 0.14 AND bsup < 0.14 THEN 'insufficient_face_context' "
    f"WHEN NOT list_has_any(t, {list(scoring.DYNAMIC_TYPES)}) AND NOT list_has_any(t, {list(scoring.ARTIFACT_TYPES)}) AND greatest(l1, l2, l4) < 0.18 THEN 'unsupported_open_world_content' ELSE '' END AS reason FROM p9)"
)


@query(
    f"WITH {_LEVELS} SELECT v, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("l1", "l2", "l3", "l4", "l5", "reliability", "detected")) + ", round(bsup, 6) AS boundary_support, array_to_string(t, ',') AS types, n_findings, n_major, n_minor, round(score, 6) AS score, reason, "
    "CASE WHEN reason <> '' THEN 'INCONCLUSIVE' WHEN score >= 0.42 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END AS verdict, CASE WHEN abs(score - 0.42) > 0.20 THEN 'HIGH' WHEN abs(score - 0.42) > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM pa"
)
def detector_verdict(spark: SparkSession, d: str) -> DataFrame:
    """From frames through all checks, levels and findings to a verdict."""
    out = rounded(_detection(spark, d).verdicts)
    return out.withColumn("types", F.concat_ws(",", "types")).drop("note")
