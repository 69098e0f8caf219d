import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import evidence, scoring, series, spans


def rows(spark, xs, entity=1):
    return spark.createDataFrame([(entity, k, float(x)) for k, x in enumerate(xs)], "v int, i int, x double")


def test_smoothing_counts_zeros_beyond_the_ends(spark):
    got = [r[0] for r in rows(spark, [1] * 6).select(series.smooth(F.col("x"), "v", ["i"], 5)).collect()]
    assert got == pytest.approx([0.6, 0.8, 1, 1, 0.8, 0.6])
    assert [r[0] for r in rows(spark, [1, 2]).select(series.smooth(F.col("x"), "v", ["i"], 5)).collect()] == [1, 2]


def test_quantiles_and_moments(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    r = rows(spark, xs).agg(series.quantile(F.col("x"), 0.88), F.median("x"), F.stddev_pop("x"), F.kurtosis("x")).first()
    assert list(r) == pytest.approx([6.48, 3.5, 2.5708704751503917, -0.534949616887])


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(series.guarded_correlation(F.col("a"), F.col("b"))).first()[0] == 0


def test_trend_residual_against_numpy(spark):
    rng = np.random.default_rng(1)
    xs = rng.random(20)
    fit = np.polyval(np.polyfit(np.arange(20), xs, 1), np.arange(20))
    got = series.trend_residual(rows(spark, xs), "v", ["i"], "x").first()["trend_residual"]
    assert got == pytest.approx(np.std(xs - fit) / (xs.mean() + 1e-6))
    assert series.trend_residual(rows(spark, [1, 2]), "v", ["i"], "x").first()["trend_residual"] == 0


def test_exponential_smoothing(spark):
    got = series.exponential_smoothing(rows(spark, [1, 2, 3]), "v", ["i"], "x").first()["smoothed"]
    assert got == pytest.approx([1, 1.2, 1.56])


def spans_by_loop(flags, least, gap):
    on = [i for i, f in enumerate(flags) if f]
    out = []
    for i in on:
        if out and i - out[-1][1] <= gap + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return sorted((a, b) for a, b in out if b - a + 1 >= least)


def test_spans_against_a_loop(spark):
    rng = random.Random(3)
    cases = {k: [rng.random() < 0.4 for _ in range(rng.randint(1, 25))] for k in range(60)}
    cases[99] = [c == "T" for c in "TTFTFFTTFFFT"]
    df = spark.createDataFrame([(k, i, f) for k, fs in cases.items() for i, f in enumerate(fs)], "v int, i int, f boolean")
    for least, gap in ((1, 0), (2, 1), (3, 2)):
        got = {}
        for r in spans.sustained_spans(df, "v", "i", F.col("f"), least, gap).collect():
            got.setdefault(r["v"], []).append((r["start"], r["end"]))
        for k, fs in cases.items():
            assert sorted(got.get(k, [])) == spans_by_loop(fs, least, gap)
    assert sorted((r["start"], r["end"]) for r in spans.sustained_spans(df.where("v = 99"), "v", "i", F.col("f")).collect()) == [(0, 3), (6, 7)]


def test_merged_intervals_against_a_loop(spark):
    rng = random.Random(5)
    data = []
    for v in range(40):
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 40)
            data.append((v, rng.choice("AB"), a, a + rng.randint(0, 9), rng.choice(["MINOR", "MAJOR"]), round(rng.random(), 3), 0.5, rng.random(), rng.random()))
    df = spark.createDataFrame(data, "v int, violation_type string, frame_start int, frame_end int, severity string, measured_value double, expected_value double, violation_ratio double, confidence double")
    got = sorted((r["v"], r["violation_type"], r["frame_start"], r["frame_end"], r["severity"], r["confidence"]) for r in spans.merged_intervals(df, "v").collect())
    want = []
    for v, kind in sorted({d[:2] for d in data}):
        run = None
        for d in sorted((d for d in data if d[:2] == (v, kind)), key=lambda d: (d[2], d[3], d[5])):
            if run and d[2] - run[3] <= 3:
                run = [v, kind, run[2], max(run[3], d[3]), min(run[4], d[4]), max(run[5], d[8])]
                want[-1] = tuple(run)
            else:
                run = [v, kind, d[2], d[3], d[4], d[8]]
                want.append(tuple(run))
    assert got == sorted(want)


def test_coverage(spark):
    frames = rows(spark, [0] * 10)
    found = spark.createDataFrame([(1, 2, 4, "FACE_MOTION", "MAJOR", 0.5, 1.0), (1, 4, 5, "GRAVITY", "MINOR", 0.9, 1.0)], "v int, frame_start long, frame_end long, violation_type string, severity string, confidence double, violation_ratio double")
    df = evidence.with_intervals(frames, found, "v")
    at, s = F.col("i"), F.col("spans")
    r = df.agg(evidence.share(evidence.covered(at, s)), evidence.share(evidence.covered(at, s, evidence.DYNAMIC)), F.avg(evidence.covering_confidence(at, s))).first()
    assert list(r) == pytest.approx([0.4, 0.3, 0.28])


def test_merge_evidence_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, 0.2, ["x"]), (2, 0.9, [])], "k int, score double, flags array<string>")
    b = spark.createDataFrame([(2, 0.4, ["b", "a"]), (3, 0.1, ["a"])], "k int, score double, flags array<string>")
    got = {r["k"]: (r["score"], r["flags"]) for r in evidence.merge_evidence(a, b, ["k"]).collect()}
    assert got == {1: (0.2, ["x"]), 2: (0.9, ["a", "b"]), 3: (0.1, ["a"])}


def test_abstention_and_verdict(spark):
    lit = F.lit
    r = spark.range(1).select(
        scoring.abstention(lit(0.1), lit(0.4), lit(1.0), lit(1.0), lit(1.0), lit(1.0), lit(1.0), lit(True), lit(True)),
        scoring.abstention(lit(0.9), lit(0.3), lit(1.0), lit(1.0), lit(1.0), lit(1.0), lit(1.0), lit(True), lit(True)),
        scoring.abstention(lit(0.9), lit(0.9), lit(0.1), lit(0.1), lit(1.0), lit(1.0), lit(1.0), lit(True), lit(True)),
        scoring.abstention(lit(0.9), lit(0.9), lit(0.9), lit(0.9), lit(0.1), lit(0.1), lit(0.1), lit(False), lit(False)),
        scoring.verdict(lit(0.42), 0.42, lit("")),
        scoring.verdict(lit(0.41), 0.42, lit("")),
        scoring.verdict(lit(0.9), 0.42, lit("x")),
    ).first()
    assert list(r) == ["weak_face_support", "unreliable_face_roi", "insufficient_face_context", "unsupported_open_world_content", "AI_GENERATED", "AUTHENTIC", "INCONCLUSIVE"]
