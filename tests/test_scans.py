"""Scans with carried state against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import evidence, scans

FIELDS = "v string, frame_start long, frame_end long, violation_type string, severity string, confidence double, violation_ratio double"
TYPES = ["FACE_MOTION", "FACE_TEXTURE", "RIGID_BODY", "COLOR_DRIFT"]


def loop(xs, keep=0.8):
    out, s = [], None
    for x in xs:
        if x is not None:
            s = x if s is None else keep * s + (1 - keep) * x
        out.append(s)
    return out


@pytest.mark.parametrize("limit", [None, 40])
def test_smoothing(spark, limit):
    rng = random.Random(1)
    series = {v: [None if rng.random() < 0.1 else rng.random() for _ in range(n)] for v, n in (("a", 1), ("b", 700), ("c", 39), (None, 90), ("d", 250))}
    series["e"] = [None] * 120 + [0.5, 0.25]
    rows = [(v, k, x, "kept") for v, xs in series.items() for k, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "v string, i long, x double, smoothed_not string").repartition(5)
    got = {(r["v"], r["i"]): r["smoothed"] for r in scans.smoothed(df, "v", ["i"], "x", limit=limit).collect()}
    assert len(got) == len(rows)
    for v, xs in series.items():
        for k, want in enumerate(loop(xs)):
            assert got[v, k] == want if want is None else abs(got[v, k] - want) < 1e-12


def test_state_goes_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).select(F.lit("v").alias("v"), F.col("id").alias("i"), (F.col("id") % 13).cast("double").alias("x"))
        got = [r["smoothed"] for r in scans.smoothed(df, "v", ["i"], "x").orderBy("i").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(loop([float(k % 13) for k in range(500)]))


def test_boxes_round_halves_to_even_at_each_step(spark):
    rng = random.Random(2)
    rows = [(v, k, rng.randint(-5, 70), rng.randint(-5, 50), rng.randint(0, 90), rng.randint(0, 70), rng.random()) for v in range(6) for k in range(60)]
    df = spark.createDataFrame(rows, "v int, i int, x1 int, y1 int, x2 int, y2 int, reliability double").repartition(3)
    got = {(r["v"], r["i"]): r for r in scans.smoothed_boxes(df, "v", ["i"], 64, 48).collect()}
    for v in range(6):
        own = [r[2:] for r in rows if r[0] == v]
        box, rel = own[0][:4], own[0][4]
        for k, b in enumerate(own):
            if k:
                x1, y1, x2, y2 = (int(round(0.80 * a + 0.20 * n)) for a, n in zip(box, b, strict=False))
                x1, y1 = max(0, min(x1, 63)), max(0, min(y1, 47))
                box = (x1, y1, max(x1 + 1, min(x2, 64)), max(y1 + 1, min(y2, 48)))
                rel = 0.82 * rel + 0.18 * b[4]
            r = got[v, k]
            assert (r["s_x1"], r["s_y1"], r["s_x2"], r["s_y2"]) == box and abs(r["s_reliability"] - rel) < 1e-12


def made(rng, v, n, length):
    out = []
    for _ in range(n):
        a = rng.randint(0, 900)
        out.append((v, a, a + rng.randint(-2, length), rng.choice(TYPES), rng.choice(["MAJOR", "MINOR", "CRITICAL"]), rng.choice([None, 0.1, 0.5, rng.random()]), 1.0))
    return out


@pytest.mark.parametrize("limit", [None, 50])
def test_coverage_against_all_pairs(spark, limit):
    rng = random.Random(3)
    spans = made(rng, "a", 60, 30) + made(rng, "b", 30, 800) + made(rng, None, 5, 50) + made(rng, "none", 4, 20)
    frames = [(v, None if k % 97 == 5 else k, k * 0.5) for v in ("a", "b", "c", None) for k in range(0, 900, 3)]
    left, right = spark.createDataFrame(frames, "v string, seq long, x double").repartition(4), spark.createDataFrame(spans, FIELDS)
    got = evidence.with_coverage(left, right, "v", "seq", limit).collect()
    assert len(got) == len(frames)
    for r in got:
        open_ = [s for s in spans if s[0] is not None and s[0] == r["v"] and r["seq"] is not None and s[1] <= r["seq"] <= s[2]]
        assert r["in_any"] == bool(open_) and r["in_major"] == any(s[4] == "MAJOR" for s in open_) and r["in_critical"] == any(s[4] == "CRITICAL" for s in open_)
        assert r["in_dynamic"] == any(s[3] in evidence.DYNAMIC for s in open_) and r["in_boundary"] == any(s[3] in evidence.BOUNDARY for s in open_)
        assert r["covering_confidence"] == max((s[5] for s in open_ if s[5] is not None), default=0.0)


def test_one_entity_with_many_rows_and_intervals(spark):
    """100,000 rows and 10,000 intervals of one entity, in ranges of places."""
    frames = spark.range(0, 100_000, 1, 8).select(F.lit("v").alias("v"), F.col("id").alias("seq"))
    k = F.col("id")
    spans = spark.range(10_000).select(
        F.lit("v").alias("v"), (k * 10).alias("frame_start"), (k * 10 + k % 7 + F.when(k % 1000 == 0, 4000).otherwise(0)).alias("frame_end"), F.lit("RIGID_BODY").alias("violation_type"),
        F.when(k % 5 == 0, "MAJOR").otherwise("MINOR").alias("severity"), (F.lit(1.0) / (k + 1)).alias("confidence"), F.lit(1.0).alias("violation_ratio"),
    )
    got = evidence.with_coverage(frames, spans, "v", "seq", 10_000).agg(*[F.count_if(F.col(c)).alias(c) for c in ("in_any", "in_major")], F.sum("covering_confidence").alias("s"), F.count("*").alias("n")).first()
    any_, major, most = bytearray(100_000), bytearray(100_000), [0.0] * 100_000
    for i in range(10_000):
        for p in range(i * 10, min(100_000, i * 10 + i % 7 + (4000 if i % 1000 == 0 else 0) + 1)):
            any_[p] = 1
            major[p] |= i % 5 == 0
            most[p] = max(most[p], 1.0 / (i + 1))
    assert (got["n"], got["in_any"], got["in_major"]) == (100_000, sum(any_), sum(major)) and abs(got["s"] - sum(most)) < 1e-6


def test_no_arrays_of_intervals_in_the_plan(spark):
    frames = spark.createDataFrame([("v", 1, 0.1, ["a"])], "v string, seq long, s double, flags array<string>")
    spans = spark.createDataFrame([("v", 1, 1, "RIGID_BODY", "MAJOR", 0.5, 1.0)], FIELDS)
    plan = evidence.with_coverage(frames, spans, "v", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and evidence.forensic_features(frames, spans, "v", "seq", "s", "flags").first()["has_rigid_body"] == 1.0


def test_empty_tables(spark):
    frames, spans = spark.createDataFrame([], "v string, seq long"), spark.createDataFrame([], FIELDS)
    assert evidence.with_coverage(frames, spans, "v", "seq").count() == 0
    assert scans.smoothed(spark.createDataFrame([], "v string, i long, x double"), "v", ["i"], "x").count() == 0
