import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import checks, regions


def logistic(x, c, s):
    return 1 / (1 + np.exp(-np.clip((x - c) / s, -12, 12)))


def smoothed(x):
    return np.convolve(x, np.ones(5) / 5, "same") if len(x) >= 5 else np.asarray(x)


@pytest.mark.parametrize("kind", sorted(checks.STABILITY))
def test_stability_of_one_series(spark, kind):
    rng = np.random.default_rng(3)
    c = checks.STABILITY[kind]
    x, rel = rng.random(30) * 0.2, np.where(np.arange(30) % 7 == 3, 0.1, 0.9)
    x[12:15] += 1.0
    df = spark.createDataFrame([("v", k, float(r), float(a)) for k, (r, a) in enumerate(zip(rel, x))] + [("w", 0, 0.9, 1.0)], "v string, seq long, rel double, x double")
    got = {r["v"]: r for r in checks.stability(df, "v", ["seq"], "rel", "x", kind).collect()}
    ok = rel >= c.reliability
    held = np.where(ok, x, 0.0)
    s = smoothed(held)
    score = c.jitter[0] * logistic(np.percentile(np.abs(np.diff(s)), 88), *c.jitter[1:])
    gap = held - np.median(s[ok])
    off = np.where(ok, np.clip(c.rise[0] * logistic(np.maximum(gap, 0), *c.rise[1:]) + c.away[0] * logistic(np.abs(gap), *c.away[1:]), 0, 1), 0.0)
    assert got["v"]["score"] == pytest.approx(score) and got["v"]["support"] == pytest.approx(ok.mean())
    assert off[12:15].min() > checks.FLAG and got["v"]["n_spans"] >= 1 and got["v"]["measured_value"] == pytest.approx(off[12:15].max(), abs=0.02)
    assert got["w"]["score"] == 0 and got["w"]["severity"] is None


def test_gravity_of_alternating_motion(spark):
    rows = [("v", k, 0.1, 0.5 if k // 4 % 2 else -0.5, 1.0) for k in range(24)] + [("w", k, 0.5, 0.5, 1.0) for k in range(24)] + [("x", 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "v string, seq long, vx double, vy double, act double")
    got = {r["v"]: r for r in checks.gravity(df, "v", ["seq"], "vx", "vy", "act").collect()}
    assert got["v"]["severity"] == "MAJOR" and got["v"]["measured_value"] == 5 and got["v"]["frame_end"] == 24
    assert got["w"]["severity"] is None and got["x"]["score"] == 0


def test_rigid_motion_and_decoupling(spark):
    rng = np.random.default_rng(5)
    a = rng.random(20) + 0.2
    rows = [("same", k, 0.9, float(x), float(x) * 0.8) for k, x in enumerate(a)] + [("apart", k, 0.9, float(x), float(y)) for k, (x, y) in enumerate(zip(a, rng.permutation(a)))]
    df = spark.createDataFrame(rows, "v string, seq long, rel double, a double, b double")
    both = {r["v"]: r for r in checks.rigid_body(df, "v", "rel", ("a", "a", "a"), ("b", "b", "b")).collect()}
    assert both["same"]["score"] < both["apart"]["score"] and both["apart"]["severity"] is not None
    drift = {r["v"]: r["score"] for r in checks.decoupling(df, "v", "rel", "a", "b").collect()}
    assert drift["same"] < drift["apart"]


def test_warp_along_a_whole_pixel(spark):
    """A picture moved by one column is predicted without error."""
    p = np.arange(64, dtype=float).reshape(8, 8) ** 1.5
    q = np.roll(p, -1, axis=1)
    df = spark.createDataFrame([(1, 0.8, p.ravel().tolist(), q.ravel().tolist(), [1.0] * 64, [0.0] * 64)], "v long, rel double, p array<double>, q array<double>, u array<double>, w array<double>")
    inner = regions.places(8, (2, 2, 6, 6))
    assert regions.warp_error(df, ["v"], "rel", "p", "q", "u", "w", inner).first()["warp_error"] == pytest.approx(0, abs=1e-9)
    still = regions.warp_error(df.withColumn("u", F.col("w")), ["v"], "rel", "p", "q", "u", "w", inner).first()["warp_error"]
    a, b = p[2:6, 2:6], q[2:6, 2:6]
    assert still == pytest.approx(0.8 * np.abs(a - b).mean() / (b.std() + 0.5))


def test_median_box_and_its_gates(spark):
    rows = [("a", 6, 0, 0, 50, 60), ("a", 6, 2, 1, 52, 61), ("a", 6, 1, 2, 51, 62), ("a", 6, 3, 3, 53, 63)] + [("a", 6, None, None, None, None)] * 2
    rows += [("few", 4, 0, 0, 90, 90)] * 3 + [("small", 4, 0, 0, 30, 90)] * 4
    df = spark.createDataFrame(rows, "v string, total long, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in regions.median_box(df, "v", "total").collect()] == [("a", 4, 1, 1, 51, 61)]
