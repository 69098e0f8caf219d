import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from cadenza.functions import boxes, scalars


def values(spark, column, xs, kind="double"):
    df = spark.createDataFrame([(x,) for x in xs], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_logistic_and_clip(spark):
    xs = [-1e9, -0.5, 0.0, 0.3, 1.0, 1e9]
    got = values(spark, lambda x: scalars.logistic(x, 0.3, 0.1), xs)
    want = [1 / (1 + math.exp(-min(max((x - 0.3) / 0.1, -12), 12))) for x in xs]
    assert got == pytest.approx(want, abs=1e-15)
    assert values(spark, scalars.clip01, xs) == [0.0, 0.0, 0.0, 0.3, 1.0, 1.0]


def test_safe_numbers(spark):
    xs = ["1.5", " 2 ", "", None, "abc", "nan", "1d", "-3e2", ".5", "7."]
    assert values(spark, scalars.safe_double, xs, "string") == [1.5, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -300.0, 0.5, 7.0]
    assert values(spark, scalars.safe_int, ["2.9", "-2.9", "x"], "string") == [2, -2, 0]


def test_confidence_levels(spark):
    xs = [0.42, 0.53, 0.63, 0.1]
    assert values(spark, lambda x: scalars.confidence_level(x, 0.42), xs) == ["LOW", "MEDIUM", "HIGH", "HIGH"]


def test_names(spark):
    df = spark.createDataFrame([("033_097.mp4", "faceswap_0001.mp4"), ("992.mp4", "authentic_12.mp4"), (None, "x.mp4")], "original string, name string")
    got = df.select(scalars.manifest_tokens(F.col("original"), F.col("name")), scalars.pair_id(F.col("name"))).collect()
    assert [list(r) for r in got] == [[["033", "097"], "0001"], [["992"], "12"], [["x"], "x"]]
    paths = spark.createDataFrame([("a/deepfake_3.mp4", 1), ("set/ai/ai_3.mp4", 1), ("x/celeb/ai.mp4", 1), ("authentic.mp4", 0)], "p string, y int")
    assert [r[0] for r in paths.select(scalars.category(F.col("p"), F.col("y"))).collect()] == ["deepfake", "ai", "celeb", "authentic"]


def test_weights(spark):
    df = spark.createDataFrame([([2.0, 6.0],), ([0.0, 0.0],)], "w array<double>")
    assert [r[0] for r in df.select(scalars.normalized_weights(F.col("w"))).collect()] == [[0.25, 0.75], [0.5, 0.5]]


def test_boxes(spark):
    df = spark.createDataFrame([Row(x1=2, y1=2, x2=6, y2=6)])
    b = boxes.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    lit = lambda *xs: boxes.box(*map(F.lit, xs))
    row = df.select(boxes.expand_box(b, 1.5, F.lit(8), F.lit(8)).alias("e"), boxes.iou(b, lit(4, 4, 8, 8)).alias("i"), boxes.iou(b, lit(6, 6, 8, 8)).alias("n"), boxes.clip_box(lit(-5, 20, 3, 4), F.lit(8), F.lit(8)).alias("c")).first()
    assert tuple(row["e"]) == (1, 1, 7, 7)
    assert row["i"] == pytest.approx(4 / 28) and row["n"] == 0
    assert tuple(row["c"]) == (0, 7, 3, 8)


def test_score_bar(spark):
    assert values(spark, lambda x: scalars.score_bar(x, 4), [0.7, 0.5, 0.0]) == ["[##..] HIGH", "[##..] MED", "[....] LOW"]
    assert np.isclose(values(spark, lambda x: scalars.finite_or(x), [float("nan")])[0], 0)
