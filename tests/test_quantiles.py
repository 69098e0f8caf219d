"""Grouped exact quantiles against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import quantiles

WANTED = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.88, "e": 1.0}


@pytest.mark.parametrize("limit", [None, 70])
def test_against_numpy(spark, limit):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.random(1000), "odd": rng.normal(0, 1e6, 501), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "ties": np.where(rng.random(900) < 0.6, 0.25, rng.random(900)),
        "near": 0.5 + rng.random(800) * 1e-12, "whole": rng.integers(-3, 4, 700).astype(float), None: rng.random(300), "same": np.full(400, 7.0),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None)] * 50 + [("nothing", None)] * 3
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], "x", WANTED, limit).collect()}
    assert set(got) == {*groups, "nothing"} and all(got["nothing"][n] is None for n in WANTED)
    for g, values in groups.items():
        for name, q in WANTED.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-15, abs=1e-15)


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, math.nan, 2.0, 3.0, math.nan)], "g string, x double")
    r = quantiles.grouped_quantiles(df, ["g"], "x", {"m": 0.5, "top": 1.0}).first()
    assert r["m"] == 3.0 and math.isnan(r["top"])


def test_rows_with_their_median(spark):
    df = spark.range(101).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    got = quantiles.with_quantile(df, "g", "x", "m").groupBy("g").agg(F.max("m"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {(0, 50.0, 51), (1, 50.0, 50)}


def test_no_task_holds_a_group(spark):
    """Windows stand over ranges; aggregates keep sums and single values."""
    df = spark.range(0, 30_000, 1, 4).select(F.lit("g").alias("g"), (F.col("id") * 0.1).alias("x"))
    plan = quantiles.grouped_quantiles(df, ["g"], "x", {"m": 0.5}, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan and "collect" not in plan
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert windows and all("__range" in line for line in windows)
