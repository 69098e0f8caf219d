"""Equal-depth ranges on values that lie together, far apart and on hot ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ranges, splits

N, LIMIT = 40_000, 500


def values(kind, rng):
    if kind == "within a millionth":
        return 0.3 + rng.random(N) * 1e-6
    if kind == "saturated":
        return np.where(rng.random(N) < 0.5, 1.0 - rng.random(N) * 1e-12, rng.random(N) * 1e-12)
    if kind == "billions":
        return (rng.random(N) - 0.5) * 2e9
    if kind == "powers":
        return np.exp(rng.normal(0, 60, N)) * rng.choice([-1, 1], N)
    ties = rng.random(N)
    ties[: N // 3] = 0.5
    ties[N // 3 : N // 2] = 0.0
    return ties


@pytest.mark.parametrize("kind", ["within a millionth", "saturated", "billions", "powers", "hot ties"])
@pytest.mark.parametrize("falling", [False, True])
def test_running_sums_and_the_largest_window(spark, kind, falling):
    x = values(kind, np.random.default_rng(1))
    group = np.where(np.arange(N) % 4 == 0, "b", "a")
    rows = spark.createDataFrame(list(zip(group.tolist(), x.tolist(), strict=True)), "g string, x double").repartition(8).groupBy("g", "x").agg(F.count("*").alias("n"))
    found, many = ranges.ranged(rows, [F.col("x")], ["g"], LIMIT)
    assert many
    depth = [r["count"] for r in found.groupBy("g", "__range").count().collect()]
    assert max(depth) <= LIMIT and len(depth) < 12 * N / LIMIT
    got = {(r["g"], r["x"]): r["before_n"] for r in ranges.sums_before(rows, "x", ["n"], ["g"], falling=falling, limit=LIMIT).collect()}
    for g in "ab":
        own, counts = np.unique(x[group == g], return_counts=True)
        before = np.cumsum(counts) - counts if not falling else counts.sum() - np.cumsum(counts)
        assert [got[g, v] for v in own.tolist()] == before.tolist()


@pytest.mark.parametrize("kind", ["within a millionth", "billions", "powers"])
def test_neighbours(spark, kind):
    x = np.unique(values(kind, np.random.default_rng(2)))
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "x double").repartition(5)
    got = {r["x"]: (r["before"], r["after"]) for r in ranges.neighbours(rows, "x", LIMIT).collect()}
    line = [None, *x.tolist(), None]
    assert [got[v] for v in line[1:-1]] == list(zip(line[:-2], line[2:], strict=True))


def test_nulls_and_nan_keep_their_places(spark):
    line = [None, float("-inf"), *range(2000), float("inf"), float("nan")]
    rows = spark.createDataFrame([(v if v is None else float(v), 1) for v in line], "x double, n int").repartition(3)
    got = ranges.sums_before(rows, "x", ["n"], limit=50).collect()
    place = {("nan" if r["x"] is not None and r["x"] != r["x"] else r["x"]): r["before_n"] for r in got}
    assert [place["nan" if v is not None and v != v else v if v is None else float(v)] for v in line] == list(range(len(line)))


def test_ranks_of_rows_without_a_key(spark):
    """A third of the rows have no key, a third one key: they share a hash and are told apart."""
    k = F.col("id")
    rows = spark.range(0, 30_000, 1, 6).select(k.alias("row"), F.when(k % 3 == 0, None).when(k % 3 == 1, 7).otherwise(k).alias("key"), F.lit("x").alias("c"))
    with_order = rows.withColumn("o", splits.shuffled(F.col("key")))
    lead = F.conv(F.substring("o", 1, 13), 16, 10).cast("double")
    found, many = ranges.ranged(with_order, [lead, F.xxhash64("row", "key", "c")], ["c"], LIMIT)
    assert many and found.groupBy("__range").count().agg(F.max("count")).first()[0] <= LIMIT
    got = ranges.ranked(rows, "c", splits.shuffled(F.col("key")), "key", LIMIT).collect()
    assert sorted(r["__r"] for r in got) == list(range(1, 30_001)) and {r["__n"] for r in got} == {30_000}
    plain = {r["key"]: r["o"] for r in with_order.where("key is not null and key <> 7").collect()}
    ordered = [r["key"] for r in sorted(got, key=lambda r: r["__r"]) if r["key"] not in (None, 7)]
    assert ordered == sorted(plain, key=lambda key: plain[key])


def test_equal_rows_only(spark):
    """Nothing can be split: one window, which holds what is equal."""
    rows = spark.range(3000).select(F.lit(1.0).alias("x"), F.lit(1).alias("n"))
    found, many = ranges.ranged(rows, [F.col("x")], [], 100)
    assert many and found.select("__range").distinct().count() == 1


def test_a_small_group_has_one_range(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("x"))
    found, many = ranges.ranged(rows, [F.col("x")], [])
    assert not many and found.select("__range").distinct().count() == 1
