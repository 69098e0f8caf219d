"""Dealing groups to splits against a loop over groups, and what the plan does."""

import hashlib
import random

from pyspark.sql import functions as F

from cadenza.operators import splits


def dealt(rows, validation=0.2, test=0.2):
    groups = {}
    for g, y in rows:
        pos, neg = groups.get(g, (0, 0))
        groups[g] = (pos + (y == 1), neg + (y == 0))
    total = [sum(v[k] for v in groups.values()) for k in (0, 1)]
    goal = {"validation": [max(1, round(t * validation)) for t in total], "test": [max(1, round(t * test)) for t in total]}
    goal["train"] = [max(t - v - e, 0) for t, v, e in zip(total, goal["validation"], goal["test"], strict=True)]
    have, out = {s: [0, 0] for s in splits.ORDER}, {}
    md5 = lambda g: hashlib.md5(f"{g}:42".encode()).hexdigest()
    for g in sorted(groups, key=lambda g: (-sum(groups[g]), *groups[g], md5(g), g)):
        add = groups[g]
        gain = {s: sum(abs(t - h - a) - abs(t - h) for t, h, a in zip(goal[s], have[s], add, strict=True)) for s in splits.ORDER}
        pick = min(splits.ORDER, key=lambda s: (gain[s], splits.ORDER.index(s)))
        have[pick] = [h + a for h, a in zip(have[pick], add, strict=True)]
        out[g] = pick
    return out


def test_against_a_loop_over_groups(spark):
    rng = random.Random(8)
    for many in (7, 60, 400):
        rows = [(f"g{rng.randint(0, many)}", rng.choice([0, 0, 1])) for _ in range(many * 3)] + [("giant", k % 2) for k in range(many)]
        df = spark.createDataFrame(rows, "g string, y int").repartition(4)
        got = {r["g"]: r["split"] for r in splits.group_split(df, "g", "y").collect()}
        assert got == dealt(rows)


def test_many_groups_of_one_shape(spark):
    df = spark.range(60_000).select(F.concat(F.lit("g"), (F.col("id") / 2).cast("long")).alias("g"), (F.col("id") % 2).cast("int").alias("y"))
    got = {r["split"]: r["count"] for r in splits.group_split(df, "g", "y").groupBy("split").count().collect()}
    assert got == {"train": 18_000, "validation": 6_000, "test": 6_000}


def test_names_of_large_components_are_bounded(spark):
    rows = [(f"{k}_{k + 1}.mp4", f"{k}_{k + 1}") for k in range(300)] + [("900_901.mp4", "900_901")]
    out = splits.source_groups(spark.createDataFrame(rows, "filename string, original string")).collect()
    names = {r["source_group"] for r in out}
    assert len(names) == 2 and min(names, key=len) == "900|901"
    long = max(names, key=len)
    assert long.split("|+")[1].startswith("237#") and long.split("|+")[0] == "|".join(sorted(map(str, range(301)))[: splits.NAMED])


def test_no_groups(spark):
    assert splits.group_split(spark.createDataFrame([], "g string, y int"), "g", "y").count() == 0
