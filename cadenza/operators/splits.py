"""Data splits that keep groups and classes together, and checks of given splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import manifest_tokens
from ..sources.scratch import materialize
from .graph import connected_components
from .ranges import ranked
from .scans import Step, ordered_scan

#: Tokens that the name of a group spells out.
NAMED = 64
#: Splits in the order in which ties are decided.
ORDER = ("validation", "test", "train")


def shuffled(key: Column, seed: int = 42) -> Column:
    """A fixed random order of keys."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def source_groups(manifest: DataFrame, name: str = "filename", original: str = "original") -> DataFrame:
    """``filename, source_primary, source_secondary, source_group``: files joined through shared
    source tokens; a group's name is its sorted tokens joined by a bar, of groups with more than
    ``NAMED`` the first of them, how many more there are, and a digest."""
    rows = manifest.select(name, manifest_tokens(F.col(original), F.col(name)).alias("tokens"))
    ids = rows.select(F.explode("tokens").alias("token")).distinct()
    edges = rows.select(F.col("tokens")[0].alias("u"), F.explode("tokens").alias("v"))
    parts = connected_components(edges)
    # the first tokens of each component; a larger one adds their number and a digest of all
    nth = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    head = parts.withColumn("nth", nth).where(F.col("nth") <= NAMED).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), "|").alias("head"))
    whole = parts.groupBy("component").agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("node"))).alias("digest"))
    rest = F.when(F.col("n") > NAMED, F.concat(F.lit("|+"), F.col("n") - NAMED, F.lit("#"), F.lower("digest"))).otherwise("")
    named = head.join(whole, "component").select("component", F.concat("head", rest).alias("source_group"))
    found = ids.join(parts, ids["token"] == parts["node"]).join(named, "component").select("token", "source_group")
    out = rows.withColumn("token", F.col("tokens")[0]).join(found, "token")
    return out.select(name, F.get("tokens", F.lit(0)).alias("source_primary"), F.get("tokens", F.lit(1)).alias("source_secondary"), "source_group")


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split, with the splits."""
    out = df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return out.where(F.size("splits") > 1)


def without_split(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows that no split names."""
    return rows.join(splits.select(key), key, "left_anti")


def with_split(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows with their split, ``unused`` where there is none."""
    return rows.join(splits.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("unused")))


def index_split(rows: DataFrame, manifest: DataFrame, index: str) -> DataFrame:
    """Rows by number with the split of a manifest ``index, split`` (text); numbers that can't
    be read or lie outside the rows, and other names of splits, go."""
    name = F.lower(F.trim("split"))
    given = manifest.select(F.floor(F.col("index").try_cast("double")).cast("long").alias("__i"), F.when(name == "val", "validation").otherwise(name).alias("split"))
    given = given.where((F.col("__i") >= 0) & (F.col("__i") < rows.count()) & F.col("split").isin(*ORDER))
    return rows.join(given, rows[index] == given["__i"]).drop("__i")


def official_split(rows: DataFrame, official: DataFrame, key: str, pair: str, label: str, seed: int = 42) -> DataFrame:
    """Rows with split and strategy: the given split if it names every row and parts no pair,
    else one made of whole pairs."""
    given = rows.join(official.select(F.col(key).alias("__k"), "split"), F.col(key) == F.col("__k"), "left").drop("__k")
    whole = given.where("split is null").isEmpty()
    if whole and leaking_groups(given, pair, "split").isEmpty():
        return given.withColumn("strategy", F.lit("official_dataset_split_pair_safe"))
    made = group_split(rows, pair, label, seed=seed)
    return rows.join(made, pair).withColumn("strategy", F.lit("source_connected_group_split"))


def stratified_split(df: DataFrame, key: str, label: str, validation: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: per class in a fixed random order, train first, then validation, then test.

    Shares round to whole rows, one of each at least; classes of up to three rows fill train,
    validation, test in turn, and a share never leaves train empty.
    """
    rows = ranked(df, label, shuffled(F.col(key), seed), key)
    n = F.col("__n")
    val = F.when(n <= 1, 0).when(n <= 3, 1).otherwise(F.greatest(F.lit(1), F.bround(n * validation).cast("int")))
    tst = F.when(n <= 2, 0).when(n == 3, 1).otherwise(F.greatest(F.lit(1), F.bround(n * test).cast("int")))
    train = F.greatest(F.lit(1), n - val - tst)
    split = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= n - tst, "validation").otherwise("test")
    return rows.withColumn("split", split).drop("__n", "__r")


def floor_split(df: DataFrame, key: str, label: str, validation: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: shares cut to whole rows but one at least, test first, then validation, the rest train."""
    rows = ranked(df, label, shuffled(F.col(key), seed), key)
    n, r = F.col("__n"), F.col("__r")
    t, v = (F.greatest(F.lit(1), F.floor(n * share)) for share in (test, validation))
    return rows.withColumn("split", F.when(r <= t, "test").when(r <= t + v, "validation").otherwise("train")).drop("__n", "__r")


def capped_sample(df: DataFrame, key: str, label: str, per_class: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each class, in a fixed random order."""
    return ranked(df, label, shuffled(F.col(key), seed), key).where(F.col("__r") <= per_class).drop("__n", "__r")


def _dealing(total: tuple[str, str], validation: float, test: float) -> Callable[[], Step]:
    """Deals runs of groups of one shape in order; the class counts of the splits are carried."""

    def make() -> Step:
        have: dict[str, list[int]] = {}
        goal: dict[str, list[int]] = {}

        def run(add: tuple[int, int], left: int) -> list[dict]:
            out, start = [], 1
            while left:
                gain = {s: sum(abs(g - h - a) - abs(g - h) for g, h, a in zip(goal[s], have[s], add, strict=True)) for s in ORDER}
                pick = min(ORDER, key=lambda s: (gain[s], ORDER.index(s)))
                room = [(g - h) // a for g, h, a in zip(goal[pick], have[pick], add, strict=True) if a]
                # below its target a split's gain stays the same, so it goes on winning
                size = min(max(1, min(room)) if room else left, left)
                have[pick] = [h + size * a for h, a in zip(have[pick], add, strict=True)]
                if out and out[-1]["split"] == pick:
                    out[-1]["last"] += size
                else:
                    out.append({"first": start, "last": start + size - 1, "split": pick})
                start, left = start + size, left - size
            return out

        def step(first: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
            dealt = []
            columns = (batch.column(c).to_pylist() for c in (*total, "pos", "neg", "k"))
            for new, pos_total, neg_total, pos, neg, k in zip(first.tolist(), *columns, strict=True):
                if new:
                    sums = (pos_total, neg_total)
                    goal["validation"] = [max(1, round(t * validation)) for t in sums]
                    goal["test"] = [max(1, round(t * test)) for t in sums]
                    goal["train"] = [max(t - v - e, 0) for t, v, e in zip(sums, goal["validation"], goal["test"], strict=True)]
                    have.update({s: [0, 0] for s in ORDER})
                dealt.append(run((pos, neg), k))
            return [pa.array(dealt, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("split", pa.string())])))]

        return step

    return make


def group_split(df: DataFrame, group: str, label: str, validation: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``group, split``: groups, the largest first, each to the split that leaves the class
    counts of all splits nearest to their targets.

    The choice depends on all earlier ones. Groups are therefore summed to their class counts
    first: all groups of one shape (class counts) form one run, and an ordered scan over the
    runs deals a run's groups in turn, carrying the class counts of the splits. A run gives a
    few stretches of ranks; groups meet them by shape and by their rank in the shape.
    """
    sums = materialize(df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "groups")
    shapes = sums.groupBy("pos", "neg").agg(F.count(F.lit(1)).alias("k"))
    totals = sums.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"))
    # one row of totals beside each shape; all shapes are one sequence
    runs = shapes.join(totals).withColumn("size", -(F.col("pos") + F.col("neg"))).withColumn("all", F.lit(0))
    dealt = ordered_scan(runs, ["all"], ["size", "pos", "neg"], _dealing(("all_pos", "all_neg"), validation, test), "dealt array<struct<first:bigint,last:bigint,split:string>>")
    plan = dealt.select(F.concat_ws(":", "pos", "neg").alias("__shape"), F.explode("dealt").alias("d")).select("__shape", "d.*")
    named = sums.withColumn("shape", F.concat_ws(":", "pos", "neg")).select(group, "shape")
    places = ranked(named, "shape", shuffled(F.col(group), seed), group)
    return places.join(plan, (F.col("shape") == F.col("__shape")) & F.col("__r").between(F.col("first"), F.col("last"))).select(group, "split")
