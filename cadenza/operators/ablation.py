"""Ablations: configurations times rows, evaluated together by one grouped AUC.

The table of configurations is a literal of known size, so joining it to the rows is a
projection: each row carries an array of configured scores that is then exploded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .metrics import auc, counted, rates
from .ranges import ranged

#: Vectors of a range of scores, and rows whose vectors a task makes at once.
VECTOR_ROWS = 20_000
_VECTORS = 2000
#: Parts of a range that holds one score.
_PARTS = 64

#: Default level weights and those of the level ablation (fixed values).
DEFAULT = (0.14, 0.34, 0.02, 0.50)
LEVELS = {
    "all": (0.18, 0.42, 0.02, 0.38),
    "l1_l2_l3": (0.30, 0.65, 0.05, 0.00),
    "l1_l2_l4": (0.18, 0.42, 0.00, 0.40),
    "l2_l3_l4": (0.00, 0.50, 0.10, 0.40),
    "l1_l3_l4": (0.30, 0.00, 0.30, 0.40),
    "l4_only": (0.00, 0.00, 0.00, 1.00),
    "l1_l2": (0.30, 0.70, 0.00, 0.00),
    "l2_only": (0.00, 1.00, 0.00, 0.00),
    "l1_only": (1.00, 0.00, 0.00, 0.00),
    "l3_only": (0.00, 0.00, 1.00, 0.00),
}


def weighted(levels: list[Column], weights: tuple[float, ...]) -> Column:
    """Sum of weight times level."""
    out = F.lit(float(weights[0])) * levels[0]
    for w, x in zip(weights[1:], levels[1:], strict=True):
        out = out + F.lit(float(w)) * x
    return out


def configured(df: DataFrame, label: str, scores: dict[str, Column]) -> DataFrame:
    """``config, y, s``: a row per input row and configuration."""
    each = F.array(*[F.struct(F.lit(name).alias("config"), s.alias("s")) for name, s in scores.items()])
    return df.select(F.col(label).alias("y"), F.explode(each).alias("c")).select("c.config", "y", "c.s")


def best_f1_by_config(rows: DataFrame, steps: int = 91, weight: str | None = None) -> DataFrame:
    """The first fixed threshold with the largest F1 of each configuration.

    A row counts at the thresholds at or below its score, so counts per score bin are summed
    from above; no row meets all thresholds.
    """
    width = (0.05 + 0.01) - 0.05
    grid = rows.sparkSession.range(steps).select(F.col("id").cast("int").alias("k"), (F.lit(0.05) + F.col("id") * F.lit(width)).alias("t"))
    first = F.floor((F.col("s") - 0.05) / 0.01).cast("int")
    near = F.array(*[first + d for d in (1, 0, -1)])
    place = F.coalesce(F.get(F.filter(near, lambda k: (k >= 0) & (k < steps) & (F.lit(0.05) + k * F.lit(width) <= F.col("s"))), F.lit(0)), F.when(F.col("s") >= 0.9, steps - 1).otherwise(-1))
    sums = rows.groupBy("config", place.alias("k")).agg(counted(F.col("y") == 1, weight).alias("p"), counted(F.col("y") == 0, weight).alias("n"))
    filled = sums.select("config").distinct().join(F.broadcast(grid)).join(sums, ["config", "k"], "left").na.fill(0, ["p", "n"])
    low = sums.where("k = -1").select("config", F.lit(-1).alias("k"), F.lit(0.0).alias("t"), "p", "n")
    down = Window.partitionBy("config").orderBy(F.desc("k"))
    whole = Window.partitionBy("config")
    run = filled.unionByName(low).withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down))
    run = run.withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("n").over(whole) - F.col("fp")).where("k >= 0")
    pick = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("f1"), "k"))
    return rates(run).withColumn("r", pick).where("r = 1").select("config", F.col("t").alias("threshold"), "f1", "accuracy")


def evaluated(rows: DataFrame) -> DataFrame:
    """AUC, best F1 with its threshold, and accuracy there, of each configuration."""
    sums = materialize(rows.groupBy("config", "s", "y").agg(F.count("*").alias("k")), "configured")
    return auc(sums, "y", "s", ["config"], "k").join(best_f1_by_config(sums, weight="k"), "config")


def level_ablation(df: DataFrame, label: str, levels: list[Column], configs: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """AUC, its drop against the first configuration, best F1 and accuracy of each weighting."""
    configs = configs or LEVELS
    out = evaluated(configured(df, label, {n: weighted(levels, w) for n, w in configs.items()}))
    # a row per configuration
    base = F.max(F.when(F.col("config") == next(iter(configs)), F.col("auc"))).over(Window.partitionBy())
    return out.withColumn("auc_drop", base - F.col("auc"))


def level_intervals(df: DataFrame, key: str, label: str, levels: list[Column], configs: dict[str, tuple[float, ...]] | None = None, rounds: int = 200) -> DataFrame:
    """Interval of the AUC of each weighting; all see the same resamples."""
    each = F.array(*[F.struct(F.lit(n).alias("config"), weighted(levels, w).alias("s")) for n, w in (configs or LEVELS).items()])
    rows = df.select(key, F.col(label).alias("y"), F.explode(each).alias("c")).select(key, "y", "c.config", "c.s")
    return bootstrap_auc(rows, key, "y", "s", rounds, groups=["config"])


def leave_one_out(df: DataFrame, label: str, features: list[list[str]], weights: tuple[float, ...]) -> DataFrame:
    """AUC without each feature in turn; a level is the mean of its features, a missing one counts 0."""

    names = [c for group in features for c in group]

    def score(without: Column) -> Column:
        """The score without the feature of a number; one expression serves all numbers."""
        def mean(group: list[str], first: int) -> Column:
            left = F.transform(F.array(*[F.col(c) for c in group]), lambda x, k: F.when(k + first == without, 0.0).otherwise(x))
            return F.aggregate(left, F.lit(0.0), lambda total, x: total + x) / F.lit(float(len(group)))

        starts = [sum(map(len, features[:k])) for k in range(len(features))]
        return weighted([mean(group, first) for group, first in zip(features, starts, strict=True)], weights)

    told = F.array(*[F.lit(n) for n in ("none", *names)])
    each = F.transform(F.sequence(F.lit(-1), F.lit(len(names) - 1)), lambda k: F.struct(F.get(told, k + 1).alias("config"), score(k).alias("s")))
    rows = df.select(F.col(label).alias("y"), F.explode(each).alias("c")).select("c.config", "y", "c.s")
    out = auc(rows, "y", "s", ["config"])
    full = Window.partitionBy()
    base = F.max(F.when(F.col("config") == "none", F.col("auc"))).over(full)
    return out.withColumn("drop", base - F.col("auc"))


def single_features(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """AUC of each feature on its own."""
    return auc(configured(df, label, {c: F.col(c) for c in features}), "y", "s", ["config"])


def simplex(steps: int, parts: int = 4) -> list[tuple[float, ...]]:
    """All weights that are multiples of 1 / steps and sum to 1."""
    return [tuple(k / steps for k in (*head, steps - sum(head))) for head in product(range(steps + 1), repeat=parts - 1) if sum(head) <= steps]


def weight_search(df: DataFrame, label: str, levels: list[Column], steps: int = 6, best: int = 20) -> DataFrame:
    """The configurations of the weight simplex with the largest AUC, then F1."""
    grid = {"/".join(f"{round(w * steps)}" for w in ws): weighted(levels, ws) for ws in simplex(steps, len(levels))}
    out = evaluated(configured(df, label, grid))
    return out.orderBy(F.desc(F.round("auc", 9)), F.desc(F.round("f1", 9)), "config").limit(best)


def poisson_cuts(most: int = 10) -> list[float]:
    """Distribution function of a Poisson variable of mean 1, up to ``most`` values."""
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(most):
        total += term
        cuts.append(total)
        term /= k + 1
    return cuts


def _multiplicities(keys: list[str], rounds: int, seed: int) -> np.ndarray:
    """How often each row is drawn in each round (rows by rounds)."""
    tails = [f":{r}:{seed}".encode() for r in range(1, rounds + 1)]
    heads = (b"".join([md5(k + t).digest()[:8] for t in tails]) for k in map(str.encode, keys))
    u = np.frombuffer(b"".join(heads), ">u8").reshape(len(keys), rounds) >> np.uint64(12)
    return np.searchsorted(poisson_cuts(), u.astype(np.float64) / float(1 << 52), "right")


def _vectors(rounds: int, seed: int, names: list[str]):
    """Rows ``groups, s, y, key`` to one row per group and score of a batch: ``p, n``, the drawn
    rows of either class by round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _VECTORS):
                part = pa.Table.from_batches([batch.slice(lo, _VECTORS)])
                times = _multiplicities([k or "" for k in part["__key"].to_pylist()], rounds, seed)
                y = part["__y"].to_numpy()
                found = part.select(names).append_column("__at", pa.array(np.arange(len(times)))).group_by(names, use_threads=False).aggregate([("__at", "list")])
                lists = found["__at_list"].combine_chunks()
                at, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1]
                columns = []
                for label in (1, 0):
                    own = np.add.reduceat(times[at] * (y[at] == label)[:, None], edges, axis=0)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * rounds, pa.int32()), pa.array(own.ravel(), pa.int32())))
                yield pa.RecordBatch.from_arrays([*(found[c].combine_chunks() for c in names), *columns], [*names, "p", "n"])

    return run


def _won(names: list[str], rounds: int):
    """One range: by round, the drawn rows of either class, and the pairs inside it that are in order."""

    def run(table: pa.Table) -> pa.Table:
        s = table["s"].to_numpy()
        order = np.argsort(s, kind="stable")
        s = s[order]
        edges = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
        p, n = (np.add.reduceat(table[c].combine_chunks().flatten().to_numpy().reshape(-1, rounds)[order].astype(np.int64), edges, axis=0) for c in ("p", "n"))
        won = (p * (np.cumsum(n, axis=0) - 0.5 * n)).sum(axis=0)
        each = [pa.array([x.tolist()]) for x in (p.sum(axis=0), n.sum(axis=0), won)]
        return pa.table([*(table[c][:1] for c in names), *each], names=[*names, "p", "n", "won"])

    return run


def bootstrap_auc(df: DataFrame, key: str, label: str, score: str, rounds: int = 200, seed: int = 0, groups: list[str] | None = None, limit: int = VECTOR_ROWS) -> DataFrame:
    """Low, middle and high AUC of Poisson resamples (each row drawn 0, 1, 2, ... times by an
    MD5 of its key, the round and the seed).

    A row carries its multiplicities of all rounds as one vector. Vectors of equal scores are
    summed in tasks; one sort into ranges of scores serves all rounds, the running counts are
    sums of vectors inside a range, and ranges are put together by their sums. A range of one
    score, however many rows share it, is summed in parts.
    """
    groups = groups or []
    names = [*groups, "s"]
    rows = df.select(*groups, F.col(score).cast("double").alias("s"), F.col(key).cast("string").alias("__key"), F.col(label).cast("int").alias("__y"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    summed = rows.mapInArrow(_vectors(rounds, seed, names), f"{fields}, p array<int>, n array<int>")
    placed, many = ranged(summed, [F.col("s")], groups, limit)
    placed = placed.withColumn("part", F.lit(0))
    if many:
        bounds = placed.groupBy(*groups, "__range").agg((F.count("*") > limit).alias("__tied"))
        match = F.col("__range") == F.col("__of")
        for g in groups:
            match &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        tied = bounds.where("__tied").select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__range").alias("__of"), "__tied")
        placed = placed.join(tied, match, "left").withColumn("part", F.when(F.col("__tied"), F.pmod(F.xxhash64("p", "n"), F.lit(_PARTS))).otherwise(0).cast("int"))
    by = [*groups, "__range", "part"]
    placed = placed.select(*by, "s", "p", "n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*by).schema)
    sums = placed.groupBy(*by).applyInArrow(_won(by, rounds), f"{kinds}, p array<bigint>, n array<bigint>, won array<double>")
    each = sums.select(*by, F.posexplode(F.arrays_zip("p", "n", "won")).alias("round", "x")).select(*by, "round", "x.*")
    each = each.groupBy(*groups, "round", "__range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("won").alias("won"), F.count("*").alias("parts"))
    # the parts of one score win and lose among each other by halves
    each = each.withColumn("won", F.when(F.col("parts") > 1, 0.5 * F.col("p") * F.col("n")).otherwise(F.col("won")))
    ahead = Window.partitionBy(*groups, "round").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    pairs = F.sum("p") * F.sum("n").cast("double")
    each = each.groupBy(*groups, "round").agg(F.sum(F.col("p") + F.col("n")).alias("drawn"), F.when(pairs > 0, F.sum(F.col("won") + F.col("p") * F.col("before")) / pairs).otherwise(0.5).alias("auc"))
    at = lambda q: F.element_at(F.array_sort(F.collect_list("auc")), int(q * rounds) + 1)
    return each.where("drawn > 0").groupBy(*groups).agg(at(0.025).alias("low"), F.median("auc").alias("median"), at(0.975).alias("high"))
