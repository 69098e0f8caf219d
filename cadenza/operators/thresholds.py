"""Threshold search over cumulative counts: one sort, no rescan per candidate.

Scores are summed to different values first, once for a search (``score_counts``). The confusion at a candidate t is read from the
running count of rows below t, so the cost is that of sorting scores and candidates. Running
counts and neighbours go by ranges of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip01, meets
from ..sources.scratch import materialize
from .metrics import rates
from .ranges import neighbours, sums_before

STEP = 1e-6


def candidates(df: DataFrame, score: str) -> DataFrame:
    """0, 0.5, 1, every score less and plus a step, and all midpoints; scores held in [0, 1]."""
    s = df.select(clip01(F.col(score)).alias("s")).distinct()
    s = neighbours(s, "s")
    near = F.array(F.greatest(F.lit(0.0), F.col("s") - STEP), F.least(F.lit(1.0), F.col("s") + STEP), (F.col("s") + F.col("after")) * 0.5)
    fixed = df.sparkSession.createDataFrame([(0.0,), (0.5,), (1.0,)], "threshold double")
    return s.select(F.explode(F.array_compact(near)).alias("threshold")).unionByName(fixed).distinct()


def midpoint_grid(df: DataFrame, score: str) -> DataFrame:
    """A step below the least score, all midpoints, a step above the largest.

    A single score gives itself with a step to either side; no score gives 0.5.
    """
    s = neighbours(df.select(F.col(score).cast("double").alias("s")).where("s is not null").distinct(), "s")
    low = F.when(F.col("before").isNull(), F.greatest(F.lit(0.0), F.col("s") - STEP))
    high = F.when(F.col("after").isNull(), F.least(F.lit(1.0), F.col("s") + STEP))
    alone = F.when(F.col("before").isNull() & F.col("after").isNull(), F.col("s"))
    found = s.select(F.explode(F.array_compact(F.array(low, (F.col("s") + F.col("after")) / 2.0, alone, high))).alias("threshold")).distinct()
    none = df.sparkSession.createDataFrame([(0.5,)], "threshold double")
    return found.unionByName(none.join(found.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti"))


def score_counts(df: DataFrame, label: str, score: str, abstained: Column | None = None) -> DataFrame:
    """``at, p, n, ap, an``: rows of either class at each score, abstained ones apart; written,
    so a search reads its rows once."""
    away = abstained if abstained is not None else F.lit(False)
    rows = df.select(F.col(label).alias("y"), F.col(score).alias("at"), away.alias("away"))
    sums = rows.groupBy("at").agg(
        F.count_if((F.col("y") == 1) & ~F.col("away")).alias("p"),
        F.count_if((F.col("y") == 0) & ~F.col("away")).alias("n"),
        F.count_if((F.col("y") == 1) & F.col("away")).alias("ap"),
        F.count_if((F.col("y") == 0) & F.col("away")).alias("an"),
    )
    return materialize(sums, "score-counts")


def confusion_curve(df: DataFrame, label: str, score: str, grid: DataFrame, abstained: Column | None = None) -> DataFrame:
    """Metrics of ``score >= threshold`` at every threshold of the grid.

    Abstained rows are wrong at every threshold.
    """
    return curve_of(score_counts(df, label, score, abstained), grid)


def curve_of(sums: DataFrame, grid: DataFrame) -> DataFrame:
    """The same from ``score_counts``."""
    zero = F.lit(0).cast("long")
    both = sums.withColumn("is_grid", F.lit(0)).unionByName(
        grid.select(F.col("threshold").alias("at"), *[zero.alias(c) for c in ("p", "n", "ap", "an")], F.lit(-1).alias("is_grid"))
    )
    totals = sums.agg(*[F.coalesce(F.sum(c), zero).alias(f"all_{c}") for c in ("p", "n", "ap", "an")])
    curve = sums_before(both, "at", ["p", "n"], then=[F.col("is_grid")]).where("is_grid = -1")
    # one row of totals
    curve = curve.join(totals).select("at", F.col("before_p").alias("fn0"), F.col("before_n").alias("tn"), "all_p", "all_n", "all_ap", "all_an")
    curve = curve.select(
        F.col("at").alias("threshold"),
        (F.col("all_p") - F.col("fn0")).alias("tp"),
        "tn",
        (F.col("all_n") - F.col("tn") + F.col("all_an")).alias("fp"),
        (F.col("fn0") + F.col("all_ap")).alias("fn"),
    )
    return rates(curve)


def _r(name: str) -> Column:
    return F.round(F.col(name), 12)


def best(curve: DataFrame, key: Column) -> DataFrame:
    """The row with the largest key; the smaller threshold on ties."""
    return curve.withColumn("__key", key).orderBy(F.desc("__key"), "threshold").limit(1).drop("__key")


def tiered(curve: DataFrame, least_specificity: float, least_recall: float) -> DataFrame:
    """Adds tier: 2 both limits met, 1 specificity only, 0 neither."""
    spec, rec = meets(F.col("specificity"), least_specificity), meets(F.col("recall"), least_recall)
    return curve.withColumn("tier", F.when(spec & rec, 2).when(spec, 1).otherwise(0))


def _by_tier(orders: dict[int, list[str]]) -> Column:
    """A struct key whose later fields depend on the tier; closeness to 0.5 comes last."""
    close = -F.abs(F.col("threshold") - 0.5)
    width = max(map(len, orders.values())) + 1
    out = []
    for k in range(width):
        pick = F.lit(None).cast("double")
        for tier, names in orders.items():
            value = _r(names[k]) if k < len(names) else close if k == len(names) else F.lit(0.0)
            pick = F.when(F.col("tier") == tier, value).otherwise(pick)
        out.append(pick.alias(f"k{k}"))
    return F.struct("tier", *out)


def specificity_first(df: DataFrame, label: str, score: str, least_specificity: float = 0.70, least_recall: float = 0.0) -> DataFrame:
    """The threshold of a learned head: limits first, then balanced accuracy, in tiers."""
    sums = score_counts(df, label, score)
    curve = tiered(curve_of(sums, candidates(sums, "at")), least_specificity, least_recall)
    key = _by_tier(
        {
            2: ["balanced_accuracy", "f1", "recall", "specificity"],
            1: ["balanced_accuracy", "specificity", "f1", "recall"],
            0: ["specificity", "recall", "balanced_accuracy"],
        }
    )
    return best(curve, key)


def tuned_detector(df: DataFrame, label: str, score: str, least_specificity: float = 0.60, least_recall: float = 0.65, abstained: Column | None = None) -> DataFrame:
    """The threshold of the detector, abstentions counted as errors."""
    sums = score_counts(df, label, score, abstained)
    curve = tiered(curve_of(sums, midpoint_grid(sums, "at")), least_specificity, least_recall)
    key = _by_tier(
        {
            2: ["balanced_accuracy", "f1", "youden_j", "recall"],
            1: ["balanced_accuracy", "specificity", "f1", "youden_j", "recall"],
            0: ["specificity", "balanced_accuracy", "recall"],
        }
    )
    return best(curve, key)


def balanced_first(df: DataFrame, label: str, score: str) -> DataFrame:
    """Balanced accuracy, then Youden, F1, accuracy, and closeness to 0.5."""
    sums = score_counts(df, label, score)
    curve = curve_of(sums, midpoint_grid(sums, "at"))
    return best(curve, F.struct(_r("balanced_accuracy").alias("a"), _r("youden_j").alias("b"), _r("f1").alias("c"), _r("accuracy").alias("d"), (-F.abs(F.col("threshold") - 0.5)).alias("e")))


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold with the largest recall + specificity - 1."""
    sums = score_counts(df, label, score)
    return best(curve_of(sums, candidates(sums, "at")), _r("youden_j"))


def f1_grid(spark, steps: int = 91, low: float = 0.05, step: float = 0.01) -> DataFrame:
    """Equally spaced thresholds, each computed from the first and the rounded step."""
    width = F.lit(low + step) - F.lit(low)
    return spark.range(steps).select((F.lit(low) + F.col("id") * width).alias("threshold"))


def best_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """The first of the fixed thresholds with the largest F1."""
    return best(confusion_curve(df, label, score, f1_grid(df.sparkSession)), F.col("f1"))
