"""Classification metrics as aggregates: confusion, tie-aware AUC, per-group reports, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import METRIC_TINY, meets
from .ranges import sums_before

#: Targets of the acceptance gate (fixed values).
TARGETS = {"specificity": 0.60, "recall": 0.65, "balanced_accuracy": 0.65, "score_gap": 0.08}


def confusion(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates tp, tn, fp, fn. A prediction of -1 (abstained) is wrong for either class."""
    n = (lambda c: F.sum(F.when(c, weight).otherwise(0))) if weight is not None else F.count_if
    return [
        n((label == 1) & (predicted == 1)).alias("tp"),
        n((label == 0) & (predicted == 0)).alias("tn"),
        n((label == 0) & (predicted != 0)).alias("fp"),
        n((label == 1) & (predicted != 1)).alias("fn"),
    ]


def rates(df: DataFrame, tp: str = "tp", tn: str = "tn", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds accuracy, precision, recall, specificity, f1, balanced_accuracy and youden_j."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in (tp, tn, fp, fn))
    out = df.withColumn("accuracy", (tp + tn) / F.greatest(tp + tn + fp + fn, F.lit(1.0)))
    out = out.withColumn("precision", tp / (tp + fp + METRIC_TINY)).withColumn("recall", tp / (tp + fn + METRIC_TINY))
    out = out.withColumn("specificity", tn / (tn + fp + METRIC_TINY))
    p, r, s = F.col("precision"), F.col("recall"), F.col("specificity")
    out = out.withColumn("f1", 2.0 * p * r / (p + r + METRIC_TINY))
    return out.withColumn("balanced_accuracy", 0.5 * (r + s)).withColumn("youden_j", r + s - 1.0)


def counted(condition: Column, weight: str | None = None) -> Column:
    """Rows that meet a condition, or the sum of their weights (aggregate)."""
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def auc(df: DataFrame, label: str, score: str, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by group; ties count half, and one class alone gives 0.5.

    Rows are summed by score first, so the running count sees different scores only; it runs
    in ranges of scores.
    """
    groups = groups or []
    ties = df.groupBy(*groups, score).agg(counted(F.col(label) == 1, weight).alias("p"), counted(F.col(label) == 0, weight).alias("n"))
    ties = sums_before(ties, score, ["n"], groups)
    won = F.sum(F.col("p") * (F.col("before_n") + 0.5 * F.col("n")))
    pairs = F.sum("p") * F.sum("n").cast("double")
    return ties.groupBy(*groups).agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"))


def auc_trapezoid(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """The same area by trapezoids under the ROC points of the different scores."""
    groups = groups or []
    ties = df.groupBy(*groups, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ties = sums_before(ties, score, ["p"], groups, falling=True)
    area = F.sum(F.col("n") * (F.col("before_p") + 0.5 * F.col("p")))
    pairs = F.sum("p") * F.sum("n").cast("double")
    return ties.groupBy(*groups).agg(F.when(pairs > 0, area / pairs).otherwise(0.0).alias("auc"))


def at_threshold(df: DataFrame, label: str, score: str, threshold: float, abstained: Column | None = None, groups: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Metrics at a threshold (``>=``; ``>`` if strict), with abstention counts if there are any."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    predicted = F.when(hit, 1).otherwise(0)
    extra = []
    if abstained is not None:
        predicted = F.when(abstained, -1).otherwise(predicted)
        extra = [
            F.count_if(abstained).alias("abstentions"),
            F.count_if(abstained & (F.col(label) == 1)).alias("abstentions_positive"),
            F.count_if(abstained & (F.col(label) == 0)).alias("abstentions_negative"),
            F.avg(abstained.cast("double")).alias("abstention_rate"),
        ]
    return rates(df.groupBy(*(groups or [])).agg(*confusion(F.col(label), predicted), *extra))


def by_category(df: DataFrame, group: str, label: str, score: str, threshold: float) -> DataFrame:
    """Counts, score range and accuracy of each category; AUC, F1 and balanced accuracy are
    null where only one class is present, and label_mode says which."""
    hit = F.col(score) >= threshold
    base = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(hit.cast("double")).alias("predicted_rate"),
        *confusion(F.col(label), F.when(hit, 1).otherwise(0)),
    )
    full = rates(base).join(auc(df, label, score, [group]).withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    mode = F.when(both, "mixed").when(F.col("positives") > 0, "all_ai").otherwise("all_auth")
    return full.select(
        group, "count", "positives", "negatives", "mean_score", "min_score", "max_score", "predicted_rate", "accuracy",
        *[F.when(both, F.col(c)).alias(c) for c in ("auc", "f1", "balanced_accuracy")], mode.alias("label_mode"),
    )


def class_gap(label: str, score: str) -> list[Column]:
    """Aggregates: mean score of either class and their difference; an absent class has mean 0."""
    mean = lambda y: F.coalesce(F.avg(F.when(F.col(label) == y, F.col(score))), F.lit(0.0))
    return [mean(1).alias("mean_positive"), mean(0).alias("mean_negative"), (mean(1) - mean(0)).alias("score_gap")]


def acceptance(df: DataFrame, label: str, score: str, threshold: float, targets: dict[str, float] | None = None) -> DataFrame:
    """One row: observed values, whether each meets its target, and all together."""
    goal = TARGETS | (targets or {})
    hit = F.when(F.col(score) >= threshold, 1).otherwise(0)
    out = rates(df.agg(*confusion(F.col(label), hit), *class_gap(label, score)))
    passes = [meets(F.col(name), t).alias(f"{name}_passes") for name, t in goal.items()]
    out = out.select(*goal, "mean_positive", "mean_negative", *passes)
    both = F.lit(True)
    for name in goal:
        both &= F.col(f"{name}_passes")
    return out.withColumn("all_passed", both)


def batch_summary(df: DataFrame, verdict: str, score: str) -> DataFrame:
    """Counts of verdicts and mean score."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(verdict) == v).alias(v.lower()) for v in ("AI_GENERATED", "AUTHENTIC", "INCONCLUSIVE")],
        F.avg(score).alias("mean_score"),
    )
