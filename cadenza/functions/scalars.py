"""Scalar rules as column expressions; everything stays in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the scoring rules.
TINY = 1e-6
METRIC_TINY = 1e-9


def num(x: Column | float | str) -> Column:
    """A double column of a column, a name or a number."""
    if isinstance(x, Column):
        return x.cast("double")
    return F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))


def clip01(x: Column) -> Column:
    """Held between 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def logistic(x: Column, center: float, scale: float) -> Column:
    """Rise from 0 to 1 around ``center``; the argument is held between -12 and 12."""
    z = (x - F.lit(float(center))) / F.lit(max(float(scale), TINY))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))))


def sigmoid(x: Column) -> Column:
    """Model output; the argument is held between -50 and 50."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0))))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def relu_slope(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def ratio(a: Column, b: Column, eps: float = TINY) -> Column:
    """a / (b + eps)."""
    return a / (b + F.lit(eps))


def safe_double(x: Column, default: float = 0.0) -> Column:
    """Text to double; null, blank, NaN and what can't be read give the default."""
    text = F.trim(x.cast("string"))
    plain = F.regexp_like(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    return F.coalesce(F.when(plain, text.try_cast("double")), F.lit(default))


def safe_int(x: Column, default: int = 0) -> Column:
    """Text to whole number by way of double; fractions are cut."""
    return safe_double(x, float(default)).cast("long")


def meets(value: Column, target: float | Column, tolerance: float = METRIC_TINY) -> Column:
    """value >= target, but for rounding."""
    return value + F.lit(tolerance) >= target


def confidence_level(score: Column, threshold: Column | float) -> Column:
    """HIGH, MEDIUM or LOW by the distance of a score from its threshold."""
    margin = F.abs(score - threshold)
    return F.when(margin > 0.20, "HIGH").when(margin > 0.10, "MEDIUM").otherwise("LOW")


def normalized_weights(weights: Column) -> Column:
    """An array scaled to the sum 1; equal parts if the sum isn't positive."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(weights)))


def finite_or(x: Column, default: float = 0.0) -> Column:
    """NaN, infinities and nulls as the default."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def pair_id(name: Column, pattern: str = r"_(\d+)$") -> Column:
    """The number that ends a file's stem, else the stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.regexp_extract(stem, pattern, 1)
    return F.when(found != "", found).otherwise(stem)


def category(path: Column, label: Column, plain: tuple[str, ...] = ("ai", "authentic"), cut: str = "_") -> Column:
    """First part of the stem unless that is a plain class name; then the folder; then the class."""
    parts = F.split(path, "/")
    stem = F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    head = F.split(stem, cut)[0]
    folder = F.lower(F.try_element_at(parts, F.lit(-2)))
    named = F.when(label == 1, "ai").otherwise("authentic")
    return (
        F.when(F.contains(stem, F.lit(cut)) & ~head.isin(*plain) & (head != ""), head)
        .when(folder.isNotNull() & (folder != "") & ~folder.isin(*plain), folder)
        .otherwise(named)
    )


def manifest_tokens(original: Column, name: Column) -> Column:
    """Source tokens of a manifest entry; the pair id where there is none."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(original, F.lit("")), r"\.[^.]*$", ""), "_"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(pair_id(name)))


def score_bar(score: Column, width: int = 20) -> Column:
    """A text bar with a level."""
    full = F.floor(clip01(score) * width).cast("int")
    level = F.when(score > 0.65, "HIGH").when(score > 0.35, "MED").otherwise("LOW")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full), F.lit("] "), level)
