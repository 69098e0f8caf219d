"""Boxes as structs x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) * 0.5).alias("x"), ((b["y1"] + b["y2"]) * 0.5).alias("y"))


def clip_box(b: Column, width: Column, height: Column) -> Column:
    """Inside the image, at least one pixel wide and high."""
    x1 = F.greatest(F.lit(0), F.least(b["x1"], width - 1))
    y1 = F.greatest(F.lit(0), F.least(b["y1"], height - 1))
    return box(x1, y1, F.greatest(x1 + 1, F.least(b["x2"], width)), F.greatest(y1 + 1, F.least(b["y2"], height)))


def expand_box(b: Column, scale: float, width: Column, height: Column) -> Column:
    """Grown about its centre, sides of two pixels at least, halves rounded to even, then clipped."""
    c = center(b)
    w = F.greatest(F.lit(2.0), (b["x2"] - b["x1"]) * F.lit(float(scale))) * 0.5
    h = F.greatest(F.lit(2.0), (b["y2"] - b["y1"]) * F.lit(float(scale))) * 0.5
    grown = box(F.bround(c["x"] - w), F.bround(c["y"] - h), F.bround(c["x"] + w), F.bround(c["y"] + h))
    return clip_box(grown, width, height)


def area(b: Column) -> Column:
    """At least 1."""
    return F.greatest(F.lit(1), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).cast("double")


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 without overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)).cast("double")
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)
