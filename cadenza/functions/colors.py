"""Colour spaces of 8-bit pixels as expressions over blue, green and red."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weights of red, green and blue: brightness, then X, Y and Z, and the white point (fixed values).
GRAY = (0.299, 0.587, 0.114)
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.lit(GRAY[0]) * r + F.lit(GRAY[1]) * g + F.lit(GRAY[2]) * b


def ycrcb(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Brightness and the two colour differences, around 128."""
    y = gray(b, g, r)
    return y, (r - y) * 0.713 + 128.0, (b - y) * 0.564 + 128.0


def _linear(c: Column) -> Column:
    """Light of an 8-bit sRGB value."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Lightness from 0 to 255 and the two opponent colours, around 128."""
    light = [_linear(c) for c in (r, g, b)]
    f = []
    for weights, white in zip(XYZ, WHITE, strict=True):
        t = (F.lit(weights[0]) * light[0] + F.lit(weights[1]) * light[1] + F.lit(weights[2]) * light[2]) / F.lit(white)
        f.append(F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(F.lit(7.787) * t + F.lit(16.0 / 116.0)))
    x, y, z = f
    return (116.0 * y - 16.0) * F.lit(255.0 / 100.0), 500.0 * (x - y) + 128.0, 200.0 * (y - z) + 128.0
