"""Image operators on square patches held as arrays.

A patch is one array column in row order. Neighbour sums are array expressions, so a frame
is one row from scan to feature and needs no shuffle; pixels are only exploded for the
operators that group them by region.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import TINY

LAPLACE = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
HIGH_PASS = {(r, c): (1.0 if (r, c) == (0, 0) else -0.125) for r in (-1, 0, 1) for c in (-1, 0, 1)}
SOBEL_X = {(r, c): c * (2.0 if r == 0 else 1.0) for r in (-1, 0, 1) for c in (-1, 1)}
SOBEL_Y = {(r, c): r * (2.0 if c == 0 else 1.0) for r in (-1, 1) for c in (-1, 0, 1)}


def mirrored(k: int, n: int) -> int:
    """A place outside is reflected at the border pixel, which isn't repeated."""
    return -k if k < 0 else 2 * (n - 1) - k if k >= n else k


def gaussian(radius: int, sigma: float) -> list[float]:
    """A normalised one-dimensional Gaussian kernel."""
    one = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(one) for x in one]


def blurred(df: DataFrame, patch: str, out: str, kernel: list[float], side: int = 8) -> DataFrame:
    """Adds the patch under a separable kernel: along rows, then along columns.

    Each pass multiplies by a fixed matrix of mirrored weights, held as one array of rows.
    """
    radius = len(kernel) // 2
    band = [[0.0] * side for _ in range(side)]
    for i in range(side):
        for k, w in enumerate(kernel):
            j = i + k - radius
            while not 0 <= j < side:
                j = mirrored(j, side)
            band[i][j] += w
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in band])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    def lines(name):
        return F.array(*[F.slice(F.col(name), r * side + 1, side) for r in range(side)])

    first = F.flatten(F.transform(rows, lambda w: F.transform(F.col("__lines"), lambda line: dot(w, line))))
    # the first pass leaves columns as lines, so the second gives rows again
    step = df.withColumn("__lines", lines(patch)).withColumn("__half", first).withColumn("__lines", lines("__half"))
    return step.withColumn(out, first).drop("__lines", "__half")


def convolved(pixels: Column, kernel: dict[tuple[int, int], float], side: int = 8) -> Column:
    """The patch under a kernel, borders mirrored."""
    out = []
    for r in range(side):
        for c in range(side):
            total = None
            for (dr, dc), w in sorted(kernel.items()):
                if w == 0:
                    continue
                x = F.get(pixels, F.lit(mirrored(r + dr, side) * side + mirrored(c + dc, side))).cast("double") * F.lit(float(w))
                total = x if total is None else total + x
            out.append(total)
    return F.array(*out)


def array_mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def array_variance(xs: Column) -> Column:
    """Population variance."""
    n = F.size(xs).cast("double")
    s1 = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    return F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))


def array_kurtosis(xs: Column, mean: Column, variance: Column) -> Column:
    """Excess kurtosis; 0 for a constant patch."""
    fourth = F.aggregate(F.transform(xs, lambda x: F.pow(x - mean, F.lit(4.0))), F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    return F.when(variance > 1e-12, fourth / (variance * variance) - 3.0).otherwise(0.0)


def masked(xs: Column, keep: list[bool]) -> Column:
    """The values at the places of a fixed mask."""
    return F.array(*[F.get(xs, F.lit(k)) for k, ok in enumerate(keep) if ok])


def region_masks(side: int, box: tuple[int, int, int, int], band: float = 1.14, ring: float = 1.50) -> dict[str, list[bool]]:
    """Masks of a box, of the band around it and of the ring around both."""
    def inside(b, r, c):
        return b[0] <= c < b[2] and b[1] <= r < b[3]

    def grown(scale):
        x1, y1, x2, y2 = box
        cx, cy, w, h = (x1 + x2) / 2, (y1 + y2) / 2, max(2.0, (x2 - x1) * scale) / 2, max(2.0, (y2 - y1) * scale) / 2
        b = [round(cx - w), round(cy - h), round(cx + w), round(cy + h)]
        lo = [max(0, min(b[0], side - 1)), max(0, min(b[1], side - 1))]
        return [*lo, max(lo[0] + 1, min(b[2], side)), max(lo[1] + 1, min(b[3], side))]

    second, third = grown(band), grown(ring)
    out: dict[str, list[bool]] = {"inner": [], "band": [], "ring": []}
    for r in range(side):
        for c in range(side):
            a, b, d = inside(box, r, c), inside(second, r, c), inside(third, r, c)
            out["inner"].append(a)
            out["band"].append(b and not a)
            out["ring"].append(d and not b and not a)
    return out


def upper_mask(mask: list[bool], side: int, part: float = 0.62) -> list[bool]:
    """Of a mask, the upper part without the outer 8 percent on either side."""
    return [m and k // side < part * side and 0.08 * side <= k % side < 0.92 * side for k, m in enumerate(mask)]


def masked_mean(xs: Column, keep: list[bool]) -> Column:
    n = sum(keep)
    return F.lit(0.0) if not n else array_mean(masked(xs, keep))


def pixels(df: DataFrame, keys: list[str], patch: str, side: int = 8) -> DataFrame:
    """``keys, r, c, x``: one row per pixel."""
    return df.select(*keys, F.posexplode(patch).alias("k", "v")).select(
        *keys, F.floor(F.col("k") / side).cast("int").alias("r"), (F.col("k") % side).cast("int").alias("c"), F.col("v").cast("double").alias("x")
    )


def asymmetry(xs: Column, side: int = 8) -> Column:
    """Mean difference of the patch and its mirror image, by their mean strength."""
    flipped = F.array(*[F.get(xs, F.lit(r * side + side - 1 - c)) for r in range(side) for c in range(side)])
    gap = F.aggregate(F.zip_with(xs, flipped, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / float(side * side)
    strength = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x)) / float(side * side)
    return gap / (0.5 * (strength + strength + TINY))


def dct_high_share(xs: Column, side: int = 8) -> Column:
    """Energy of the high half of the cosine spectrum in both directions, by all energy."""
    basis = [[(math.sqrt(1 / side) if k == 0 else math.sqrt(2 / side)) * math.cos(math.pi * (2 * n + 1) * k / (2 * side)) for n in range(side)] for k in range(side)]
    table = F.array(*[F.array(*[F.lit(basis[i][n] * basis[j][m]) for n in range(side) for m in range(side)]) for i in range(side) for j in range(side)])
    energy = F.transform(table, lambda row: F.abs(F.aggregate(F.zip_with(row, xs, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))
    high = F.aggregate(masked(F.col("__energy"), [i >= side // 2 and j >= side // 2 for i in range(side) for j in range(side)]), F.lit(0.0), lambda a, x: a + x)
    return energy, high / (F.aggregate(F.col("__energy"), F.lit(0.0), lambda a, x: a + x) + TINY)


def with_dct_share(df: DataFrame, patch: str, out: str, side: int = 8) -> DataFrame:
    energy, share = dct_high_share(F.transform(F.col(patch), lambda x: x.cast("double")), side)
    return df.withColumn("__energy", energy).withColumn(out, share).drop("__energy")


def block_consistency(df: DataFrame, keys: list[str], patch: str, side: int = 8) -> DataFrame:
    """Deviation of the variances of the four quarters, by their mean."""
    cells = pixels(df, keys, patch, side).groupBy(*keys, F.floor(F.col("r") / (side // 2)).alias("br"), F.floor(F.col("c") / (side // 2)).alias("bc"))
    var = cells.agg(F.var_pop("x").alias("v"))
    return var.groupBy(*keys).agg((F.stddev_pop("v") / (F.avg("v") + TINY)).alias("block_consistency"))


def grid_medians(df: DataFrame, keys: list[str], patch: str, parts: int = 2, side: int = 8, least: int = 8) -> DataFrame:
    """Median of each cell of a parts by parts grid with enough pixels."""
    cell = pixels(df, keys, patch, side).withColumn("row", F.floor(F.col("r") / (side // parts)).cast("int")).withColumn("col", F.floor(F.col("c") / (side // parts)).cast("int"))
    return cell.groupBy(*keys, "row", "col").agg(F.median("x").alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def centred(df: DataFrame, keys: list[str], patch: str, side: int = 8) -> DataFrame:
    """Pixels with the median of their patch taken off (removal of the common motion)."""
    rows = pixels(df, keys, patch, side)
    return rows.withColumn("x", F.col("x") - F.median("x").over(Window.partitionBy(*keys)))


def moving_pixels(df: DataFrame, keys: list[str], patch: str, floor: float = 0.10, least: int = 8, side: int = 8) -> DataFrame:
    """Median and spread of the pixels above the upper quartile; nothing if they are few."""
    rows = centred(df, keys, patch, side).withColumn("x", F.abs("x"))
    rows = rows.withColumn("cut", F.greatest(F.percentile("x", F.lit(0.75)).over(Window.partitionBy(*keys)), F.lit(floor))).where("x > cut")
    rows = rows.withColumn("med", F.median("x").over(Window.partitionBy(*keys)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("energy"), F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    return out.where(F.col("n") >= least).withColumn("divergence", F.col("mad") / (F.col("energy") + TINY))


def affine_residual(df: DataFrame, keys: list[str], patch: str, step: int = 3, side: int = 8) -> DataFrame:
    """Median residual of a plane fitted to every ``step``-th pixel, by the median strength.

    On a regular grid rows and columns are uncorrelated, so each slope is a covariance over a
    variance.
    """
    rows = pixels(df, keys, patch, side).where((F.col("r") % step == 0) & (F.col("c") % step == 0))
    w = Window.partitionBy(*keys)
    slope = lambda axis: F.covar_pop(axis, "x").over(w) / F.var_pop(axis).over(w)
    rows = rows.withColumn("fit", F.avg("x").over(w) + slope("r") * (F.col("r") - F.avg("r").over(w)) + slope("c") * (F.col("c") - F.avg("c").over(w)))
    return rows.groupBy(*keys).agg((F.median(F.abs(F.col("x") - F.col("fit"))) / (F.median(F.abs("x")) + 0.08)).alias("affine_residual"))


def detail_ratio(df: DataFrame, patch: str, out: str, side: int = 8) -> DataFrame:
    """Adds fine over coarse detail of a blur pyramid."""
    rows = blurred(blurred(df, patch, "__fine", gaussian(2, 1.0), side), patch, "__coarse", gaussian(5, 2.0), side)
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x) / float(side * side)
    ratio = square(F.col(patch), F.col("__fine")) / (square(F.col("__fine"), F.col("__coarse")) + TINY)
    return rows.withColumn(out, ratio).drop("__fine", "__coarse")
