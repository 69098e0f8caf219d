"""Image operators of any size on rows that hold a whole image: hysteresis edges and cosine spectra.

An image is one array column in row order; all images of a table have one height and width. A
task takes images in Arrow batches as one NumPy block, so memory follows the batch and no
shuffle is needed. Nulls: a null image has null results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.boxes import clip_box, expand_box

#: Thresholds of edges, and the tangent that parts directions (fixed values).
LOW, HIGH = 60, 140
TANGENT = 13573 / (1 << 15)
_BLOCK = 256


def gradients(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical Sobel sums of images (count, height, width), borders repeated."""
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows, columns = images.shape[1:]
    at = lambda r, c: p[:, 1 + r : 1 + r + rows, 1 + c : 1 + c + columns]
    return (
        (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1)),
        (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1)),
    )


def thinned(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Strength of each pixel that is largest across its edge, else 0.

    Beside a pixel stand its neighbours left and right, above and below, or on a diagonal,
    by the direction of the gradient; strengths outside the image are 0.
    """
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, ((0, 0), (1, 1), (1, 1)))
    rows, columns = m.shape[1:]
    at = lambda r, c: p[:, 1 + r : 1 + r + rows, 1 + c : 1 + c + columns]
    x, y = np.abs(gx), np.abs(gy)
    flat, steep = y < x * TANGENT, y > x * (TANGENT + 2)
    same = (gx < 0) == (gy < 0)
    diagonal = np.where(same, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))
    keep = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), diagonal))
    return np.where(keep, m, 0)


def _linked(weak: np.ndarray) -> np.ndarray:
    """Label of each weak pixel: the least place of its component in eight directions.

    Union by the least label of the neighbours, then labels are replaced by their own labels,
    so long edges take a number of rounds like the logarithm of their length.
    """
    count, rows, columns = weak.shape
    n = count * rows * columns
    label = np.where(weak, np.arange(n).reshape(weak.shape), n)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=n)
        least = np.min([p[:, 1 + r : 1 + r + rows, 1 + c : 1 + c + columns] for r in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
        least = np.where(weak, least, n)
        # the root of a pixel takes what any of its pixels has seen
        root = np.append(np.arange(n), n)
        np.minimum.at(root, label.ravel(), least.ravel())
        while not np.array_equal(higher := root[root], root):
            root = higher
        new = root[least]
        if np.array_equal(new, label):
            return label
        label = new


def edges(images: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Edge pixels: thinned ones above ``high``, and those above ``low`` joined to such."""
    m = thinned(*gradients(images))
    weak = m > low
    label = _linked(weak)
    strong = np.zeros(label.size + 1, bool)
    strong[label[m > high]] = True
    return weak & strong[label]


def cosine_basis(side: int) -> np.ndarray:
    """The orthonormal cosine basis, a row per frequency."""
    k, n = np.arange(side)[:, None], np.arange(side)[None, :]
    return np.where(k == 0, math.sqrt(1 / side), math.sqrt(2 / side)) * np.cos(math.pi * (2 * n + 1) * k / (2 * side))


def high_shares(images: np.ndarray) -> np.ndarray:
    """Energy of the high half of both frequencies, by all energy: two matrix products an image."""
    side = images.shape[1]
    basis = cosine_basis(side)
    energy = np.abs(basis @ images @ basis.T)
    return energy[:, side // 2 :, side // 2 :].sum(axis=(1, 2)) / (energy.sum(axis=(1, 2)) + 1e-6)


def _per_image(df: DataFrame, image: str, shape: tuple[int, int], f: Callable[[np.ndarray], list[np.ndarray]], added: str) -> DataFrame:
    """Rows with the double columns ``added`` that f gives for blocks of images."""
    rows = df.withColumn("__image", F.transform(F.col(image), lambda x: x.cast("double")))
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    n = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                column = part.column(part.num_columns - 1)
                there = np.asarray(column.is_valid())
                flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
                if len(flat) != there.sum() * n:
                    raise ValueError(f"images must have {shape[0]} by {shape[1]} pixels")
                out = []
                for values in f(flat.reshape(-1, *shape)):
                    full = np.zeros(part.num_rows)
                    full[there] = values
                    out.append(pa.array(full, pa.float64(), mask=~there))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], schema.names)

    return rows.mapInArrow(run, schema)


def edge_density(df: DataFrame, image: str, shape: tuple[int, int], boxes: dict[str, tuple[int, int, int, int]], low: float = LOW, high: float = HIGH) -> DataFrame:
    """Rows with the share of edge pixels inside each named box (x1, y1, x2, y2) of the image."""

    def f(images: np.ndarray) -> list[np.ndarray]:
        found = edges(images, low, high)
        return [found[:, y1:y2, x1:x2].mean(axis=(1, 2)) for x1, y1, x2, y2 in boxes.values()]

    return _per_image(df, image, shape, f, ", ".join(f"`{name}` double" for name in boxes))


def high_frequency_share(df: DataFrame, image: str, side: int, out: str) -> DataFrame:
    """Rows with the share of high frequencies of square images."""
    return _per_image(df, image, (side, side), lambda images: [high_shares(images)], f"`{out}` double")


def propagated_boxes(pixels: DataFrame, entity: str, x: str, y: str, fx: str, fy: str, box: str, width: int, height: int) -> DataFrame:
    """One row per entity: its box moved by the motion inside it, and the confidence of that.

    Pixels are rows with their motion and the entity's box (a struct). Inside the box, grown a
    little, the median motion is taken off; pixels that then move more than the 60th percentile
    (0.05 at least) move the box by their median motion. Fewer than 18 such pixels leave the box
    where it was, with confidence 0.18; no pixel inside gives 0. A box has a bounded number of
    pixels, so an entity's pixels are one group.
    """
    pixels = pixels.withColumn("__grown", expand_box(F.col(box), 1.08, F.lit(width), F.lit(height)))
    grown = F.col("__grown")
    inside = (F.col(x) >= grown["x1"]) & (F.col(x) < grown["x2"]) & (F.col(y) >= grown["y1"]) & (F.col(y) < grown["y2"])
    rows = pixels.select(entity, F.col(box).alias("b"), F.when(inside, F.col(fx)).alias("fx"), F.when(inside, F.col(fy)).alias("fy"))
    middle = rows.groupBy(entity).agg(F.median("fx").alias("mx"), F.median("fy").alias("my")).withColumnRenamed(entity, "__e")
    rows = rows.join(middle, F.col(entity) == F.col("__e")).drop("__e")
    u, v = F.col("fx") - F.col("mx"), F.col("fy") - F.col("my")
    rows = rows.withColumn("size", F.sqrt(u * u + v * v))
    cut = rows.groupBy(entity).agg(F.greatest(F.percentile("size", F.lit(0.60)), F.lit(0.05)).alias("cut")).withColumnRenamed(entity, "__e")
    moving = F.col("size") > F.col("cut")
    sums = rows.join(cut, F.col(entity) == F.col("__e")).drop("__e").groupBy(entity).agg(
        F.first("b").alias("b"), F.count("size").alias("n"), F.count_if(moving).alias("moving"), *[F.median(F.when(moving, F.col(c))).alias(c) for c in ("fx", "fy", "size")]
    )

    def shifted(of: Column, by: str) -> Column:
        return F.bround(of + F.col(by)).cast("int")

    b = F.col("b")
    new = F.struct(shifted(b["x1"], "fx").alias("x1"), shifted(b["y1"], "fy").alias("y1"), shifted(b["x2"], "fx").alias("x2"), shifted(b["y2"], "fy").alias("y2"))
    sums = sums.withColumn("new", clip_box(new, F.lit(width), F.lit(height)))
    enough = F.col("moving") >= 18
    confidence = F.greatest(F.lit(0.22), F.least(F.lit(0.62), 0.28 + 0.90 * F.col("size")))
    return sums.select(
        entity, *[F.when(enough, F.col("new")[c]).otherwise(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.when(F.col("n") == 0, 0.0).when(enough, confidence).otherwise(0.18).alias("confidence"),
    )
