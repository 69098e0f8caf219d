"""Relations of image regions: colour, edges, fine detail and motion of a box and its surroundings.

Pixels are rows ``keys, k, ...`` with the place in the patch; a region is a fixed list of
places, so every relation is one grouped aggregation with conditional means or medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import TINY

Box = tuple[int, int, int, int]


def places(side: int, outer: Box, without: Box | None = None) -> list[int]:
    """Places of a box, those of another box left out."""
    inside = lambda b, k: b[0] <= k % side < b[2] and b[1] <= k // side < b[3]
    return [k for k in range(side * side) if inside(outer, k) and not (without and inside(without, k))]


def widened(box: Box, by: int, side: int) -> Box:
    """A box with ``by`` pixels more on each side (fewer if negative), inside the patch."""
    return max(0, box[0] - by), max(0, box[1] - by), min(side, box[2] + by), min(side, box[3] + by)


def over(region: list[int], value: Column | str) -> Column:
    """The value at places of a region, else null."""
    return F.when(F.col("k").isin(*region), F.col(value) if isinstance(value, str) else value)


def color_distances(pixels: DataFrame, keys: list[str], rel: str, channels: tuple[str, str, str], inner: list[int], ring: list[int], context: list[int]) -> DataFrame:
    """relight: light and colour shift of a box against its ring; chroma: distance of two
    colours from the context; distance: of all three channels from the ring."""
    gap = [(F.avg(over(inner, c)) - F.avg(over(ring, c))) for c in channels]
    far = [(F.avg(over(inner, c)) - F.avg(over(context, c))) for c in channels[1:]]
    norm = lambda parts: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    sums = pixels.groupBy(*keys, rel).agg(F.abs(gap[0]).alias("light"), norm(gap[1:]).alias("hue"), norm(far).alias("far"), norm(gap).alias("all"))
    r = F.col(rel)
    return sums.select(
        *keys, ((F.col("light") / 80.0 + 0.22 * F.col("hue") / 60.0) * (0.35 + 0.65 * r)).alias("relight"), (F.col("far") * r).alias("chroma"), (F.col("all") / 135.0 * (0.25 + 0.75 * r)).alias("distance")
    )


def edge_relations(pixels: DataFrame, keys: list[str], rel: str, gradient: str, detail: str, inner: list[int], band: list[int], ring: list[int], border: list[int]) -> DataFrame:
    """seam: gradient on the band against inside and ring; detail: log ratio of fine detail
    inside and on the ring; border: mean gradient along the edge of the box."""
    g = lambda region: F.avg(over(region, gradient))
    h = lambda region: F.avg(over(region, F.abs(F.col(detail)))) + TINY
    sums = pixels.groupBy(*keys, rel).agg((g(band) / (0.55 * g(inner) + 0.45 * g(ring) + TINY)).alias("s"), F.log(h(inner) / h(ring)).alias("d"), g(border).alias("border"))
    return sums.select(*keys, ((0.22 + 0.78 * F.col(rel)) * F.col("s")).alias("seam"), ((0.20 + 0.80 * F.col(rel)) * F.col("d")).alias("detail"), "border")


def flow_seam(pixels: DataFrame, keys: list[str], rel: str, x: str, y: str, inner: list[int], band: list[int]) -> DataFrame:
    """Distance of the median motions of a box and its band, by how strong and how spread they
    are; null where neither moves."""
    whole = Window.partitionBy(*keys)
    rows = pixels.withColumn("u", F.col(x) - F.median(x).over(whole)).withColumn("w", F.col(y) - F.median(y).over(whole))
    rows = rows.withColumn("size", F.sqrt(F.col("u") * F.col("u") + F.col("w") * F.col("w")))
    for name, region in (("in", inner), ("on", band)):
        rows = rows.withColumn(f"med_{name}", F.median(over(region, "size")).over(whole))
    part = {(n, c): F.median(over(region, c)) for n, region in (("in", inner), ("on", band)) for c in ("u", "w")}
    gap = [part["in", c] - part["on", c] for c in ("u", "w")]
    spread = [F.median(over(region, F.abs(F.col("size") - F.col(f"med_{n}")))) for n, region in (("in", inner), ("on", band))]
    sums = rows.groupBy(*keys, rel).agg(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]).alias("gap"), F.max("med_in").alias("a"), F.max("med_on").alias("b"), (spread[0] + spread[1]).alias("spread"))
    ref = 0.18 + 0.55 * F.col("a") + 0.25 * F.col("b") + F.col("spread")
    return sums.select(*keys, F.when((F.col("a") >= 0.04) | (F.col("b") >= 0.04), F.col(rel) * F.col("gap") / ref).alias("seam"))


def warp_error(frames: DataFrame, keys: list[str], rel: str, first: str, second: str, x: str, y: str, inner: list[int], side: int = 8) -> DataFrame:
    """Error of a box of the second image predicted by moving the first along the flow
    (bilinear), by the deviation of the box. Images and flow are arrays in row order."""
    rows = frames.select(*keys, rel, F.col(first).alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(second)[k].alias("q"), F.col(x)[k].alias("u"), F.col(y)[k].alias("w")) for k in inner])).alias("s"))
    rows = rows.select(*keys, rel, "p", "s.*")
    for name, start in (("u", F.col("k") % side), ("w", F.floor(F.col("k") / side))):
        at = F.least(F.greatest(start + F.col(name), F.lit(0.0)), F.lit(float(side - 1)))
        rows = rows.withColumn(f"{name}0", at).withColumn(f"{name}1", F.floor(at).cast("int")).withColumn(f"{name}2", F.least(F.floor(at).cast("int") + 1, F.lit(side - 1)))
    fu, fw = F.col("u0") - F.col("u1"), F.col("w0") - F.col("w1")
    pixel = lambda r, c: F.get("p", F.col(r) * side + F.col(c))
    moved = (1.0 - fw) * ((1.0 - fu) * pixel("w1", "u1") + fu * pixel("w1", "u2")) + fw * ((1.0 - fu) * pixel("w2", "u1") + fu * pixel("w2", "u2"))
    sums = rows.withColumn("off", F.abs(moved - F.col("q"))).groupBy(*keys, rel).agg(F.avg("off").alias("off"), F.stddev_pop("q").alias("sd"))
    return sums.select(*keys, (F.col(rel) * F.col("off") / (F.col("sd") + 0.5)).alias("warp_error"))


def median_box(boxes: DataFrame, entity: str, total: str, coordinates: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), least: int = 4, share: float = 0.5, width: int = 40) -> DataFrame:
    """The median box of an entity, if it was found often enough and is large enough.

    total: column with the number of frames looked at; rows without a box have null coordinates.
    """
    out = boxes.groupBy(entity).agg(F.count(coordinates[0]).alias("n"), F.max(total).alias("total"), *[F.floor(F.median(c)).cast("int").alias(c) for c in coordinates])
    x1, y1, x2, y2 = (F.col(c) for c in coordinates)
    return out.where((F.col("n") >= F.greatest(F.lit(float(least)), F.col("total") * share)) & (x2 - x1 >= width) & (y2 - y1 >= width)).drop("total")
