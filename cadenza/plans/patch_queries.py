"""Queries over 8 by 8 image patches (the 64 coordinates of an embedding)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import TINY
from ..operators import patches, scoring
from .registry import query, rounded
from .views import EV, PX, clip, sig, vectors

SIDE = 8
FACE = (2, 2, 6, 6)


def _conv(kernel: dict, e: str = "e") -> str:
    """SQL list of the convolved patch."""
    out = []
    for r in range(SIDE):
        for c in range(SIDE):
            terms = [f"{float(w)}::DOUBLE * {e}[{patches.mirrored(r + dr, SIDE) * SIDE + patches.mirrored(c + dc, SIDE) + 1}]" for (dr, dc), w in sorted(kernel.items()) if w]
            out.append(" + ".join(terms))
    return "[" + ", ".join(out) + "]"


def _square(radius: int, sigma: float) -> dict[tuple[int, int], float]:
    one = patches.gaussian(radius, sigma)
    return {(r - radius, c - radius): one[r] * one[c] for r in range(len(one)) for c in range(len(one))}


def _pixels_of(name: str, source: str, array: str) -> str:
    return f"{name} AS (SELECT vec_id, label, k, k // 8 AS r, k % 8 AS c, {array}[k + 1] AS x FROM {source}, range(0, 64) q(k))"


_LAP = f"{EV}, la AS (SELECT vec_id, label, e, {_conv(patches.LAPLACE)} AS l FROM ev), {_pixels_of('lp', 'la', 'l')}"


@query(f"WITH {_LAP} SELECT vec_id, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(kurtosis_pop(x), 4) AS kurt FROM lp GROUP BY vec_id")
def patch_laplacian(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the Laplacian."""
    rows = vectors(spark, d).select("vec_id", patches.convolved(F.col("e"), patches.LAPLACE).alias("l"))
    rows = rows.withColumn("mean", patches.array_mean(F.col("l"))).withColumn("variance", patches.array_variance(F.col("l")))
    rows = rows.withColumn("kurt", F.round(patches.array_kurtosis(F.col("l"), F.col("mean"), F.col("variance")), 4))
    return rounded(rows.drop("l"))


@query(f"WITH {EV}, sr AS (SELECT vec_id, label, {_conv(patches.HIGH_PASS)} AS s FROM ev), {_pixels_of('sp', 'sr', 's')} SELECT vec_id, round(var_pop(x), 6) AS noise_variance FROM sp GROUP BY vec_id")
def patch_srm(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", patches.convolved(F.col("e"), patches.HIGH_PASS).alias("s"))
    return rounded(rows.select("vec_id", patches.array_variance(F.col("s")).alias("noise_variance")))


@query(f"WITH {EV}, so AS (SELECT vec_id, label, {_conv(patches.SOBEL_X)} AS gx, {_conv(patches.SOBEL_Y)} AS gy FROM ev) SELECT vec_id, round(avg(sqrt(gx[k + 1] * gx[k + 1] + gy[k + 1] * gy[k + 1])), 6) AS gradient FROM so, range(0, 64) q(k) GROUP BY vec_id")
def patch_sobel(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", patches.convolved(F.col("e"), patches.SOBEL_X).alias("gx"), patches.convolved(F.col("e"), patches.SOBEL_Y).alias("gy"))
    size = F.zip_with("gx", "gy", lambda a, b: F.sqrt(a * a + b * b))
    return rounded(rows.select("vec_id", patches.array_mean(size).alias("gradient")))


_BASIS = [[(math.sqrt(1 / SIDE) if k == 0 else math.sqrt(2 / SIDE)) * math.cos(math.pi * (2 * n + 1) * k / (2 * SIDE)) for n in range(SIDE)] for k in range(SIDE)]
_DCT = f"{PX}, bs AS (SELECT unnest({[x for row in _BASIS for x in row]}::DOUBLE[]) AS w, unnest(range(0, 64)) AS q), rw AS (SELECT vec_id, q // 8 AS i, c, sum(w * x) AS t FROM px JOIN bs ON bs.q % 8 = px.r GROUP BY ALL), dc AS (SELECT vec_id, i, q // 8 AS j, abs(sum(w * t)) AS a FROM rw JOIN bs ON bs.q % 8 = rw.c GROUP BY ALL)"


@query(f"WITH {_DCT} SELECT vec_id, round(sum(CASE WHEN i >= 4 AND j >= 4 THEN a ELSE 0 END) / (sum(a) + 1e-6), 6) AS high_share FROM dc GROUP BY vec_id")
def patch_dct_hf(spark: SparkSession, d: str) -> DataFrame:
    """Share of high frequencies in the cosine spectrum."""
    return rounded(patches.with_dct_share(vectors(spark, d), "e", "high_share").select("vec_id", "high_share"))


_MASKS = patches.region_masks(SIDE, FACE)


def _in(name: str) -> str:
    return "k IN (" + ", ".join(str(k) for k, ok in enumerate(_MASKS[name]) if ok) + ")"


@query(f"WITH {_LAP} SELECT vec_id, round(avg(x) FILTER ({_in('inner')}), 6) AS inner_mean, round(avg(x) FILTER ({_in('ring')}), 6) AS ring_mean, round(var_pop(x) FILTER ({_in('inner')}), 6) AS inner_variance, round(var_pop(x) FILTER ({_in('ring')}), 6) AS ring_variance FROM lp GROUP BY vec_id")
def patch_region_means(spark: SparkSession, d: str) -> DataFrame:
    """Laplacian inside a box and in the ring around it."""
    rows = vectors(spark, d).select("vec_id", patches.convolved(F.col("e"), patches.LAPLACE).alias("l"))
    part = lambda name: patches.masked(F.col("l"), _MASKS[name])
    return rounded(rows.select("vec_id", *[f(part(n)).alias(f"{n}_{m}") for n in ("inner", "ring") for m, f in (("mean", patches.array_mean), ("variance", patches.array_variance))]))


@query(f"WITH {PX}, q AS (SELECT vec_id, r // 4 AS br, c // 4 AS bc, var_pop(x) AS v FROM px GROUP BY ALL) SELECT vec_id, round(stddev_pop(v) / (avg(v) + 1e-6), 6) AS block_consistency FROM q GROUP BY vec_id")
def patch_block_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(patches.block_consistency(vectors(spark, d), ["vec_id"], "e"))


@query(f"WITH {PX} SELECT a.vec_id, round(avg(abs(a.x - b.x)) / (0.5 * (2 * avg(abs(a.x)) + 1e-6)), 6) AS asymmetry FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.r = b.r AND b.c = 7 - a.c GROUP BY a.vec_id")
def patch_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors(spark, d).select("vec_id", patches.asymmetry(F.col("e")).alias("asymmetry")))


@query(f'WITH {PX} SELECT vec_id, CAST(r // 4 AS INT) AS "row", CAST(c // 4 AS INT) AS col, round(median(x), 6) AS median FROM px GROUP BY ALL')
def patch_grid_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(patches.grid_medians(vectors(spark, d), ["vec_id"], "e"))


@query(
    f"WITH {PX}, ce AS (SELECT vec_id, abs(x - median(x) OVER (PARTITION BY vec_id)) AS x FROM px), cu AS (SELECT vec_id, x, greatest(quantile_cont(x, 0.75) OVER (PARTITION BY vec_id), 0.10) AS cut FROM ce), "
    "mo AS (SELECT vec_id, x, median(x) OVER (PARTITION BY vec_id) AS med FROM cu WHERE x > cut) SELECT vec_id, count(*) AS n, round(median(x), 6) AS energy, round(median(abs(x - med)), 6) AS mad, round(median(abs(x - med)) / (median(x) + 1e-6), 6) AS divergence FROM mo GROUP BY vec_id HAVING count(*) >= 8"
)
def patch_moving(spark: SparkSession, d: str) -> DataFrame:
    """Strength and spread of the pixels that move."""
    return rounded(patches.moving_pixels(vectors(spark, d), ["vec_id"], "e"))


@query(
    f"WITH {PX}, s AS (SELECT vec_id, r, c, x, avg(x) OVER w AS mx, avg(r) OVER w AS mr, avg(c) OVER w AS mc FROM px WHERE r % 3 = 0 AND c % 3 = 0 WINDOW w AS (PARTITION BY vec_id)), "
    "b AS (SELECT vec_id, covar_pop(x, r) / var_pop(r) AS br, covar_pop(x, c) / var_pop(c) AS bc FROM s GROUP BY vec_id) "
    "SELECT s.vec_id, round(median(abs(x - (mx + br * (r - mr) + bc * (c - mc)))) / (median(abs(x)) + 0.08), 6) AS affine_residual FROM s JOIN b ON s.vec_id = b.vec_id GROUP BY s.vec_id"
)
def patch_affine_residual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(patches.affine_residual(vectors(spark, d), ["vec_id"], "e"))


@query(
    f"WITH {EV}, g AS (SELECT vec_id, e, {_conv(_square(2, 1.0))} AS f, {_conv(_square(5, 2.0))} AS h FROM ev) SELECT vec_id, round(avg((e[k + 1] - f[k + 1]) * (e[k + 1] - f[k + 1])) / (avg((f[k + 1] - h[k + 1]) * (f[k + 1] - h[k + 1])) + 1e-6), 6) AS detail_ratio FROM g, range(0, 64) q(k) GROUP BY vec_id"
)
def patch_detail_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Fine over coarse detail of a blur pyramid."""
    return rounded(patches.detail_ratio(vectors(spark, d), "e", "detail_ratio").select("vec_id", "detail_ratio"))


@query(
    f"WITH {_LAP} SELECT a.vec_id, round(coalesce(covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0), 0), 6) AS cross_correlation FROM lp a JOIN lp b ON a.vec_id = b.vec_id AND b.k = (a.k + 1) % 64 GROUP BY a.vec_id"
)
def patch_crosschannel_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the Laplacian with a shifted channel."""
    rows = vectors(spark, d).select("vec_id", patches.convolved(F.col("e"), patches.LAPLACE).alias("l"))
    pairs = rows.select("vec_id", F.explode(F.arrays_zip(F.col("l").alias("a"), F.concat(F.slice("l", 2, 63), F.slice("l", 1, 1)).alias("b"))).alias("p"))
    from ..operators.series import guarded_correlation

    return rounded(pairs.groupBy("vec_id").agg(guarded_correlation(F.col("p.a"), F.col("p.b")).alias("cross_correlation")))


_WEIGHTS = scoring.FREQUENCY
_PARTS = {"lap_kurtosis_cv": "kcv", "lap_kurtosis_mean": "km", "lap_var_temporal_cv": "vcv", "block_lap_consistency": "bl"}


@query(
    f"WITH {_LAP}, mo AS (SELECT vec_id, label, var_pop(x) AS v, kurtosis_pop(x) AS q FROM lp GROUP BY vec_id, label), bk AS (SELECT vec_id, label, stddev_pop(v) / (avg(v) + 1e-6) AS b FROM (SELECT vec_id, label, r // 4 AS br, c // 4 AS bc, var_pop(x) AS v FROM px GROUP BY ALL) GROUP BY ALL), "
    .replace("WITH " + EV, "WITH " + PX)
    + "ag AS (SELECT mo.label, stddev_pop(q) / (abs(avg(q)) + 1e-6) AS kcv, avg(q) AS km, stddev_pop(v) / (avg(v) + 1e-6) AS vcv, avg(b) AS bl FROM mo JOIN bk ON mo.vec_id = bk.vec_id GROUP BY mo.label) "
    + "SELECT label, round("
    + clip(
        "(" + " + ".join(f"CASE WHEN {c} > 0 THEN {_WEIGHTS[n][0]} * {sig(c, *_WEIGHTS[n][1:])} ELSE 0 END" for n, c in _PARTS.items()) + ") / greatest(" + " + ".join(f"CASE WHEN {c} > 0 THEN {_WEIGHTS[n][0]} ELSE 0 END" for n, c in _PARTS.items()) + ", 1e-6)"
    )
    + ", 5) AS frequency_score FROM ag"
)
def frequency_score_l5(spark: SparkSession, d: str) -> DataFrame:
    """Frequency level of each group of patches, over the components at hand."""
    rows = vectors(spark, d).withColumn("l", patches.convolved(F.col("e"), patches.LAPLACE))
    rows = rows.withColumn("m", patches.array_mean(F.col("l"))).withColumn("v", patches.array_variance(F.col("l")))
    rows = rows.withColumn("q", patches.array_kurtosis(F.col("l"), F.col("m"), F.col("v")))
    blocks = patches.block_consistency(rows, ["vec_id"], "e")
    g = rows.join(blocks, "vec_id").groupBy("label").agg(
        (F.stddev_pop("q") / (F.abs(F.avg("q")) + TINY)).alias("lap_kurtosis_cv"), F.avg("q").alias("lap_kurtosis_mean"),
        (F.stddev_pop("v") / (F.avg("v") + TINY)).alias("lap_var_temporal_cv"), F.avg("block_consistency").alias("block_lap_consistency"),
    )
    values = {n: F.col(n) if n in _PARTS else F.lit(0.0) for n in _WEIGHTS}
    return rounded(g.select("label", scoring.frequency_score(values, F.lit(1.0)).alias("frequency_score")), 5)
