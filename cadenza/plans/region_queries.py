"""Queries over regions of 8 by 8 patches; channels, flow and the second image are fixed
arithmetic over a patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import patches, regions, series
from .patch_queries import FACE, SIDE, _conv, _in, _MASKS
from .registry import query, rounded
from .views import EV, table, vectors

WIDE = regions.widened(FACE, 1, SIDE)
REGIONS = {name: [k for k, ok in enumerate(mask) if ok] for name, mask in _MASKS.items()} | {
    "context": regions.places(SIDE, WIDE, FACE),
    "border": regions.places(SIDE, WIDE, regions.widened(FACE, -1, SIDE)),
}


def _at(region: str, value: str, f: str = "avg") -> str:
    return f"{f}({value}) FILTER (k IN ({', '.join(map(str, REGIONS[region]))}))"


def _rel() -> F.Column:
    return 0.5 + F.lit(0.05) * F.col("label")


_REL = "0.5::DOUBLE + 0.05::DOUBLE * label"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, rel, k, x and three channels."""
    rows = vectors(spark, d).select("vec_id", _rel().alias("rel"), F.posexplode("e").alias("k", "x"))
    c, r = F.col("k") % SIDE - 3.5, F.floor(F.col("k") / SIDE) - 3.5
    return rows.select("*", (40 * F.col("x")).alias("c0"), (40 * F.col("x") * c).alias("c1"), (40 * F.col("x") * r).alias("c2"))


_PIX = f"{EV}, p AS (SELECT vec_id, {_REL} AS rel, k, e[k + 1] AS x, 40 * e[k + 1] AS c0, 40 * e[k + 1] * (k % 8 - 3.5::DOUBLE) AS c1, 40 * e[k + 1] * (k // 8 - 3.5::DOUBLE) AS c2 FROM ev, range(0, 64) q(k))"


@query(
    f"WITH {_PIX}, g AS (SELECT vec_id, rel, "
    + ", ".join(f"{_at('inner', f'c{i}')} - {_at('ring', f'c{i}')} AS g{i}, {_at('inner', f'c{i}')} - {_at('context', f'c{i}')} AS h{i}" for i in range(3))
    + " FROM p GROUP BY vec_id, rel) SELECT vec_id, round((abs(g0) / 80.0::DOUBLE + 0.22::DOUBLE * sqrt(g1 * g1 + g2 * g2) / 60.0::DOUBLE) * (0.35::DOUBLE + 0.65::DOUBLE * rel), 6) AS relight, "
    "round(sqrt(h1 * h1 + h2 * h2) * rel, 6) AS chroma, round(sqrt(g0 * g0 + g1 * g1 + g2 * g2) / 135.0::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * rel), 6) AS distance FROM g"
)
def region_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colour of a box against its ring and context."""
    return rounded(regions.color_distances(pixels(spark, d), ["vec_id"], "rel", ("c0", "c1", "c2"), REGIONS["inner"], REGIONS["ring"], REGIONS["context"]))


@query(
    f"WITH {EV}, s AS (SELECT vec_id, {_REL} AS rel, {_conv(patches.SOBEL_X)} AS gx, {_conv(patches.SOBEL_Y)} AS gy, {_conv(patches.LAPLACE)} AS l FROM ev), "
    "p AS (SELECT vec_id, rel, k, sqrt(gx[k + 1] * gx[k + 1] + gy[k + 1] * gy[k + 1]) AS g, abs(l[k + 1]) AS h FROM s, range(0, 64) q(k)) "
    f"SELECT vec_id, round((0.22::DOUBLE + 0.78::DOUBLE * rel) * ({_at('band', 'g')} / (0.55::DOUBLE * {_at('inner', 'g')} + 0.45::DOUBLE * {_at('ring', 'g')} + 1e-6)), 6) AS seam, "
    f"round((0.20::DOUBLE + 0.80::DOUBLE * rel) * ln(({_at('inner', 'h')} + 1e-6) / ({_at('ring', 'h')} + 1e-6)), 6) AS detail, round({_at('border', 'g')}, 6) AS border FROM p GROUP BY vec_id, rel"
)
def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """Gradient and fine detail of a box, its band and its ring."""
    rows = vectors(spark, d).select("vec_id", _rel().alias("rel"), *[patches.convolved(F.col("e"), kernel).alias(n) for n, kernel in (("gx", patches.SOBEL_X), ("gy", patches.SOBEL_Y), ("l", patches.LAPLACE))])
    size = F.zip_with("gx", "gy", lambda a, b: F.sqrt(a * a + b * b))
    rows = rows.select("vec_id", "rel", F.posexplode(F.arrays_zip(size.alias("g"), F.col("l").alias("h"))).alias("k", "s")).select("vec_id", "rel", "k", "s.g", "s.h")
    return rounded(regions.edge_relations(rows, ["vec_id"], "rel", "g", "h", *(REGIONS[n] for n in ("inner", "band", "ring", "border"))))


@query(
    f"WITH {_PIX}, m AS (SELECT vec_id, rel, k, c1 / 20.0::DOUBLE - median(c1 / 20.0::DOUBLE) OVER w AS u, c2 / 20.0::DOUBLE - median(c2 / 20.0::DOUBLE) OVER w AS w FROM p WINDOW w AS (PARTITION BY vec_id)), "
    "s AS (SELECT *, sqrt(u * u + w * w) AS z FROM m), "
    f"n AS (SELECT vec_id, rel, {_at('inner', 'u', 'median')} - {_at('context', 'u', 'median')} AS du, {_at('inner', 'w', 'median')} - {_at('context', 'w', 'median')} AS dw, {_at('inner', 'z', 'median')} AS a, {_at('context', 'z', 'median')} AS b FROM s GROUP BY vec_id, rel), "
    f"o AS (SELECT s.vec_id, {_at('inner', 'abs(z - a)', 'median')} + {_at('context', 'abs(z - b)', 'median')} AS spread FROM s JOIN n ON s.vec_id = n.vec_id GROUP BY s.vec_id) "
    "SELECT n.vec_id, round(CASE WHEN a >= 0.04 OR b >= 0.04 THEN rel * sqrt(du * du + dw * dw) / (0.18::DOUBLE + 0.55::DOUBLE * a + 0.25::DOUBLE * b + spread) END, 6) AS seam FROM n JOIN o ON n.vec_id = o.vec_id"
)
def region_flow_seam(spark: SparkSession, d: str) -> DataFrame:
    """Motion of a box against the band around it."""
    rows = pixels(spark, d).withColumn("u", F.col("c1") / 20.0).withColumn("w", F.col("c2") / 20.0)
    return rounded(regions.flow_seam(rows.select("vec_id", "rel", "k", F.col("u").alias("fx"), F.col("w").alias("fy")), ["vec_id"], "rel", "fx", "fy", REGIONS["inner"], REGIONS["context"]))


_NEXT = "e[(k * 5) % 64 + 1]"


@query(
    f"WITH {EV}, p AS (SELECT vec_id, {_REL} AS rel, e, k, e[64 - k] AS q, least(greatest(k % 8 + 3 * e[k + 1], 0.0::DOUBLE), 7.0::DOUBLE) AS mx, least(greatest(k // 8 + 3 * {_NEXT}, 0.0::DOUBLE), 7.0::DOUBLE) AS my FROM ev, range(0, 64) z(k) WHERE {_in('inner')}), "
    "f AS (SELECT *, CAST(floor(mx) AS BIGINT) AS x1, CAST(floor(my) AS BIGINT) AS y1, least(CAST(floor(mx) AS BIGINT) + 1, 7) AS x2, least(CAST(floor(my) AS BIGINT) + 1, 7) AS y2 FROM p), "
    "w AS (SELECT vec_id, rel, q, (1.0::DOUBLE - (my - y1)) * ((1.0::DOUBLE - (mx - x1)) * e[y1 * 8 + x1 + 1] + (mx - x1) * e[y1 * 8 + x2 + 1]) + (my - y1) * ((1.0::DOUBLE - (mx - x1)) * e[y2 * 8 + x1 + 1] + (mx - x1) * e[y2 * 8 + x2 + 1]) AS m FROM f) "
    "SELECT vec_id, round(rel * avg(abs(m - q)) / (stddev_pop(q) + 0.5::DOUBLE), 6) AS warp_error FROM w GROUP BY vec_id, rel"
)
def region_warp_error(spark: SparkSession, d: str) -> DataFrame:
    """A box of the mirrored patch predicted from the patch along a flow."""
    rows = vectors(spark, d).select(
        "vec_id", _rel().alias("rel"), "e", F.reverse("e").alias("q"), F.transform("e", lambda x: 3 * x).alias("u"), F.array(*[3 * F.col("e")[(k * 5) % 64] for k in range(64)]).alias("w")
    )
    return rounded(regions.warp_error(rows, ["vec_id"], "rel", "e", "q", "u", "w", REGIONS["inner"]))


_CHANNELS = f"{EV}, ch AS (SELECT vec_id, e AS cr, list_reverse(e) AS cg, list_transform(range(0, 64), lambda k: e[(k * 5) % 64 + 1]) AS cb FROM ev)"


@query(
    f"WITH {_CHANNELS}, la AS (SELECT vec_id, {_conv(patches.LAPLACE, 'cr')} AS r, {_conv(patches.LAPLACE, 'cg')} AS g, {_conv(patches.LAPLACE, 'cb')} AS b FROM ch), "
    "p AS (SELECT vec_id, r[k + 1] AS r, g[k + 1] AS g, b[k + 1] AS b FROM la, range(0, 64) q(k)) "
    "SELECT vec_id, round(var_pop(r), 6) AS red_variance, round(var_pop(g), 6) AS green_variance, round(var_pop(b), 6) AS blue_variance, round(coalesce(covar_pop(r, b) / nullif(stddev_pop(r) * stddev_pop(b), 0), 0), 6) AS red_blue_correlation FROM p GROUP BY vec_id"
)
def patch_channels(spark: SparkSession, d: str) -> DataFrame:
    """Laplacian variance of three channels, and the correlation of the first and the last."""
    e = F.col("e")
    rows = vectors(spark, d).select("vec_id", *[patches.convolved(c, patches.LAPLACE).alias(n) for n, c in (("r", e), ("g", F.reverse(e)), ("b", F.array(*[e[(k * 5) % 64] for k in range(64)])))])
    rows = rows.select("vec_id", F.explode(F.arrays_zip("r", "g", "b")).alias("p")).select("vec_id", "p.*")
    return rounded(rows.groupBy("vec_id").agg(F.var_pop("r").alias("red_variance"), F.var_pop("g").alias("green_variance"), F.var_pop("b").alias("blue_variance"), series.guarded_correlation(F.col("r"), F.col("b")).alias("red_blue_correlation")))


@query(
    "WITH b AS (SELECT p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS x1, p_partkey % 40 AS y1, p_size + 30 + p_partkey % 50 AS x2, p_partkey % 40 + 35 + p_size % 21 AS y2 FROM part), "
    "m AS (SELECT p_brand, count(x1) AS n, count(*) AS t, CAST(floor(median(x1)) AS INT) AS x1, CAST(floor(median(CASE WHEN x1 IS NOT NULL THEN y1 END)) AS INT) AS y1, CAST(floor(median(CASE WHEN x1 IS NOT NULL THEN x2 END)) AS INT) AS x2, CAST(floor(median(CASE WHEN x1 IS NOT NULL THEN y2 END)) AS INT) AS y2 FROM b GROUP BY p_brand) "
    "SELECT p_brand, n, x1, y1, x2, y2 FROM m WHERE n >= greatest(4.0::DOUBLE, t * 0.5::DOUBLE) AND x2 - x1 >= 40 AND y2 - y1 >= 40"
)
def median_box(spark: SparkSession, d: str) -> DataFrame:
    """The median box of each brand's parts, where two of three have one."""
    c = F.col
    found = c("p_partkey") % 3 > 0
    rows = table(spark, d, "part").select(
        "p_brand", F.when(found, c("p_size")).alias("x1"), F.when(found, c("p_partkey") % 40).alias("y1"), F.when(found, c("p_size") + 30 + c("p_partkey") % 50).alias("x2"), F.when(found, c("p_partkey") % 40 + 35 + c("p_size") % 21).alias("y2")
    )
    totals = rows.groupBy("p_brand").agg(F.count("*").alias("total"))
    return regions.median_box(rows.join(totals, "p_brand"), "p_brand", "total")
