"""Queries over images made of embeddings: grey patches, and 64 vectors as one image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import boxes, colors
from ..operators import images
from .registry import query, rounded
from .views import EV, vectors

_BOXES = {"whole": (0, 0, 8, 8), "inner": (2, 2, 6, 6), "top": (0, 0, 8, 3)}


def _at(dr: int, dc: int) -> str:
    """SQL of a neighbour's grey level, borders repeated."""
    return f"g[least(greatest(r + {dr}, 0), 7) * 8 + least(greatest(c + {dc}, 0), 7) + 1]"


def _m(dr: int, dc: int) -> str:
    """SQL of a neighbour's strength, 0 outside."""
    return f"(CASE WHEN r + {dr} BETWEEN 0 AND 7 AND c + {dc} BETWEEN 0 AND 7 THEN ms[(r + {dr}) * 8 + c + {dc} + 1] ELSE 0 END)"


_T = f"{images.TANGENT!r}::DOUBLE"
_EDGES = (
    f"{EV}, gr AS (SELECT vec_id, list_transform(e, lambda x: least(greatest(floor(x * 400::DOUBLE + 128), 0), 255)) AS g FROM ev), px AS (SELECT vec_id, g, k, k // 8 AS r, k % 8 AS c FROM gr, range(0, 64) q(k)), "
    f"gd AS (SELECT vec_id, k, r, c, ({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)}) - ({_at(-1, -1)} + 2 * {_at(0, -1)} + {_at(1, -1)}) AS gx, ({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)}) - ({_at(-1, -1)} + 2 * {_at(-1, 0)} + {_at(-1, 1)}) AS gy FROM px), "
    "ml AS (SELECT vec_id, list(abs(gx) + abs(gy) ORDER BY k) AS ms FROM gd GROUP BY vec_id), "
    "mm AS (SELECT gd.*, ms, abs(gx) + abs(gy) AS m FROM gd JOIN ml ON gd.vec_id = ml.vec_id), "
    f"th AS (SELECT vec_id, r, c, m FROM mm WHERE CASE WHEN abs(gy) < abs(gx) * {_T} THEN m > {_m(0, -1)} AND m >= {_m(0, 1)} WHEN abs(gy) > abs(gx) * ({_T} + 2) THEN m > {_m(-1, 0)} AND m >= {_m(1, 0)} "
    f"WHEN (gx < 0) = (gy < 0) THEN m > {_m(-1, -1)} AND m > {_m(1, 1)} ELSE m > {_m(-1, 1)} AND m > {_m(1, -1)} END AND m > {images.LOW}), "
    f"ed AS (SELECT vec_id, r, c FROM th WHERE m > {images.HIGH} UNION SELECT th.vec_id, th.r, th.c FROM ed JOIN th ON th.vec_id = ed.vec_id AND abs(th.r - ed.r) <= 1 AND abs(th.c - ed.c) <= 1)"
)


@query(
    f"WITH RECURSIVE {_EDGES} SELECT ev.vec_id, "
    + ", ".join(f"round(count(ed.r) FILTER (ed.c >= {x1} AND ed.c < {x2} AND ed.r >= {y1} AND ed.r < {y2}) / {(x2 - x1) * (y2 - y1)}::DOUBLE, 6) AS \"{n}\"" for n, (x1, y1, x2, y2) in _BOXES.items())
    + " FROM ev LEFT JOIN ed ON ev.vec_id = ed.vec_id GROUP BY ev.vec_id"
)
def edge_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Share of hysteresis edges in parts of each grey patch."""
    grey = F.transform("e", lambda x: F.least(F.greatest(F.floor(x * 400.0 + 128), F.lit(0)), F.lit(255)).cast("int"))
    return rounded(images.edge_density(vectors(spark, d).select("vec_id", grey.alias("g")), "g", (8, 8), _BOXES).drop("g"))


@query(
    f"WITH {EV}, im AS (SELECT vec_id // 64 AS image, vec_id % 64 AS r, e FROM ev), fu AS (SELECT image FROM im GROUP BY image HAVING count(DISTINCT r) = 64 AND count(*) = 64), "
    "cb AS (SELECT k, n, (CASE WHEN k = 0 THEN sqrt(1 / 64::DOUBLE) ELSE sqrt(2 / 64::DOUBLE) END) * cos(pi() * (2 * n + 1) * k / 128::DOUBLE) AS b FROM range(64) a(k), range(64) q(n)), "
    "px AS (SELECT im.image, r, n AS c, e[n + 1] AS x FROM im JOIN fu ON im.image = fu.image, range(64) q(n)), "
    "ha AS (SELECT image, r, k AS l, sum(x * b) AS y FROM px JOIN cb ON cb.n = px.c GROUP BY ALL), dc AS (SELECT image, cb.k, l, abs(sum(y * b)) AS d FROM ha JOIN cb ON cb.n = ha.r GROUP BY image, cb.k, l) "
    "SELECT image, round(sum(d) FILTER (k >= 32 AND l >= 32) / (sum(d) + 1e-6), 6) AS high FROM dc GROUP BY image"
)
def dct_high_share_64(spark: SparkSession, d: str) -> DataFrame:
    """Share of high frequencies of images of 64 vectors each."""
    rows = vectors(spark, d).select(F.floor(F.col("vec_id") / 64).alias("image"), (F.col("vec_id") % 64).alias("r"), "e")
    # an image is 64 rows; a longer list would not be one
    whole = rows.groupBy("image").agg(F.count_distinct("r").alias("d"), F.count("*").alias("n")).where("d = 64 and n = 64").select("image")
    made = rows.join(whole, "image").groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "e"))), lambda s: s["e"])).alias("x"))
    return rounded(images.high_frequency_share(made, "x", 64, "high").drop("x"))


_GROWN = "greatest({lo}, least(round_even(({a} + {b}) * 0.5::DOUBLE - greatest(2.0::DOUBLE, ({b} - {a}) * 1.08::DOUBLE) * 0.5::DOUBLE, 0), 7))"
_GROWN_END = "round_even(({a} + {b}) * 0.5::DOUBLE + greatest(2.0::DOUBLE, ({b} - {a}) * 1.08::DOUBLE) * 0.5::DOUBLE, 0)"


@query(
    f"WITH {EV}, bx AS (SELECT vec_id, e, vec_id % 3 AS x1, vec_id % 2 AS y1, CASE WHEN vec_id % 5 = 0 THEN 6 ELSE 8 END AS x2, 8 AS y2 FROM ev), "
    f"gx AS (SELECT *, {_GROWN.format(lo=0, a='x1', b='x2')} AS a1, {_GROWN.format(lo=0, a='y1', b='y2')} AS b1, {_GROWN_END.format(a='x1', b='x2')} AS a9, {_GROWN_END.format(a='y1', b='y2')} AS b9 FROM bx), "
    "pp AS (SELECT vec_id, x1, y1, x2, y2, 20 * e[k + 1] AS fx, 20 * e[(k * 5) % 64 + 1] AS fy FROM gx, range(0, 64) q(k) WHERE k % 8 >= a1 AND k % 8 < greatest(a1 + 1, least(a9, 8)) AND k // 8 >= b1 AND k // 8 < greatest(b1 + 1, least(b9, 8))), "
    "md AS (SELECT *, median(fx) OVER (PARTITION BY vec_id) AS mx, median(fy) OVER (PARTITION BY vec_id) AS my FROM pp), sz AS (SELECT *, sqrt((fx - mx) * (fx - mx) + (fy - my) * (fy - my)) AS s FROM md), "
    "ct AS (SELECT vec_id, greatest(quantile_cont(s, 0.60), 0.05) AS cut FROM sz GROUP BY vec_id), "
    "sm AS (SELECT sz.vec_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, count(*) FILTER (s > cut) AS n, median(fx) FILTER (s > cut) AS dx, median(fy) FILTER (s > cut) AS dy, median(s) FILTER (s > cut) AS a FROM sz JOIN ct ON sz.vec_id = ct.vec_id GROUP BY sz.vec_id), "
    "nw AS (SELECT *, greatest(0, least(round_even(x1 + dx, 0), 7)) AS nx1, greatest(0, least(round_even(y1 + dy, 0), 7)) AS ny1, round_even(x2 + dx, 0) AS nx2, round_even(y2 + dy, 0) AS ny2 FROM sm) "
    "SELECT vec_id, CASE WHEN n >= 18 THEN nx1 ELSE x1 END::INT AS x1, CASE WHEN n >= 18 THEN ny1 ELSE y1 END::INT AS y1, CASE WHEN n >= 18 THEN greatest(nx1 + 1, least(nx2, 8)) ELSE x2 END::INT AS x2, CASE WHEN n >= 18 THEN greatest(ny1 + 1, least(ny2, 8)) ELSE y2 END::INT AS y2, "
    "round(CASE WHEN n >= 18 THEN greatest(0.22, least(0.62, 0.28 + 0.90 * a)) ELSE 0.18 END, 6) AS confidence FROM nw"
)
def box_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Boxes moved by the motion of the pixels inside them."""
    v = F.col("vec_id")
    box = boxes.box(v % 3, v % 2, F.when(v % 5 == 0, 6).otherwise(8), F.lit(8))
    pixels = vectors(spark, d).select("vec_id", box.alias("b"), "e").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    pixels = pixels.select("vec_id", "b", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).alias("y"), (20 * F.get("e", F.col("k"))).alias("fx"), (20 * F.get("e", (F.col("k") * 5) % 64)).alias("fy"))
    return rounded(images.propagated_boxes(pixels, "vec_id", "x", "y", "fx", "fy", "b", 8, 8))


_BGR = {"b": "floor(least(greatest(e[k + 1] * 400 + 128, 0), 255))", "g": "floor(least(greatest(e[(k * 5) % 64 + 1] * 400 + 128, 0), 255))", "r": "floor(least(greatest(e[(k * 11) % 64 + 1] * 400 + 128, 0), 255))"}


def _lab_sql() -> str:
    lin = {c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for c in "rgb"}
    ts = [f"({w[0]}::DOUBLE * {lin['r']} + {w[1]}::DOUBLE * {lin['g']} + {w[2]}::DOUBLE * {lin['b']}) / {white}::DOUBLE" for w, white in zip(colors.XYZ, colors.WHITE, strict=True)]
    return ", ".join(f"CASE WHEN {t} > 0.008856 THEN pow({t}, {1.0 / 3.0!r}::DOUBLE) ELSE 7.787::DOUBLE * ({t}) + {16.0 / 116.0!r}::DOUBLE END AS {n}" for n, t in zip("xyz", ts, strict=True))


@query(
    f"WITH {EV}, px AS (SELECT vec_id, " + ", ".join(f"{x}::DOUBLE AS {n}" for n, x in _BGR.items()) + f" FROM ev, range(0, 64) q(k)), cs AS (SELECT vec_id, b, r, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray, {_lab_sql()} FROM px) "
    "SELECT vec_id, round(avg(gray), 6) AS gray, round(avg((r - gray) * 0.713::DOUBLE + 128.0::DOUBLE), 6) AS cr, round(avg((b - gray) * 0.564::DOUBLE + 128.0::DOUBLE), 6) AS cb, "
    "round(avg((116.0::DOUBLE * y - 16.0::DOUBLE) * 2.55::DOUBLE), 6) AS l, round(avg(500.0::DOUBLE * (x - y) + 128.0::DOUBLE), 6) AS a, round(avg(200.0::DOUBLE * (y - z) + 128.0::DOUBLE), 6) AS b FROM cs GROUP BY vec_id"
)
def color_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each patch in grey, YCrCb and Lab."""
    level = lambda k: F.floor(F.least(F.greatest(F.get("e", k) * 400 + 128, F.lit(0)), F.lit(255))).cast("double")
    k = F.col("k")
    rows = vectors(spark, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select("vec_id", level(k).alias("blue"), level((k * 5) % 64).alias("green"), level((k * 11) % 64).alias("red"))
    bgr = [F.col(c) for c in ("blue", "green", "red")]
    y, cr, cb = colors.ycrcb(*bgr)
    values = dict(zip(("gray", "cr", "cb", "l", "a", "b"), (y, cr, cb, *colors.lab(*bgr)), strict=True))
    return rounded(rows.groupBy("vec_id").agg(*[F.avg(x).alias(n) for n, x in values.items()]))
