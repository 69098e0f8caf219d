"""Base views: the tables as timelines, scored rows, feature rows and image patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import clip01
from ..operators.series import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """v, seq, x, kind, ok: each user's events in order, value scaled by 100."""
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    rows = numbered(e, "user_id", ["ts", "event_id"])
    return rows.select(
        F.col("user_id").alias("v"), F.col("seq").cast("long").alias("seq"), (F.col("value") / 100.0).alias("x"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok")
    )


TL = """tl AS (SELECT user_id AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
  value / 100.0::DOUBLE AS x, event_type AS kind, event_type <> 'error' AS ok FROM events)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, source, y (quality), toxic, s (length score), n_chars."""
    l = table(spark, folder, "labels")
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    s = F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0))
    return l.join(d, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), "toxic", s.alias("s"), "n_chars")


SC = """sc AS (SELECT l.doc_id, lang, source, quality AS y, toxic, least(n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS s, n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, y (odd label), e: 64 doubles."""
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", "label", (F.col("label") % 2).alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


EV = "ev AS (SELECT vec_id, label, label % 2 AS y, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


#: Features of each of the four levels: the coordinates in four runs.
LEVEL_FEATURES = [[f"f{16 * k + j}" for j in range(16)] for k in range(4)]


def leveled(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, y, f0 to f63: the coordinates moved to [0, 1], and l0 to l3: the mean of each
    level's features."""
    out = vectors(spark, folder).select("vec_id", "y", *[clip01(F.col("e")[k] + 0.5).alias(f"f{k}") for k in range(64)])
    return out.select("*", *[(sum((F.col(c) for c in names[1:]), F.col(names[0])) / 16.0).alias(f"l{k}") for k, names in enumerate(LEVEL_FEATURES)])


LV = (
    EV + ", lf AS (SELECT vec_id, y, " + ", ".join(f"least(greatest(e[{k + 1}] + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS f{k}" for k in range(64)) + " FROM ev), "
    "lv AS (SELECT *, " + ", ".join("(" + " + ".join(names) + f") / 16.0::DOUBLE AS l{k}" for k, names in enumerate(LEVEL_FEATURES)) + " FROM lf)"
)

#: Pixels of the 8 by 8 patch.
PX = EV + ", px AS (SELECT vec_id, label, k // 8 AS r, k % 8 AS c, e[k + 1] AS x FROM (SELECT vec_id, label, e, unnest(range(0, 64)) AS k FROM ev))"


def sig(x: str, center: float, scale: float) -> str:
    """The logistic score in SQL."""
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest((({x}) - {center}::DOUBLE) / {scale}::DOUBLE, -12.0::DOUBLE), 12.0::DOUBLE))))"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
