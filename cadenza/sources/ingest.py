"""Readers of manifests, feature tables and labelled folders, and synthetic feature tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import category, clip01, safe_double

EXTENSIONS = ("mp4", "avi", "mov", "mkv", "webm", "flv")
POSITIVE_TOKENS = ("ai", "fake", "deepfake", "sora", "runway", "kling")

#: Older headers of feature columns (fixed values).
ALIASES = {
    "flow_score": ("L1_flow",),
    "physics_score": ("L2_physics",),
    "semantic_score": ("L3_semantic",),
    "ctcg_score": ("L4_ctcg", "l4_boundary_artifact_score"),
    "ctcg_phase_coherence": ("flow_boundary_seam",),
    "ctcg_ar_residual": ("boundary_color_flicker",),
    "ctcg_spectral_anomaly": ("warp_prediction_error",),
    "ctcg_micro_jitter": ("boundary_edge_flicker",),
    "face_reliability_mean": ("face_reliability",),
}

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "original", "path", "label", "category", "source")])


def media_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path, length`` of the media files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def labelled_files(files: DataFrame) -> DataFrame:
    """Adds filename, label and category by folder: ``ai`` is 1, ``authentic`` is 0, else one of
    the positive tokens anywhere in the lower-cased path makes it 1."""
    folder = F.lower(F.try_element_at(F.split("path", "/"), F.lit(-2)))
    token = F.lower("path").rlike("|".join(POSITIVE_TOKENS))
    label = F.when(folder == "ai", 1).when(folder == "authentic", 0).when(token, 1).otherwise(0)
    out = files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("label", label)
    return out.withColumn("category", category(F.col("path"), F.col("label")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest by filename; of repeated names the last row stays (by file, then line)."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST, mode="PERMISSIVE").where("filename is not null")
    # partitions and the rows in them follow the files, so this number grows along them
    rows = rows.select("*", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    last = rows.groupBy("filename").agg(*[F.max_by(c, "at").alias(c) for c in rows.columns if c not in ("filename", "at")])
    return last.select(*[f.name for f in MANIFEST.fields])


def with_manifest(files: DataFrame, table: DataFrame) -> DataFrame:
    """Label and category of the manifest where it names a file."""
    m = table.select("filename", F.col("label").alias("m_label"), F.col("category").alias("m_category"))
    out = files.join(m, "filename", "left")
    label = F.coalesce(F.col("m_label").try_cast("int"), F.col("label"))
    return out.withColumn("label", label).withColumn("category", F.coalesce(F.nullif("m_category", F.lit("")), F.col("category"))).drop("m_label", "m_category")


def required_manifest(files: DataFrame, table: DataFrame) -> DataFrame:
    """Only files that the manifest names, with its label and category."""
    m = table.select("filename", F.col("label").try_cast("int").alias("label"), "category")
    return files.drop("label", "category").join(m, "filename")


def metadata_labels(text: DataFrame, column: str = "value") -> DataFrame:
    """``filename, label`` of a JSON map from file to {label: FAKE or REAL}."""
    parsed = F.from_json(F.col(column), "map<string,struct<label:string>>")
    rows = text.select(F.explode(parsed).alias("filename", "info"))
    return rows.select("filename", F.when(F.upper("info.label") == "FAKE", 1).otherwise(0).alias("label"))


def folder_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled folders, with a manifest beside them if there is one."""
    return labelled_files(media_files(spark, folder))


def flat_layout(spark: SparkSession, folder: str) -> DataFrame:
    return required_manifest(labelled_files(media_files(spark, folder)), manifest(spark, f"{folder}/manifest.csv"))


def metadata_layout(spark: SparkSession, folder: str) -> DataFrame:
    labels = metadata_labels(spark.read.text(f"{folder}/metadata.json", wholetext=True))
    return labelled_files(media_files(spark, folder)).drop("label").join(labels, "filename")


#: Readers by the name of a layout.
LAYOUTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ff": folder_layout, "flat": flat_layout, "dfdc": metadata_layout}


def split_manifests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``filename, split`` of one manifest per split."""
    out = None
    for split, path in paths.items():
        rows = manifest(spark, path).select("filename", F.lit(split).alias("split"))
        out = rows if out is None else out.unionByName(rows)
    return out


def aliased(df: DataFrame, name: str, aliases: tuple[str, ...] = ()) -> Column:
    """A feature as double under its own or an older header; 0 where it is missing or unreadable."""
    found = [c for c in (name, *aliases) if c in df.columns]
    texts = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in found]
    return safe_double(F.coalesce(*texts)) if texts else F.lit(0.0)


def feature_rows(df: DataFrame, names: list[str], identity: tuple[str, ...] = ("filename", "label")) -> DataFrame:
    """Typed features of an untyped table; rows without a label go."""
    label = F.col("label").cast("string").try_cast("double").cast("int")
    rows = df.where(F.trim(F.coalesce(F.col("label").cast("string"), F.lit(""))) != "")
    keep = [label.alias("label") if c == "label" else F.col(c) for c in identity]
    return rows.select(*keep, *[aliased(df, n, ALIASES.get(n, ())).alias(n) for n in names])


def read_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A feature CSV; all columns are read as text and typed here."""
    return feature_rows(spark.read.csv(path, header=True, mode="PERMISSIVE"), names)


def label_or_verdict(df: DataFrame) -> DataFrame:
    """The label, or where it is blank whether the verdict was AI_GENERATED."""
    own = F.when(F.trim(F.coalesce(F.col("label").cast("string"), F.lit(""))) != "", F.col("label").cast("string").try_cast("double").cast("int"))
    return df.withColumn("label", F.coalesce(own, (F.upper("verdict") == "AI_GENERATED").cast("int"), F.lit(0)))


def synthetic_features(spark: SparkSession, rows: int, means: dict[str, tuple[float, float]], spread: float = 0.15, seed: int = 42) -> DataFrame:
    """``row_index, label`` and normal features held in [0, 1]; means gives the mean of each class."""
    base = spark.range(rows).select(F.col("id").alias("row_index"), (F.col("id") % 2).cast("int").alias("label"))
    out = base
    for k, (name, (low, high)) in enumerate(means.items()):
        out = out.withColumn(name, clip01(F.when(F.col("label") == 1, high).otherwise(low) + F.randn(seed + k) * spread))
    return out


def drawn(key: Column, name: str, seed: int) -> Column:
    """A standard normal number made of the MD5 of a key, a name and a seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(name), F.lit(str(seed))))
    uniform = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(F.lit(2.0 * math.pi) * uniform(13))


def synthetic_for(rows: DataFrame, key: str, label: str, means: dict[str, tuple[float, float]], spread: float = 0.15, seed: int = 42) -> DataFrame:
    """Given rows with normal features held in [0, 1] around the mean of their class; the same
    key always draws the same numbers, on any cluster."""
    features = {n: clip01(F.when(F.col(label) == 1, high).otherwise(low) + drawn(F.col(key), n, seed) * spread) for n, (low, high) in means.items()}
    return rows.withColumns(features)


#: Means of either class of the synthetic features, and weights of the levels.
SYNTHETIC = {
    n: (0.30 + 0.01 * k, 0.55 + 0.01 * k)
    for k, n in enumerate(
        ["flow_score", "mean_divergence", "acceleration_anomaly", "flicker_score", "physics_score", "gravity_consistency", "rigid_body_score", "shadow_consistency", "semantic_score", "color_drift", "edge_stability", "texture_consistency", "ctcg_score", "ctcg_phase_coherence", "ctcg_ar_residual", "ctcg_spectral_anomaly", "ctcg_micro_jitter"]
    )
}
LEVEL_WEIGHTS = {"flow_score": 0.28, "physics_score": 0.26, "semantic_score": 0.16, "ctcg_score": 0.30}


def synthetic_results(features: DataFrame, key: str, label: str, threshold: float) -> DataFrame:
    """Synthetic features with names, score, verdict, confidence and rounded values of a result row."""
    digits = F.col(key).cast("string")
    # padding to a fixed length would cut longer keys, and two files would share a name
    name = F.concat(F.lit("synthetic_"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))
    score = F.lit(0.0)
    for feature, weight in LEVEL_WEIGHTS.items():
        score = score + F.lit(weight) * F.col(feature)
    gap = F.abs(score - threshold)
    identity = [
        F.concat(name, F.lit(".mp4")).alias("filename"), F.lit("").alias("path"), F.col(label).alias("label"), F.when(F.col(label) == 1, "synthetic_ai").otherwise("synthetic_auth").alias("category"), name.alias("source_group"), F.lit("synthetic-smoke").alias("track"),
        F.when(score >= threshold, "AI_GENERATED").otherwise("AUTHENTIC").alias("verdict"), F.round(score, 5).alias("tcs_score"), F.when(gap > 0.20, "HIGH").when(gap > 0.10, "MEDIUM").otherwise("LOW").alias("confidence"),
    ]
    return features.select(key, *identity, *[F.round(n, 5).alias(n) for n in SYNTHETIC])
