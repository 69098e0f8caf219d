"""Result rows as batch tables, decision texts and reports per data set.

Everything is projections and small aggregates; tables are written by Spark's own writers, so
a failed task writes its part again and a reader sees whole tables only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import metrics
from .sinks import as_json, write_features

#: Columns of a batch table by the digits they are rounded to, None for what stays (fixed values).
BATCH: dict[str, int | None] = {
    "file": None, "path": None, "track": None, "analysis_version": None, "verdict": None, "confidence": None, "decision_mode": None, "decision_score": 4, "decision_threshold": 4,
    "core_detector_verdict": None, "core_detector_confidence": None, "core_tcs_score": 4, "core_threshold": 4, "bundle_track": None, "bundle_model": None, "bundle_probability": 4, "bundle_threshold": 4,
    "open_model": None, "open_probability": 4, "open_threshold": 4, "abstained_reason": None, "l1_flow_score": 4, "l2_physics_score": 4, "l3_semantic_score": 4, "l4_boundary_artifact_score": 4,
    "l4_flow_boundary_seam_score": 4, "l4_boundary_color_flicker_score": 4, "l4_warp_prediction_error_score": 4, "l4_boundary_edge_flicker_score": 4, "l4_ctcg_score": 4, "ctcg_phase_coherence": 4,
    "ctcg_ar_residual": 4, "ctcg_spectral_anomaly": 4, "ctcg_micro_jitter": 4, "face_detected_ratio": 4, "face_reliability_mean": 4, "neck_visibility_ratio": 4, "boundary_support_ratio": 4,
    "violations_count": None, "duration": 2, "fps": 1, "width": None, "height": None, "suspicious_frames": None, "comparison_note": None,
}
#: Frames that a batch table names.
SUSPICIOUS = 10


def batch_rows(results: DataFrame) -> DataFrame:
    """The columns of a batch table in order, as texts; what a row lacks is empty.

    Columns that the table doesn't have are empty; ``suspicious_frames`` may be an array.
    """
    out = []
    for name, digits in BATCH.items():
        value = F.lit(None).cast("string")
        if name in results.columns:
            kind = results.schema[name].dataType.typeName()
            value = F.concat_ws(",", F.slice(name, 1, SUSPICIOUS).cast("array<string>")) if kind == "array" else F.col(name)
            value = F.round(value.cast("double"), digits) if digits is not None else value
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return results.select(*out)


def write_batch(results: DataFrame, path: str) -> None:
    """A batch table as CSV with a header; empty texts stay empty."""
    batch_rows(results).write.option("emptyValue", "").csv(path, header=True)


def _probability(model: str, probability: str, threshold: str, *more: Column) -> Column:
    fields = [*more, F.col(model).alias("model"), F.round(probability, 4).alias("probability"), F.round(threshold, 4).alias("threshold")]
    return F.when(F.col(probability).isNotNull(), F.struct(*fields))


def decision_text(details: list[str]) -> Column:
    """One JSON text per result: the details, how it was decided, what the detector said, and the
    learned and open predictions where there are any."""
    return F.to_json(
        F.struct(
            *details,
            F.struct(F.col("decision_mode").alias("mode"), F.round("decision_score", 4).alias("score"), F.round("decision_threshold", 4).alias("threshold"), "confidence").alias("decision"),
            F.struct(F.col("core_detector_verdict").alias("verdict"), F.col("core_detector_confidence").alias("confidence"), F.round("core_tcs_score", 4).alias("tcs_score"), F.round("core_threshold", 4).alias("threshold")).alias("core_detector"),
            _probability("bundle_model", "bundle_probability", "bundle_threshold", F.col("bundle_track").alias("track")).alias("learned_prediction"),
            _probability("open_model", "open_probability", "open_threshold").alias("open_prediction"),
        )
    )


def generalization(rows: DataFrame, dataset: str, label: str, score: str, threshold: float) -> DataFrame:
    """One row per data set: rows, classes, AUC by trapezoids and the metrics at the threshold."""
    sizes = rows.groupBy(dataset).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    area = metrics.auc_trapezoid(rows, label, score, [dataset])
    at = metrics.at_threshold(rows, label, score, threshold, groups=[dataset])
    return sizes.join(area, dataset).join(at, dataset)


def generalization_text(report: DataFrame, dataset: str, digits: int = 4) -> DataFrame:
    """The report of each data set as one JSON text."""
    fields = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes if c != dataset]
    return report.select(dataset, as_json(*fields).alias("report"))


def write_generalization(rows: DataFrame, dataset: str, label: str, score: str, threshold: float, path: str) -> None:
    """``report`` (JSON lines) and ``features`` (CSV) below the path."""
    generalization_text(generalization(rows, dataset, label, score, threshold), dataset).write.json(f"{path}/report")
    write_features(rows, f"{path}/features")


def there(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read something at a path, in whatever store it lies."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def split_manifest_of(spark: SparkSession, data_path: str | None, explicit: str | None = None, name: str = "split_manifest.csv") -> str | None:
    """The split manifest to use: the one that is named, which must be there, else the one beside
    the data, if there is one."""
    if explicit:
        if not there(spark, explicit):
            raise FileNotFoundError(explicit)
        return explicit
    if not data_path:
        return None
    beside = f"{data_path.rstrip('/').rpartition('/')[0]}/{name}"
    return beside if there(spark, beside) else None
