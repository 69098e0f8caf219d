"""Batch tables, decision texts, reports, and finding a split manifest."""

import json

import pytest
from pyspark.sql import functions as F

from cadenza.functions import colors
from cadenza.sources import ingest, reports


def test_batch_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.mp4", 0.123456, None, [5, 3, 1], 1.005, 'say "x", y')], "file string, decision_score double, bundle_probability double, suspicious_frames array<int>, duration double, comparison_note string")
    reports.write_batch(rows, f"file://{tmp_path}/b")
    back = spark.read.option("escape", '"').csv(f"file://{tmp_path}/b", header=True)
    assert back.columns == list(reports.BATCH) and len(back.columns) == 45
    r = back.first()
    assert (r["file"], r["decision_score"], r["suspicious_frames"]) == ("a.mp4", "0.1235", "5,3,1") and not r["bundle_probability"]


def test_decision_text_has_predictions_only_where_there_are_any(spark):
    fields = "file string, confidence string, decision_mode string, decision_score double, decision_threshold double, core_detector_verdict string, core_detector_confidence string, core_tcs_score double, core_threshold double, bundle_track string, bundle_model string, bundle_probability double, bundle_threshold double, open_model string, open_probability double, open_threshold double"
    rows = [("a", "LOW", "core", 0.12345, 0.5, "AUTHENTIC", "HIGH", 0.3, 0.4, None, None, None, None, None, None, None), ("b", "LOW", "bundle", 0.1, 0.5, "AUTHENTIC", "HIGH", 0.3, 0.4, "core", "mlp", 0.77777, 0.5, "gbm", 0.2, 0.25)]
    got = [json.loads(r[0]) for r in spark.createDataFrame(rows, fields).orderBy("file").select(reports.decision_text(["file"])).collect()]
    assert got[0] == {"file": "a", "decision": {"mode": "core", "score": 0.1235, "threshold": 0.5, "confidence": "LOW"}, "core_detector": {"verdict": "AUTHENTIC", "confidence": "HIGH", "tcs_score": 0.3, "threshold": 0.4}}
    assert got[1]["learned_prediction"] == {"track": "core", "model": "mlp", "probability": 0.7778, "threshold": 0.5} and got[1]["open_prediction"]["model"] == "gbm"


def test_generalization_report_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.2), ("y", 1, 0.4)], "d string, y int, s double")
    reports.write_generalization(rows, "d", "y", "s", 0.5, f"file://{tmp_path}/g")
    got = {r["d"]: json.loads(r["report"]) for r in spark.read.json(f"file://{tmp_path}/g/report").collect()}
    assert got["x"]["auc"] == 1.0 and got["y"]["fn"] == 1 and got["x"]["n"] == 2
    assert spark.read.csv(f"file://{tmp_path}/g/features", header=True).count() == 3


def test_split_manifest_beside_the_data(spark, tmp_path):
    (tmp_path / "data").mkdir()
    data = f"file://{tmp_path}/features.csv"
    assert reports.split_manifest_of(spark, data) is None and reports.split_manifest_of(spark, None) is None
    (tmp_path / "split_manifest.csv").write_text("filename,split\n")
    assert reports.split_manifest_of(spark, data) == f"file://{tmp_path}/split_manifest.csv"
    other = f"file://{tmp_path}/data/mine.csv"
    with pytest.raises(FileNotFoundError):
        reports.split_manifest_of(spark, data, other)
    (tmp_path / "data/mine.csv").write_text("x\n")
    assert reports.split_manifest_of(spark, data, other) == other


def test_drawn_numbers_are_normal_and_repeatable(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).cast("int").alias("y"), ingest.drawn(F.col("id"), "a", 1).alias("z"))
    r = rows.agg(F.avg("z"), F.stddev_pop("z"), F.avg((F.abs("z") < 1).cast("int"))).first()
    assert abs(r[0]) < 0.05 and abs(r[1] - 1) < 0.05 and abs(r[2] - 0.6827) < 0.03
    assert rows.repartition(7).orderBy("id").collect() == rows.orderBy("id").collect()


def test_tokens_anywhere_in_the_path(spark):
    files = spark.createDataFrame([("/d/x/Mydeepfakes1.mp4", 1), ("/d/x/plain.mp4", 1), ("/d/x/quiet.mp4", 1), ("/d/authentic/sora.mp4", 1), ("/d/ai/p.mp4", 1)], "path string, length long")
    assert {r["filename"]: r["label"] for r in ingest.labelled_files(files).collect()} == {"Mydeepfakes1.mp4": 1, "plain.mp4": 1, "quiet.mp4": 0, "sora.mp4": 0, "p.mp4": 1}


def test_colours_of_known_pixels(spark):
    rows = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (0, 0, 255), (128, 128, 128)], "b int, g int, r int")
    l, a, b = colors.lab(F.col("b"), F.col("g"), F.col("r"))
    y, cr, cb = colors.ycrcb(F.col("b"), F.col("g"), F.col("r"))
    got = [tuple(round(v) for v in r) for r in rows.select(l, a, b, y, cr, cb).collect()]
    assert got == [(255, 128, 128, 255, 128, 128), (0, 128, 128, 0, 128, 128), (136, 208, 195, 76, 255, 85), (137, 128, 128, 128, 128, 128)]
