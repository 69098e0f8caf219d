from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cadenza.sources import ingest, media, scratch, sinks
from cadenza.streaming import timelines


def test_labels_by_folder(spark, tmp_path):
    (tmp_path / "ai").mkdir()
    for name in ("a_1.mp4", "b_2.MP4", "note.txt"):
        (tmp_path / "ai" / name).write_bytes(b"x")
    (tmp_path / "c_3.avi").write_bytes(b"x")
    found = ingest.labelled_files(ingest.media_files(spark, str(tmp_path)))
    assert sorted((r["filename"], r["label"]) for r in found.collect()) == [("a_1.mp4", 1), ("b_2.MP4", 1), ("c_3.avi", 0)]


def test_sampling_arithmetic(spark):
    df = spark.createDataFrame([("a", 250, 25.0), ("b", 5, 0.0)], "v string, total int, fps double")
    got = {}
    for r in media.sampled_indices(df, "total", "fps").collect():
        got.setdefault(r["v"], []).append(r["frame_idx"])
    assert sorted(got["a"]) == list(range(0, 250, 4)) and sorted(got["b"]) == list(range(5))


def test_feature_table_with_older_headers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("filename,label,L1_flow,physics_score\na,1,0.5,oops\nb,,0.1,0.2\nc,0,,0.3\n")
    got = ingest.read_features(spark, str(tmp_path / "f.csv"), ["flow_score", "physics_score", "gone"]).orderBy("filename").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0.5, 0.0, 0.0), ("c", 0, 0.0, 0.3, 0.0)]


def test_manifests(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("filename,original,path,label,category,source\na.mp4,,,0,first,\na.mp4,,,1,swap,\nz.mp4,,,0,,\n")
    files = spark.createDataFrame([("x/a.mp4", "a.mp4", 0, "c"), ("x/b.mp4", "b.mp4", 0, "c")], "path string, filename string, label int, category string")
    m = ingest.manifest(spark, str(tmp_path / "manifest.csv"))
    assert sorted((r["filename"], r["label"], r["category"]) for r in ingest.with_manifest(files, m).collect()) == [("a.mp4", 1, "swap"), ("b.mp4", 0, "c")]
    assert [r["filename"] for r in ingest.required_manifest(files, m).collect()] == ["a.mp4"]
    meta = spark.createDataFrame([('{"a.mp4": {"label": "FAKE"}, "b.mp4": {"label": "REAL"}}',)], "value string")
    assert sorted(map(tuple, ingest.metadata_labels(meta).collect())) == [("a.mp4", 1), ("b.mp4", 0)]


def test_report(spark):
    s = spark.createDataFrame([(1, "AUTHENTIC", "LOW", 0.4), (2, "AI_GENERATED", "HIGH", 0.9)], "k int, verdict string, confidence string, score double")
    v = spark.createDataFrame([(2, "A", "MINOR", 1, 2, 0.5, 0.1, 0.6), (2, "B", "MAJOR", 5, 6, 0.7, 0.1, 0.8)], "k int, violation_type string, severity string, frame_start long, frame_end long, measured_value double, expected_value double, confidence double")
    got = {r["k"]: r["report"].split("\n") for r in sinks.text_report(s, v, "k").collect()}
    assert len(got[1]) == 1 and [line[:7] for line in got[2][1:]] == ["[MAJOR]", "[MINOR]"]


def run_stream(spark, frames, schema, make, folder, name):
    source = str(folder / f"in-{name}")
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / f"ck-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streamed_spans_match_the_batch(spark, tmp_path):
    flags = {1: "TTFTFFTTFFFTFFFF", 2: "FFTTTTTFFFFFFFFF"}
    parts = [[(e, i, f[i] == "T") for e, f in flags.items() for i in range(lo, lo + 4)] for lo in range(0, 16, 4)]
    (tmp_path / "in-spans_out").mkdir()
    got = run_stream(spark, parts, "entity long, place long, flag boolean", timelines.closed_spans, tmp_path, "spans_out")
    assert sorted((r["entity"], r["start"], r["end"]) for r in got) == [(1, 0, 3), (1, 6, 7), (2, 2, 6)]


def test_streamed_windows(spark, tmp_path):
    rows = [("2024-01-01 00:%02d:00" % m, "a", float(m)) for m in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = timelines.windowed_activity(df, "30 minutes").orderBy("window").collect()
    assert [(r["n"], r["total"]) for r in got] == [(3, 30.0), (3, 120.0)]
    again = timelines.sessions(df.withColumn("entity", F.lit(1)), "15 minutes").collect()
    assert [(r["n"], r["total"]) for r in again] == [(6, pytest.approx(150.0))]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session)


def test_spent_tables_are_deleted(spark):
    table = scratch.materialize(spark.range(5), "spent")
    kept = scratch.materialize(table, "kept")
    path = table.inputFiles()[0]
    scratch.discard(table)
    with pytest.raises(Exception, match="[Ee]xist|FILE"):
        spark.read.parquet(path).count()
    assert kept.count() == 5


def test_names_of_long_keys_are_whole(spark):
    keys = [0, 7, 9999, 10000, 38461, 38462, 123456789012, None]
    rows = ingest.synthetic_for(spark.createDataFrame([(k, 1) for k in keys], "doc_id long, quality int"), "doc_id", "quality", ingest.SYNTHETIC)
    got = {r["doc_id"]: (r["filename"], r["source_group"]) for r in ingest.synthetic_results(rows, "doc_id", "quality", 0.39).collect()}
    assert got == {k: (f"synthetic_{k:04d}.mp4", f"synthetic_{k:04d}") for k in keys if k is not None} | {None: (None, None)}
