"""Spans that the watermark closes, and the state that goes with them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import timelines

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def test_the_watermark_closes_a_span_and_clears_its_state(spark, tmp_path, rocks):
    at = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    parts = [
        [(1, 0, True), (1, 1, True), (2, 1, True), (1, 2, False)],
        [(1, 3, True), (2, 9, True), (2, 10, True)],  # 2's first flag stands alone
        [(3, 100, False)],
        [(3, 101, False)],
        [(3, 200, True), (3, 201, True)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "entity long, at string, flag boolean"
    query = (
        timelines.timed_spans(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).select("entity", F.to_timestamp("at").alias("ts"), "flag"), 2.0, 2)
        .writeStream.format("memory").queryName("timed_spans_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        for k, rows in enumerate(parts):
            (folder / f".{k}").write_text("".join(json.dumps({"entity": e, "at": at(s), "flag": f}) + "\n" for e, s, f in rows))
            (folder / f".{k}").rename(folder / f"{k}.json")
            query.processAllAvailable()
        got = spark.table("timed_spans_out").select("entity", F.unix_timestamp("start").alias("s"), F.unix_timestamp("end").alias("e"), "rows").collect()
        zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
        assert sorted((r["entity"], r["s"] - zero, r["e"] - zero, r["rows"]) for r in got) == [(1, 0, 3, 3), (2, 9, 10, 2)]
        # what is left is the open span of entity 3
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert states[-1]["numRowsTotal"] < max(s["numRowsTotal"] for s in states) or states[-1]["numRowsTotal"] <= 4
    finally:
        query.stop()
