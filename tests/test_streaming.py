"""Streams against the same computed at once."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from brightwell import streaming
from brightwell.operators import detection, forecast, scoring

T0 = datetime(2026, 1, 1)


def run(df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_alarm_runs_match_batch(spark, tmp_path):
    flags = [0, 1, 1, 1, 0, 1, 1, 1, 1]
    rows = [("a", T0 + timedelta(minutes=i), bool(f)) for i, f in enumerate(flags)]
    schema = "resource_id string, end_time timestamp, flag boolean"
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.alarm_runs(stream), "alarm_runs").orderBy(F.desc("seen")).first()
    batch = detection.runs(spark.createDataFrame(rows, schema).withColumn("window_id", F.monotonically_increasing_id())).orderBy(F.desc("run_end")).first()
    assert (got["length"], got["run_start"], got["alarming"]) == (batch["length"], batch["run_start"], True)


def test_latest_windows(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=i), float(i)) for i in range(5)]
    schema = "resource_id string, timestamp timestamp, f double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(streaming.latest_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["f"], 3), "latest").first()
    assert got["x"] == [2.0, 3.0, 4.0]


def test_rollup(spark, tmp_path):
    rows = [("m", T0 + timedelta(minutes=30 * i), float(i)) for i in range(4)]
    schema = "metric_name string, timestamp timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(streaming.rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "rollup").orderBy("start").collect()
    assert [r["sum_value"] for r in got] == [1.0, 5.0]


def _stream(spark, path, rows, schema, parts):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cadence_matches_batch(spark, tmp_path):
    ends = [0, 180, 360, 900, 1210, 1900, 2000, 2900, 3100]
    rows = [("a", T0 + timedelta(seconds=s), float(i), i) for i, s in enumerate(ends)]
    schema = "resource_id string, end_time timestamp, error double, window_id long"
    got = run(streaming.on_cadence(_stream(spark, str(tmp_path / "in"), rows, schema, 3)), "cadence", "append").collect()
    batch = scoring.on_cadence(spark.createDataFrame(rows, schema), 600).collect()
    # the last window of all waits for what comes after it
    assert sorted(r["error"] for r in got) == sorted(r["error"] for r in batch if r["window_id"] < 8)


def test_scored_windows(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=i), float(i)) for i in range(5)]
    stream = _stream(spark, str(tmp_path / "in"), rows, "resource_id string, timestamp timestamp, f double", 1)
    got = run(streaming.scored_windows(stream, ["f"], 3, lambda: lambda w: (w**2).mean((1, 2)), 4.0), "scored").first()
    assert (got["error"], got["is_anomaly"], got["severity"]) == (29 / 3, True, 4)


def test_accuracy_and_drift_streams_match_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    seen = [("1h", i, float(x), float(x + e), float(x - 1), float(x + 1)) for i, (x, e) in enumerate(zip(rng.normal(0, 3, 90), rng.normal(0, 1, 90), strict=True))]
    schema = "horizon string, ordinal long, actual double, median double, lower double, upper double"
    got = run(streaming.accuracy(_stream(spark, str(tmp_path / "a"), seen, schema, 3), 40), "tracked").collect()[-1]
    want = forecast.accuracy(spark.createDataFrame(seen, schema), history=40).first()
    assert got["n"] == want["n"] == 40 and all(abs(got[c] - want[c]) < 1e-9 for c in ("picp", "mpiw", "mae", "mase"))
    errors = [("s", i, float(x)) for i, x in enumerate(np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 1, 60)]))]
    schema = "stream string, ordinal long, error double"
    got = run(streaming.change_points(_stream(spark, str(tmp_path / "b"), errors, schema, 2)), "changes").collect()[-1]
    want = forecast.change_point(spark.createDataFrame(errors, schema), ["stream"]).first()
    assert got["has_drift"] and got["change_point_ordinal"] == want["change_point_index"] and abs(got["score"] - want["score"]) < 1e-9


def test_lateness():
    assert streaming.lateness(120) == "480 seconds"
