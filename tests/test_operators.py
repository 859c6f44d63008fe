"""Hand-made cases of the metric operators."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwell import functions, sources
from brightwell.operators import cases, clustering, detection, features, forecast, gates, quality, scoring, serving

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "resource_id string, metric_name string, timestamp timestamp, value double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def metrics(spark, rows):
    return spark.createDataFrame([(r, m, at(s), v) for r, m, s, v in rows], SCHEMA)


def scores(spark, errors, resource="a", step=60):
    return spark.createDataFrame([(resource, i, at(i * step), float(e)) for i, e in enumerate(errors)], "resource_id string, window_id long, end_time timestamp, error double")


def test_quality_golden(spark):
    rows = [("r1", "A", 7200 + 60 * i + 60 * 60, 1.0) for i in range(61)]
    end = 7200 + 60 * 60 + 60 * 60
    rows = [("r1", "A", end - 60 * i, 1.0) for i in range(61)]
    rows += [("r2", "A", end - 7200 - 60 * i, 1.0) for i in range(61)]
    rows += [("r3", "A", end - 3000 - 600, 1.0)] + [("r3", "A", end - 60 * i, 1.0) for i in range(11)]
    rows += [("r4", "A", end, 1.0)]
    series = quality.series_quality(metrics(spark, rows))
    got = quality.quality_rollup(series).first()
    assert (got["series"], got["analyzed"]) == (4, 3)
    assert round(got["freshness_score"], 1) == 66.7
    assert [r["resource_id"] for r in quality.stalest(series).collect()] == ["r2"]
    assert [r["resource_id"] for r in quality.gappiest(series).collect()] == ["r3"]


def test_quality_of_nothing(spark):
    got = quality.quality_rollup(quality.series_quality(metrics(spark, []))).first()
    assert (got["series"], got["freshness_score"], got["gap_score"]) == (0, 0.0, 0.0)


def test_coverage_of_an_empty_profile(spark):
    p = spark.createDataFrame([("full", "A"), ("full", "B"), ("empty", None)], "profile string, feature string")
    got = {r["profile"]: r for r in quality.coverage_gate(quality.coverage(p, metrics(spark, [("r", "A", 0, 1.0)]))).collect()}
    assert got["empty"]["coverage"] == 100 and got["full"]["coverage"] == 50 and not got["full"]["ready"]
    assert "B" in got["full"]["warning"]


def test_counter_shape(spark):
    rows = [("r", "counter", 120 * i, 7.0 * i) for i in range(80)] + [("r", "wave", 120 * i, float(i % 9)) for i in range(80)] + [("r", "short", 120 * i, float(i)) for i in range(20)]
    m = metrics(spark, rows).withColumn("ordinal", F.monotonically_increasing_id()).withColumn("datasource_instance", F.lit(None).cast("string"))
    assert {r["metric_name"]: r["is_counter"] for r in quality.counter_shape(m).collect()} == {"counter": True, "wave": False}


def test_resolution_tiers(spark):
    df = spark.createDataFrame([("Node-A", "web"), ("node-ab", "db"), ("x", "node-a")], "resource_id string, host_name string")
    assert serving.lookup(df, "node-a") == "Node-A"
    assert serving.lookup(df, "WEB") == "Node-A"
    with pytest.raises(serving.Ambiguous):
        serving.lookup(df, "ode")
    with pytest.raises(serving.NotFound):
        serving.lookup(df, "100%")


def test_fill_stays_within_a_window(spark):
    values = [None, 1.0, None, None, 5.0, None]
    wide = spark.createDataFrame([("r", at(60 * i), v) for i, v in enumerate(values)], "resource_id string, timestamp timestamp, f double")
    rows = features.filled_windows(wide, ["f"], 3, 3).orderBy("window_id", "pos").collect()
    assert [r["f"] for r in rows] == [1.0, 1.0, 1.0, 5.0, 5.0, 5.0]


@pytest.mark.parametrize("n,size,step", [(10, 4, 1), (10, 4, 3), (3, 4, 1), (7, 7, 2)])
def test_window_counts(spark, n, size, step):
    wide = spark.createDataFrame([("r", at(60 * i), 1.0) for i in range(n)], "resource_id string, timestamp timestamp, f double")
    rows = features.window_rows(wide, size, step)
    want = (n - size) // step + 1 if n >= size else 0
    assert rows.select("window_id").distinct().count() == want and rows.count() == want * size


def test_runs_are_maximal(spark):
    rng = random.Random(1)
    for _ in range(4):
        flags = [rng.random() < 0.6 for _ in range(40)]
        want, start = [], None
        for i, f in enumerate([*flags, False]):
            if f and start is None:
                start = i
            elif not f and start is not None:
                want.append((start * 60, i - start))
                start = None
        got = detection.runs(scores(spark, flags).withColumn("flag", F.col("error") > 0.5)).collect()
        assert sorted((int((r["run_start"].replace(tzinfo=timezone.utc) - T0).total_seconds()), r["length"]) for r in got) == want


def case(spark, anchor, end):
    return spark.createDataFrame([("c", "a", at(anchor), at(end))], "case_id string, resource_id string, anchor timestamp, end timestamp")


def flagged(spark, on, n=60):
    return scores(spark, [1.0 if i in on else 0.0 for i in range(n)]).withColumn("flag", F.col("error") > 0.5)


def test_detection_modes(spark):
    bridging = flagged(spark, set(range(25, 35)) | set(range(40, 44)))
    look = detection.detect(bridging, case(spark, 30 * 60, 50 * 60)).first()
    assert look["detected"] and look["bridged"] and look["lead_seconds"] == 300
    none = detection.detect(bridging, case(spark, 30 * 60, 50 * 60), "no_bridging").first()
    assert none["lead_seconds"] == -600
    # a run that ended a step before the onset still counts, one that ended earlier does not
    assert detection.detect(flagged(spark, {26, 27, 28, 29}), case(spark, 30 * 60, 50 * 60)).first()["detected"]
    assert not detection.detect(flagged(spark, {25, 26, 27, 28}), case(spark, 30 * 60, 50 * 60)).first()["detected"]
    assert not detection.detect(flagged(spark, {35, 36}), case(spark, 30 * 60, 50 * 60)).first()["detected"]


def test_lead_in_counts_the_slice_alone(spark):
    rates = detection.lead_in_rates(flagged(spark, {28, 29, 30, 31}), case(spark, 30 * 60, 50 * 60), lead_in=600).collect()
    assert {r["sustain"]: (r["covered"], r["windows"]) for r in rates} == {3: (0, 10), 1: (2, 10)}


def test_fatigue_of_one_window(spark):
    got = detection.alarm_fatigue(flagged(spark, {0}, 1)).where("sustain = 1").first()
    assert got["runs"] == 1 and got["time_in_alarm"] is None


def test_cadence_is_the_as_of_join(spark):
    rng = random.Random(4)
    ends = sorted(rng.randrange(0, 6000) for _ in range(60))
    df = spark.createDataFrame([("a", i, at(e), 0.0) for i, e in enumerate(ends)], "resource_id string, window_id long, end_time timestamp, error double")
    base = int(T0.timestamp())
    last = (base + ends[-1]) // 600 * 600
    want = set()
    for tick in range(-(-(base + ends[0]) // 600) * 600, last + 1, 600):
        want.add(max(i for i, e in enumerate(ends) if base + e <= tick))
    assert {r["window_id"] for r in scoring.on_cadence(df).collect()} == want


def test_policies(spark):
    s = scores(spark, range(100))
    own = scoring.per_resource_margin(s, 5.0, 0.5, 2.0)
    got = {(r["threshold"], r["source"]) for r in scoring.with_threshold(s.unionAll(scores(spark, [1], "b")), own).select("threshold", "source").distinct().collect()}
    assert got == {(99.0, "per_resource"), (5.0, "global")}
    with pytest.raises(ValueError):
        scoring.serving_block(spark, {"threshold": 1.0, "margin": float("inf"), "per_resource": {"a": 1.0}})
    with pytest.raises(ValueError):
        scoring.reference_quantile(s.limit(0))
    assert scoring.healthy_split_quantile(s, 1.0).fallback == 49.0
    # an anomaly in the later half cannot raise the threshold
    assert scoring.healthy_split_quantile(scores(spark, [*range(50), *[1e9] * 50]), 1.0).fallback == 49.0


def test_psi_and_change_point(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([("f", rng.gauss(0, 1)) for _ in range(600)], "feature string, value double")
    b = spark.createDataFrame([("f", rng.gauss(3, 1)) for _ in range(600)], "feature string, value double")
    assert not forecast.psi(a, a).first()["drifted"] and forecast.psi(a, b).first()["drifted"]
    stream = spark.createDataFrame([("s", i, rng.gauss(0 if i < 100 else 4, 0.5)) for i in range(200)], "s string, ordinal long, error double")
    got = forecast.change_point(stream, ["s"]).first()
    assert got["has_drift"] and abs(got["change_point_index"] - 100) <= 3
    assert abs(got["mean_before"]) < 0.3 and abs(got["mean_after"] - 4) < 0.3


def test_change_point_without_drift(spark):
    short = spark.createDataFrame([("s", i, float(i)) for i in range(40)] + [("flat", i, 1.0) for i in range(80)], "s string, ordinal long, error double")
    got = {r["s"]: r for r in forecast.change_point(short, ["s"]).collect()}
    assert (got["s"]["has_drift"], got["s"]["change_point_index"], got["s"]["score"], got["s"]["mean_before"], got["s"]["mean_after"]) == (False, None, None, 19.5, 19.5)
    assert (got["flat"]["has_drift"], got["flat"]["score"], got["flat"]["mean_before"]) == (False, 0.0, 1.0)


def test_change_point_against_numpy(spark):
    rng = np.random.default_rng(4)
    e = np.concatenate([rng.normal(0, 1e-6, 50), rng.normal(1e-5, 1e-6, 70)])
    best = (0.0, None)
    for i in range(30, len(e) - 30):
        a, b = e[i - 30 : i], e[i : i + 30]
        score = abs(b.mean() - a.mean()) / np.sqrt(((a.var() + b.var()) / 2 + 1e-10) * (1 / 30 + 1 / 30))
        best = max(best, (score, i), key=lambda x: x[0])
    got = forecast.change_point(spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(e)], "s string, ordinal long, error double"), ["s"]).first()
    assert abs(got["score"] - best[0]) < 1e-6 * best[0] and got["has_drift"] == bool(best[0] > -np.log(0.01))


def test_intervals(spark):
    rows = spark.createDataFrame([("g", "a", 5.0, 0.0, 10.0), ("g", "b", 25.0, 0.0, 10.0), ("g", "c", -1.0, 0.0, 10.0)], "g string, metric_name string, actual double, lower double, upper double")
    got = forecast.interval_anomaly(rows, ["g"]).first()
    assert got["score"] == 1.5 and got["violated"] == ["b", "c"] and got["severity"] == "high"
    calm = forecast.interval_anomaly(rows.where("metric_name = 'a'"), ["g"]).first()
    assert (calm["is_anomaly"], calm["score"], calm["severity"]) == (False, 0.0, "low")


def test_silhouette_of_all_rows(spark, monkeypatch):
    """Every row counts, beyond 2000 and over several groups, as in all pairs at once."""
    monkeypatch.setattr(clustering, "GROUP", 700)
    rng = np.random.default_rng(3)
    label, x = rng.integers(0, 3, 3001), rng.normal(size=(3001, 4))
    x += label[:, None]
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label int, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sums, sizes = d @ np.eye(3)[label], np.bincount(label)
    a = sums[np.arange(3001), label] / (sizes[label] - 1)
    b = np.where(np.arange(3) == label[:, None], np.inf, sums / sizes).min(1)
    got = clustering.silhouette(rows).first()
    assert got["rows"] == 3001
    assert abs(got["silhouette"] - ((b - a) / np.maximum(a, b)).mean()) < 1e-9


def test_silhouette_and_targets(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + (i // 2) * 0.01, 0.0], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    assert clustering.silhouette(rows).first()["silhouette"] > 0.9
    assert clustering.silhouette(rows.where("label = 0")).first()["silhouette"] == 0.0
    assert clustering.silhouette(rows.limit(0)).first()["silhouette"] == 0.0
    names = {r["cluster_id"]: (r["name"], r["action"], r["priority"]) for r in clustering.describe_clusters(spark.range(5).select(F.col("id").cast("int").alias("cluster_id"))).collect()}
    assert names[0] == ("NORMAL", "NONE", "LOW") and names[3] == ("ACTIVE_DEGRADATION", "REMEDIATE", "CRITICAL") and names[4] == ("ANOMALY", "ALERT", "HIGH")
    q = clustering.soft_assign(rows, clustering.centroids(rows))
    p = clustering.target_distribution(q)
    for c, of in (("q", q), ("p", p)):
        assert all(abs(r["s"] - 1) < 1e-9 for r in of.groupBy("vec_id").agg(F.sum(c).alias("s")).collect())
    assert {(r["vec_id"] % 2, r["cluster_id"]) for r in clustering.hard_assign(q).collect()} == {(0, 0), (1, 1)}


def test_pooled_quantile_is_exact(spark, monkeypatch):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 1), 2) for _ in range(3001)]
    s = spark.createDataFrame([(v,) for v in values] + [(None,)], "error double")
    for few in (10**6, 10):
        monkeypatch.setattr(scoring, "EXACT_ROWS", few)
        for q in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0):
            got = scoring.pooled_quantile(s, q).first()
            assert got["n"] == 3001 and abs(got["threshold"] - np.quantile(values, q)) < 1e-12
    assert scoring.pooled_quantile(s.limit(0), 0.5).first()["threshold"] is None


def test_pooled_split_ranks_over_all_resources(spark):
    rows = [(f"r{i % 3}", i, at(60 * (i // 4)), float(i)) for i in range(41)]
    s = spark.createDataFrame(rows, "resource_id string, window_id long, end_time timestamp, error double")
    got = {(r["resource_id"], r["window_id"]): r["part"] for r in scoring.time_split(s, 3, per_resource=False).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    assert got == {(r[0], r[1]): "fit" if k < 20 else "eval" if k >= 23 else None for k, r in enumerate(order)}


RUBRIC = {
    "version": 1, "profile": "p", "grids": {"offline": {"step_samples": 10}}, "headline_grid": "offline", "detection": {"mode": "lookback", "sustain": 3, "lead_in_hours": 4},
    "gates": {
        "no_pre_onset_bridging": {"required": True, "allow_absent": True}, "detection_lead": {"required": True, "allow_absent": True},
        "lead_in_fpr": {"required": True, "allow_absent": True, "max_fraction": 0.1, "min_eval_windows": 20},
        "alarm_fatigue": {"required": True, "allow_absent": True, "sustain": 1, "max_time_in_alarm_fraction_per_resource": 0.05, "max_fleet_raises_per_week": 10},
        "negative_controls_clean": {"required": True, "allow_absent": True}, "coverage_integrity": {"required": True}, "sanity": {"required": True},
    },
}


def _case(spark, errors_by_resource, roles=None, threshold=10.0, **more):
    """Windows every 10 minutes; the incident, if any, is on resource i from minute 400 to 600."""
    rows = [(r, k, at(600 * k), float(e), threshold, "global") for r, errors in errors_by_resource.items() for k, e in enumerate(errors)]
    flagged = detection.flag(spark.createDataFrame(rows, "resource_id string, window_id long, end_time timestamp, error double, threshold double, source string"))
    labels = None
    if roles:
        labels = spark.createDataFrame([(r, role, {"T0": at(24000)} if role == "incident" else None, "T0" if role == "incident" else None, at(36000) if role == "incident" else None) for r, role in roles.items()], "resource_id string, role string, onsets map<string, timestamp>, primary_onset string, end timestamp")
    hygiene = spark.createDataFrame([(r, []) for r in errors_by_resource], "resource_id string, reasons array<string>")
    metrics = cases.case_metrics(flagged, labels, gates.reading(RUBRIC))
    rows = gates.judge(metrics, RUBRIC, "offline", more.pop("hygiene", hygiene), more.pop("profile", "p"), **more).collect()
    return {r["gate"]: r for r in rows}, {r["resource_id"]: r for r in metrics.collect()}


def test_gates_of_an_incident(spark):
    quiet = [1.0] * 80
    alarm = quiet[:38] + [20.0] * 12 + quiet[50:]  # from 20 minutes before the onset on
    got, per = _case(spark, {"i": alarm, "c": quiet}, {"i": "incident", "c": "negative_control"})
    assert not got["no_pre_onset_bridging"]["passed"] and got["no_pre_onset_bridging"]["offenders"] == ["i"]
    assert got["detection_lead"]["passed"] and got["detection_lead"]["observed"] == {"i": 1200.0}
    assert got["lead_in_fpr"]["passed"] and per["i"]["n_lead_in_windows"] == 24 and per["i"]["lead_in_fpr"] == {1: 2 / 24, 3: 0.0}
    assert got["negative_controls_clean"]["passed"] and per["c"]["own_slice_runs"] == 0
    assert not got["alarm_fatigue"]["applicable"] and got["coverage_integrity"]["passed"] and got["sanity"]["passed"]
    # the alarm lasts a step beyond its last window, at 29400 s
    assert per["i"]["coverage_fraction"] == 6000 / 12000 and per["i"]["clear_lead_vs_end_s"] == 6000.0
    assert gates.verdict(list(got.values()), RUBRIC) is False


def test_gates_judge_each_resource(spark):
    quiet = [1.0] * 80
    late, noisy = quiet[:45] + [20.0] * 5 + quiet[50:], [20.0 if k % 2 else 1.0 for k in range(80)]
    got, _ = _case(spark, {"i": late, "c": noisy}, {"i": "incident", "c": "negative_control"})
    assert got["detection_lead"]["offenders"] == ["i"] and got["negative_controls_clean"]["passed"]
    got, _ = _case(spark, {"i": late[20:], "c": late}, {"i": "incident", "c": "negative_control"})
    assert got["negative_controls_clean"]["offenders"] == ["c"]
    # one resource over the budget fails a fleet that is within it on the whole
    got, per = _case(spark, {"a": [20.0] * 80, **{f"q{i}": quiet for i in range(30)}})
    assert got["alarm_fatigue"]["offenders"] == ["a"] and not got["no_pre_onset_bridging"]["applicable"]
    assert cases.fleet(spark.createDataFrame([per["a"].asDict()], cases.FIELDS), 1).first()["time_in_alarm"] > 1


def test_underpowered_lead_in_fails(spark):
    got, per = _case(spark, {"i": [1.0] * 80}, {"i": "incident"})
    assert got["lead_in_fpr"]["passed"] and not got["detection_lead"]["passed"]
    thin = {**RUBRIC, "gates": {"lead_in_fpr": {"required": True, "max_fraction": 0.1, "min_eval_windows": 25}}}
    metrics = spark.createDataFrame([per["i"].asDict()], cases.FIELDS)
    assert "underpowered" in gates.judge(metrics, thin, "offline").first()["detail"]


def test_coverage_and_sanity(spark):
    dirty = spark.createDataFrame([("a", ["insufficient-windows:8<50"])], "resource_id string, reasons array<string>")
    got, _ = _case(spark, {"a": [1.0] * 8, "b": [1.0] * 8}, hygiene=dirty, profile="other", absent=("z",), spans_lead_in=False)
    assert got["coverage_integrity"]["offenders"] == ["a", "b"] and "span" in got["coverage_integrity"]["detail"]
    assert all(x in got["sanity"]["detail"] for x in ("other", "z"))
    got, _ = _case(spark, {"a": [1.0] * 8}, threshold=0.0)
    assert got["sanity"]["offenders"] == ["a"]


def test_rubric_errors():
    for change, said in (({"headline_grid": "x"}, "headline_grid"), ({"gates": {"nope": {}}}, "nope"), ({"gates": {"lead_in_fpr": {"max_fraction": 1}}}, "min_eval_windows"), ({"grids": {}}, "no grids"), ({"gates": {"sanity": {"grid": "x"}}}, "no such grid")):
        with pytest.raises(gates.SpecError, match=said):
            gates.check_rubric({**RUBRIC, **change})
    row = {"gate": "alarm_fatigue", "required": True, "applicable": False, "passed": True}
    assert gates.verdict([row], RUBRIC)
    with pytest.raises(gates.SpecError):
        gates.verdict([row], {"gates": {"alarm_fatigue": {"required": True}}})


def test_labels_round_trip(tmp_path):
    old = tmp_path / "v1.json"
    old.write_text(json.dumps([{"resource_id": "a", "type": "t", "start": "2026-01-01T00:00:00Z", "end": "2026-01-01T01:00:00Z"}]))
    labels = sources.load_labels(str(old))
    sources.dump_labels(labels, str(tmp_path / "v2.json"))
    assert sources.load_labels(str(tmp_path / "v2.json"))["cases"][0]["onsets"] == labels["cases"][0]["onsets"]
    old.write_text(json.dumps([{"resource_id": "a", "type": "t", "start": "2026-01-01T00:00:00", "end": "2026-01-01T01:00:00Z"}]))
    with pytest.raises(ValueError):
        sources.load_labels(str(old))


def test_files(spark, tmp_path):
    m = metrics(spark, [("r", "A", 0, 1.0), ("r", "B", 60, float("nan"))])
    for name in ("t.parquet", "t.csv"):
        stats = sources.write_canonical(sources.canonical(m), str(tmp_path / name))
        assert (stats["rows"], stats["resources"], stats["metrics"]) == (2, 1, 2)
        source = sources.Files(spark, str(tmp_path / name))
        assert source.metrics(at(0), at(60)).count() == 1
        assert [r[0] for r in source.metric_names().collect()] == ["A", "B"]
    raw = spark.createDataFrame([("h", "3", '{"host_name": "x"}', "bad")], "resource_hash string, value_double string, attributes string, timestamp string")
    got = sources.canonical(raw).first()
    assert (got["resource_id"], got["host_name"], got["value"], got["timestamp"]) == ("h", "x", 3.0, None)
    told = spark.createDataFrame([("a", '{"host_name": null}', "own"), ("b", '{"other": 1}', "own"), ("c", "no json", "own"), ("d", None, "own"), ("e", '["host_name"]', "own")], "resource_id string, attributes string, host_name string")
    assert {r["resource_id"]: r["host_name"] for r in sources.canonical(told).collect()} == {"a": None, "b": "own", "c": "own", "d": "own", "e": "own"}


def test_csv_files_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("resource_id,metric_name,timestamp,value\nr1,cpu,2026-01-01T00:00:00Z,1.5\n")
    (tmp_path / "b 2.csv").write_text("value,host_name,timestamp,metric_name,resource_id\n2.5,h,2026-01-01T00:01:00Z,cpu,r2\nbad,h,2026-01-01T00:02:00Z,mem,r2\n")
    rows = sources.Files(spark, str(tmp_path / "*.csv")).metrics().orderBy("timestamp").collect()
    assert [(r["resource_id"], r["metric_name"], r["host_name"], r["value"]) for r in rows] == [("r1", "cpu", None, 1.5), ("r2", "cpu", "h", 2.5), ("r2", "mem", "h", None)]
    assert all(r["timestamp"] is not None for r in rows)


def test_small_functions(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(functions.last_or_padded(F.col("v"), 2).alias("a"), functions.last_or_padded(F.col("v"), 5).alias("b")).first()
    assert row["a"] == [2.0, 3.0] and row["b"] == [0.0, 0.0, 1.0, 2.0, 3.0]
    assert functions.parse_time("90m", T0) == T0 - timedelta(minutes=90) and functions.parse_time("now", T0) == T0
    r = spark.createDataFrame([("q", {"a": [1.0, 2.0], "b": [5.0]})], "request_id string, metrics map<string, array<double>>")
    got = {(x["metric_name"], x["value"]): x["timestamp"] for x in features.series_frame(r).collect()}
    assert got[("b", 5.0)] == got[("a", 2.0)]
