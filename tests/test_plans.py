"""Models, training sets, suites, incident captures and the vendor source, end to end on small captures."""

import json
import sys
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
import yaml
from pyspark import cloudpickle
from pyspark.sql import functions as F

from brightwell.operators import features, forecast, gates, neural, quality, scoring, serving
from brightwell.plans import incident, suite, training
from brightwell.sources import Files, Profile, vendor

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not know the tests


# -- models --------------------------------------------------------------------------------------


def _plain_gru(w, name, x, layers):
    """Step by step for one window, as the textbook has it."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    for layer in range(layers):
        outs = []
        for end in ("", "_reverse") if f"{name}.weight_ih_l{layer}_reverse" in w else ("",):
            wi, wh, bi, bh = (w[f"{name}.{k}_l{layer}{end}"] for k in ("weight_ih", "weight_hh", "bias_ih", "bias_hh"))
            d, h, out = wh.shape[1], np.zeros(wh.shape[1]), {}
            for t in reversed(range(len(x))) if end else range(len(x)):
                a, g = wi @ x[t] + bi, wh @ h + bh
                r, z = sig(a[:d] + g[:d]), sig(a[d : 2 * d] + g[d : 2 * d])
                h = (1 - z) * np.tanh(a[2 * d :] + r * g[2 * d :]) + z * h
                out[t] = h
            outs.append(np.array([out[t] for t in range(len(x))]))
        x = np.concatenate(outs, 1)
    return x


def test_network_against_step_by_step():
    net, rng = neural.random_network(3, 2), np.random.default_rng(0)
    x_num, x_cat = rng.normal(size=(4, 6, 3)), rng.random((4, 6, 2))
    mu, logvar = net.encode(x_num, x_cat)
    for i in range(4):
        parts = []
        for name, x in (("numerical_encoder", x_num[i]), ("categorical_encoder", x_cat[i])):
            h = _plain_gru(net.w, f"{name}.gru", x, 2)
            h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
            score = h @ net.w[f"{name}.attention.attention.weight"][0] + net.w[f"{name}.attention.attention.bias"][0]
            share = np.exp(score) / np.exp(score).sum()
            parts.append(share @ h)
        merged = np.concatenate(parts)
        assert np.allclose(mu[i], net.w["fc_mu.weight"] @ merged + net.w["fc_mu.bias"])
        h = np.maximum(net.w["numerical_decoder.fc_in.weight"] @ mu[i] + net.w["numerical_decoder.fc_in.bias"], 0)
        out = _plain_gru(net.w, "numerical_decoder.gru", np.repeat(h[None], 6, 0), 2) @ net.w["numerical_decoder.fc_out.weight"].T + net.w["numerical_decoder.fc_out.bias"]
        assert np.isclose(net.errors(x_num, x_cat)[i], ((out - x_num[i]) ** 2).mean())
    q = net.assign(mu)
    assert np.allclose(q.sum(1), 1) and logvar.shape == mu.shape
    terms = neural.losses(net, x_num, x_cat, p=q, cluster=0.1, balance=0.5)
    assert abs(terms["kl_cluster"]) < 1e-9 and np.isclose(terms["loss"], terms["recon_num"] + terms["recon_cat"] + terms["kl_vae"] - 0.5 * terms["balance_entropy"])
    alone = neural.random_network(3, 0)
    assert alone.decode(alone.encode(x_num, x_cat[:, :, :0])[0], 6)[1].shape == (4, 6, 0)


def test_network_on_windows(spark):
    rows = spark.createDataFrame([("r", w, p, T0 + timedelta(minutes=w + p), float(w * p), float(p % 2)) for w in range(3) for p in range(4)], "resource_id string, window_id long, pos int, timestamp timestamp, a double, b double")
    got = {r["window_id"]: r for r in neural.score_windows(rows, ["a"], ["b"], lambda: neural.random_network(1, 1)).collect()}
    x = np.array([[[float(w * p), float(p % 2)] for p in range(4)] for w in range(3)])
    net = neural.random_network(1, 1)
    want = net.errors(x[:, :, :1], x[:, :, 1:])
    assert np.allclose([got[w]["error"] for w in range(3)], want)
    assert all(got[w]["cluster_id"] == net.assign(net.encode(x[:, :, :1], x[:, :, 1:])[0])[w].argmax() for w in range(3))
    assert np.allclose([r["error"] for r in neural.scorer(lambda: neural.random_network(1, 1), ["b"])(rows, ["a"]).orderBy("window_id").collect()], want)
    assert {r["name"] for r in neural.predictions(neural.score_windows(rows, ["a"], ["b"], lambda: neural.random_network(1, 1))).collect()} <= {"NORMAL", "PRE_SCALE", "PRE_FAILURE", "ACTIVE_DEGRADATION", "ANOMALY"}


def test_requests(spark):
    """Requests against numpy: alignment by name, padding, missing values and features, clipping."""
    nan = float("nan")
    rows = [("q1", {"a": [1.0, None, 3.0, nan, 5.0], "b": [nan, 2.0], "zzz": [9.0]}, {"c": [0.0, 5.0, 20.0]}), ("q2", {"a": []}, None)]
    requests = spark.createDataFrame(rows, "request_id string, numerical map<string, array<double>>, categorical map<string, array<double>>")
    numerical, categorical = {"a": (1.0, 2.0), "b": (1.0, 0.0)}, {"c": (0.0, 10.0), "d": (1.0, 1.0)}
    got = {r["resource_id"]: r for r in serving.request_windows(requests, numerical, categorical, 4).collect()}
    a, b, c = (np.array([1.0, 3, 3, 5]) - 1) / 2, np.array([0.0, 0, 2, 2]) - 1, [0.0, 0.0, 0.5, 1.0]
    assert np.allclose(got["q1"]["x"], np.column_stack([a, b, c, [0.0] * 4])) and np.allclose(got["q2"]["x"], 0)
    assert got["q1"]["missing_categorical"] == ["d"] and got["q2"]["missing_numerical"] == ["a", "b"]
    load = lambda: neural.random_network(2, 2)
    out = {r["request_id"]: r for r in serving.predict(requests, numerical, categorical, load, 4, 0.5).collect()}
    x = np.array([got[q]["x"] for q in ("q1", "q2")])
    assert np.allclose([out[q]["error"] for q in ("q1", "q2")], load().errors(x[:, :, :2], x[:, :, 2:]))
    assert (out["q1"]["numerical_coverage"], out["q1"]["categorical_coverage"], out["q2"]["numerical_coverage"]) == (1.0, 0.5, 0.0)
    assert all(r["name"] and r["is_anomaly"] == (r["error"] > 0.5) for r in out.values())
    assert serving.health(requests, object())["status"] == "healthy" and serving.health()["status"] == "degraded"


# -- training sets -------------------------------------------------------------------------------


def test_sample_fleet_and_training_set(spark, tmp_path):
    fleet = training.sample_fleet(spark)
    assert fleet.count() == 5 * 240 * 17 and fleet.where("value is null").count() == 0
    name = F.sum(F.xxhash64("resource_id", "metric_name", "timestamp", "value") % 1_000_003)
    assert fleet.repartition(7).agg(name).first() == training.sample_fleet(spark).agg(name).first()
    cpu = {r["resource_id"]: r["m"] for r in fleet.where("metric_name = 'cpuUsageNanoCores' AND minute(timestamp) >= 30 AND hour(timestamp) = 3").groupBy("resource_id").agg(F.avg("value").alias("m")).collect()}
    assert cpu["node-4"] > 1.3 * max(v for k, v in cpu.items() if k != "node-4")
    profile, warnings = quality.discovered_profile(fleet)
    assert "cpuUsageNanoCores" in profile.numerical and "status" in profile.categorical and not warnings
    with pytest.raises(ValueError):
        quality.discovered_profile(fleet.where("metric_name = 'status'"))
    names = list(profile.features)
    filled = features.filled_windows(features.pivot_wide(fleet, names), names, 30, 10)
    windows = features.window_arrays(filled, names)
    assert windows.count() == 5 * 22
    params = features.fit_zscore(filled, list(profile.numerical))
    training.write_training_set(training.seeded_split(windows, 0.2), params, str(tmp_path / "set"), profile.name)
    back, again = training.read_training_set(spark, str(tmp_path / "set"))
    assert back.count() == 110 and again.count() == len(profile.numerical)
    assert 5 < back.where("part = 'validation'").count() < 45
    assert training.seeded_sample(windows, 1.0).count() == 110 and training.seeded_sample(windows, 0.0).count() == 0
    assert {tuple(r) for r in training.seeded_sample(windows, 0.5).select("resource_id", "window_id").collect()} == {tuple(r) for r in training.seeded_sample(windows.repartition(3), 0.5).select("resource_id", "window_id").collect()}


def test_settings():
    s = training.Settings.load({"BRIGHTWELL_WINDOW_STEP": "5", "BRIGHTWELL_BETA": "0", "OTHER": "x"})
    assert (s.window_step, s.beta, s.sequence_length) == (5, 0.0, 30)
    for bad in ({"BRIGHTWELL_BATCH_SIZE": "0"}, {"BRIGHTWELL_WINDOW_STEP": "x"}):
        with pytest.raises(ValueError):
            training.Settings.load(bad)


# -- forecasts -----------------------------------------------------------------------------------


def test_forecasts_by_a_model_and_their_actuals(spark):
    series = spark.createDataFrame([("r", "m", T0 + timedelta(minutes=i), float(i)) for i in range(40)], "resource_id string, metric_name string, timestamp timestamp, value double")

    def load():
        return lambda histories, n: {k: np.array([h[-1] + np.arange(1, n + 1) + d for h in histories]) for k, d in (("lower", -1), ("median", 0), ("upper", 1))}

    made = forecast.forecast_horizons(series.where(F.col("value") < 20), [1, 5], load)
    got = {r["horizon"]: r for r in forecast.with_actuals(made, series).collect()}
    assert {h: (r["lower"], r["median"], r["upper"], r["actual"]) for h, r in got.items()} == {1: (19.0, 20.0, 21.0, 20.0), 5: (23.0, 24.0, 25.0, 24.0)}
    report = forecast.accuracy_report(spark.createDataFrame([("1h", i, 1.0, 1.5, 0.0, 2.0) for i in range(3)], "horizon string, ordinal long, actual double, median double, lower double, upper double"), spark.createDataFrame([(i, i // 2, 0.5) for i in range(4)], "ordinal long, cluster_id int, confidence double")).first()
    assert report["horizons"]["1h"]["picp"] == 1.0 and report["horizons"]["1h"]["mase"] is None
    assert report["stability"].asDict() == {"transition_rate": 1 / 3, "confidence_std": 0.0, "dominant_cluster_pct": 50.0} and report["observation_count"] == 4
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0)], "pos int, f double")
    wide, names = forecast.enrich(rows, ["f"])
    assert len(names) == 8 and wide.first()[names[0]] == 0.0


# -- suites --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Healthy and incident captures of three resources, a model, labels, a rubric, a suite."""
    at = tmp_path_factory.mktemp("world")
    rng = np.random.default_rng(5)

    def capture(name, spike=None):
        rows = []
        for r in ("a", "b", "c"):
            for i in range(700):
                for m in ("cpu", "mem"):
                    x = 10 + np.sin(i / 15) + rng.normal(0, 0.3)
                    if spike and r == spike and 400 <= i < 600 and m == "cpu":
                        x += 5 * (i % 2)
                    rows.append((r, m, T0 + timedelta(minutes=i), float(x)))
        spark.createDataFrame(rows, "resource_id string, metric_name string, timestamp timestamp, value double").write.parquet(str(at / name))
        return Files(spark, str(at / name)).metrics()

    healthy = capture("healthy.parquet")
    capture("incident.parquet", "a")
    profile = Profile("p", ("cpu", "mem"))
    model = suite.fit_model(healthy, profile, size=30, step=10)
    block, _ = suite.bake_serving_block(model, healthy, 0.99, 10, 1.5)
    suite.save_model(suite.Model(profile, model.params, model.scorer, 30, block), "window_mean", str(at / "model.json"))
    case = lambda r, role, on: {"resource_id": r, "role": role, "type": "load", "onsets": {"T0": "2026-01-01T06:40:00Z", "T2": "2026-01-01T08:00:00Z"} if on else {}, "primary_onset": "T0" if on else None, "end": "2026-01-01T10:00:00Z" if on else None}
    (at / "labels.json").write_text(json.dumps({"version": 2, "capture": "x", "cases": [case("a", "incident", True), case("b", "negative_control", False)]}))
    rubric = {
        "version": 1, "profile": "p", "headline_grid": "offline", "grids": {"offline": {"step_samples": 10}, "serving": {"step_samples": 1, "cadence_minutes": 10}}, "detection": {"mode": "lookback", "sustain": 3, "lead_in_hours": 5},
        "gates": {
            "no_pre_onset_bridging": {"required": True, "allow_absent": True}, "detection_lead": {"required": True, "allow_absent": True, "min_lead_vs": "T2"}, "lead_in_fpr": {"required": True, "allow_absent": True, "max_fraction": 0.1, "min_eval_windows": 10},
            "alarm_fatigue": {"required": True, "allow_absent": True, "grid": "serving", "max_time_in_alarm_fraction_per_resource": 0.2, "max_fleet_raises_per_week": 50},
            "negative_controls_clean": {"required": True, "allow_absent": True}, "coverage_integrity": {"required": True}, "sanity": {"required": True},
        },
    }
    (at / "rubric.yaml").write_text(yaml.safe_dump(rubric))
    (at / "suite.yaml").write_text(yaml.safe_dump({
        "version": 1, "suite": "s", "candidate": {"type": "reconstruction", "model": "model.json", "profile": "p"}, "threshold_policy": {"type": "per_resource_margin", "calibration": "healthy.parquet", "margin": 1.5}, "rubric": "rubric.yaml",
        "cases": [{"name": "one", "kind": "incident_capture", "capture": "incident.parquet", "labels": "labels.json"}, {"name": "calm", "kind": "healthy_reference", "capture": "healthy.parquet"}],
    }))
    return at


def test_suite_end_to_end(spark, world, tmp_path):
    out = suite.run_suite(spark, str(world / "suite.yaml"))
    assert out["verdict"] == "PASS" and gates.write_report(out, str(tmp_path / "r.json")) == 0
    one = {r["resource_id"]: r for r in out["cases"][0]["grids"]["offline"]}
    assert one["a"]["detected"] and one["a"]["lead_seconds_by_onset"]["T2"] > 0 and one["a"]["threshold_source"] == "per_resource"
    assert one["b"]["own_slice_runs"] == 0 and set(one) == {"a", "b"}
    assert {r["resource_id"] for r in out["cases"][1]["grids"]["serving"]} == {"a", "b", "c"}
    assert set(out["provenance"]["files"]) == {"model", "rubric", "one", "calm"}
    with pytest.raises(gates.SpecError):
        gates.validate_report(out | {"more": 1})
    with pytest.raises(gates.SpecError, match="no such case"):
        suite.run_suite(spark, str(world / "suite.yaml"), ["two"])


@pytest.mark.parametrize("policy", [{"type": "serving_block"}, {"type": "healthy_split"}, {"type": "reference_quantile", "calibration": "healthy.parquet"}, {"type": "global_override", "threshold": 1e9}])
def test_suite_policies(spark, world, policy):
    raw = yaml.safe_load((world / "suite.yaml").read_text()) | {"threshold_policy": policy}
    (world / "other.yaml").write_text(yaml.safe_dump(raw))
    out = suite.run_suite(spark, str(world / "other.yaml"), ["one"])
    lead = next(g for g in out["cases"][0]["rubric"]["gates"] if g["gate"] == "detection_lead")
    assert lead["passed"] is (policy["type"] != "global_override") and out["exit_code"] == 1 - int(out["verdict"] == "PASS")


def test_suite_errors_come_together(world):
    raw = yaml.safe_load((world / "suite.yaml").read_text())
    raw["extra"], raw["threshold_policy"], raw["candidate"]["type"] = 1, {"type": "reference_quantile"}, "other"
    raw["cases"] = [{"name": "x", "kind": "nope", "capture": "missing.parquet"}, {"name": "y", "kind": "incident_capture", "capture": "incident.parquet"}]
    (world / "bad.yaml").write_text(yaml.safe_dump(raw))
    with pytest.raises(gates.SpecError) as e:
        suite.load_suite(str(world / "bad.yaml"))
    assert all(x in str(e.value) for x in ("extra", "needs a calibration", "candidate type", "no such kind", "not found", "labels are missing"))


def test_incident_capture(spark, world, tmp_path):
    model = suite.load_model(spark, str(world / "model.json"))
    metrics = Files(spark, str(world / "incident.parquet")).metrics()
    assert incident.preflight(metrics, "a", ["cpu"]) is None
    assert "a, b, c" in incident.preflight(metrics, "z", ["cpu"]) and "none of" in incident.preflight(metrics, "a", ["x"])
    onset, end = T0 + timedelta(minutes=400), T0 + timedelta(minutes=600)
    assert incident.export_bracket(onset, end, 1, 10) == (int(onset.timestamp()) - 3600, int(end.timestamp()) + 600)
    scores = model.score(metrics, {"step_samples": 10})
    labels = spark.createDataFrame([("a", "a", "load", onset, end), ("q", "q", "load", onset, end)], "case_id string, resource_id string, type string, anchor timestamp, end timestamp")
    out = incident.analyse(scores, labels, gap=3)
    lines, code = incident.report(out, str(tmp_path / "s.json"))
    assert out["incidents"][0]["detected"] and out["healthy_fpr"] < 0.2 and code == 1 and "error" in lines[2]
    assert incident.analyse(scores, labels, threshold=1e9)["threshold_source"] == "override"
    with pytest.raises(ValueError):
        incident.analyse(scores.limit(0), labels)


# -- vendor --------------------------------------------------------------------------------------


def portal(url, params, headers):
    """A portal of two devices, one with two data sources; the first request of each path is refused once."""
    assert headers["Authorization"].startswith("LMv1 id:")
    path = url.removeprefix("https://portal")
    if path == "/device/devices":
        return 200, {}, {"items": [{"id": 1, "displayName": "one", "name": "h1"}, {"id": 2, "displayName": "two", "name": "h2"}][params["offset"] : params["offset"] + params["size"]], "total": 2}
    if path.endswith("/devicedatasources"):
        return 200, {}, {"items": [{"id": 7, "dataSourceName": "CPU", "instanceNumber": 2}, {"id": 8, "dataSourceName": "Idle", "instanceNumber": 0}, {"id": 9, "dataSourceName": "Disk", "instanceNumber": 1}]}
    if path.endswith("/instances"):
        return 200, {}, {"items": [{"id": 3, "name": "i3"}, {"id": 4, "displayName": "i4"}][: 2 if "/7/" in path else 1]}
    if params.get("page") == "2":
        return 200, {}, {"time": [60_000], "values": [[1.0, "No Data"]]}
    return 200, {}, {"dataPoints": ["x", "y"], "time": [180_000, 120_000], "values": [[3.0, "4"], ["", None]], "nextPageParams": "page=2&start=1"}


def test_vendor_walk_and_rows():
    client = vendor.Client("https://portal", "id", "key", portal, sleep=lambda _: None)
    found = list(client.walk(names=["cpu"], most=1))
    assert [(f["resource_id"], f["datasource_name"], f["datasource_instance"]) for f in found] == [("one", "CPU", "i3"), ("two", "CPU", "i3")]
    rows = list(vendor.rows_of(found[0], client.pages(found[0]["path"], 0, 200)))
    assert [(r[2], r[3].timestamp(), r[4]) for r in rows] == [("x", 60.0, 1.0), ("x", 180.0, 3.0), ("y", 180.0, 4.0)]


def test_vendor_signature_throttle_and_retry():
    assert vendor.signature("id", "key", "GET", "/x", 1000) == vendor.signature("id", "key", "GET", "/x", 1000) != vendor.signature("id", "key", "GET", "/x", 1001)
    assert vendor.pause({}, 0.2) == 0.2 and vendor.pause({"X-Rate-Limit-Remaining": "10", "X-Rate-Limit-Window": "60"}, 0.2) == 6.0
    assert vendor.pause({"X-Rate-Limit-Remaining": "0", "X-Rate-Limit-Window": "60"}, 0.2) == 60.0 and vendor.pause({"X-Rate-Limit-Remaining": "?", "X-Rate-Limit-Window": "60"}, 0.2) == 0.2
    answers = iter([(429, {}, {}), (503, {}, {}), (200, {}, {"ok": 1})])
    client = vendor.Client("https://portal", "id", "key", lambda *_: next(answers), least_pause=0, sleep=lambda _: None)
    assert client.get("/x") == {"ok": 1} and client.waited == [1.0, 2.0, 0]
    for status, tries in ((404, 0), (500, 2)):
        client = vendor.Client("https://portal", "id", "key", lambda *_, s=status: (s, {}, {}), retries=2, sleep=lambda _: None)
        with pytest.raises(vendor.Unavailable):
            client.get("/x")
        assert len(client.waited) == tries


def test_vendor_as_a_data_source(spark, monkeypatch):
    class Portal(vendor.VendorSource):
        transport = staticmethod(portal)

        @classmethod
        def name(cls):
            return "portal"

    spark.dataSource.register(Portal)
    reader = spark.read.format("portal").options(base_url="https://portal", access_id="id", access_key="key", start="0", end="200", pause="0", partitions="2")
    got = reader.load()
    assert got.count() == 2 * 3 * 3 and got.select("resource_id").distinct().count() == 2


# -- scores --------------------------------------------------------------------------------------


def test_filled_windows_against_plain(spark):
    rng = np.random.default_rng(9)
    values = [[None if rng.random() < 0.5 else float(rng.integers(9)) for _ in range(2)] for _ in range(23)]
    wide = spark.createDataFrame([("r", T0 + timedelta(minutes=i), *v) for i, v in enumerate(values)], "resource_id string, timestamp timestamp, f double, g double")
    for size, step in ((5, 2), (4, 1), (23, 3)):
        got = {(r["window_id"], r["pos"]): (r["f"], r["g"]) for r in features.filled_windows(wide, ["f", "g"], size, step).collect()}
        want = {}
        for w, start in enumerate(range(0, 23 - size + 1, step)):
            for c in range(2):
                part = [values[start + p][c] for p in range(size)]
                for p in range(size):
                    back, ahead = [x for x in part[: p + 1] if x is not None], [x for x in part[p:] if x is not None]
                    want.setdefault((w, p), []).append(back[-1] if back else ahead[0] if ahead else 0.0)
        assert got == {k: tuple(v) for k, v in want.items()}


def test_eligibility_codes(spark):
    s = spark.createDataFrame([("a", i, T0, 1.0) for i in range(60)] + [("b", i, T0, 0.0) for i in range(8)], "resource_id string, window_id long, end_time timestamp, error double")
    m = spark.createDataFrame([("a", "cpu", 1.0), ("a", "mem", 1.0), ("b", "cpu", 1.0)], "resource_id string, metric_name string, value double")
    got = {r["resource_id"]: r["reasons"] for r in scoring.eligibility(s, m, ["cpu", "mem", "never"]).collect()}
    assert got == {"a": [], "b": ["divergent-coverage:mem", "insufficient-windows:8<50", "non-positive-quantile:0.0"]}
