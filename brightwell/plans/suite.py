"""Suites: declared cases scored on the rubric's grids, thresholds by policy, gates judged, one report."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.operators import cases, detection, features, gates, scoring
from brightwell.operators.gates import SpecError
from brightwell.sources import Files, Profile, labels_frame, load_labels

# fixed values: the words of a suite
POLICIES = ("global_override", "reference_quantile", "healthy_split", "per_resource_margin", "serving_block")
CALIBRATED = ("reference_quantile", "per_resource_margin")
KINDS = ("incident_capture", "healthy_reference")
TOP = {"version", "suite", "candidate", "threshold_policy", "rubric", "cases"}
CASE = {"name", "kind", "capture", "labels", "format"}
SCORERS = {"training_mean": scoring.score_training_mean, "window_mean": scoring.score_window_mean}


@dataclass(frozen=True)
class Model:
    """What scores a capture: a scorer, the profile it is for, its normalisation and window length, and its baked serving block."""

    profile: Profile
    params: DataFrame
    scorer: scoring.Scorer
    size: int = 30
    serving: dict | None = None

    def windows(self, metrics: DataFrame, step: int) -> DataFrame:
        names = list(self.profile.features)
        return features.filled_windows(features.pivot_wide(metrics, names), names, self.size, step)

    def score(self, metrics: DataFrame, grid: dict) -> DataFrame:
        """Scores on a grid: windows every step_samples rows, of which a cadence keeps those that a poll would see."""
        numerical = list(self.profile.numerical)
        absent = features.absent_features(metrics, numerical)
        scores = self.scorer(features.apply_zscore(self.windows(metrics, int(grid["step_samples"])), self.params, numerical, absent), numerical)
        cadence = grid.get("cadence_minutes")
        return scoring.on_cadence(scores, int(cadence * 60)) if cadence else scores


def fit_model(calibration: DataFrame, profile: Profile, scorer: scoring.Scorer = scoring.score_window_mean, size: int = 30, step: int = 10) -> Model:
    """A model whose normalisation comes from a capture; parameters are a row a feature."""
    names = list(profile.features)
    rows = features.filled_windows(features.pivot_wide(calibration, names), names, size, step)
    params = features.fit_zscore(rows, list(profile.numerical)).collect()
    return Model(profile, calibration.sparkSession.createDataFrame(params, "feature string, mean double, std double"), scorer, size)


def save_model(model: Model, scorer: str, path: str) -> None:
    """A model as JSON: the named scorer, normalisation, profile and serving block."""
    import json

    p = model.profile
    out = {"profile": p.name, "numerical": p.numerical, "categorical": p.categorical, "scorer": scorer, "size": model.size, "params": {r["feature"]: [r["mean"], r["std"]] for r in model.params.collect()}, "serving": model.serving}
    Path(path).write_text(json.dumps(out, indent=2))


def load_model(spark: SparkSession, path: str) -> Model:
    import json

    raw = json.loads(Path(path).read_text())
    params = spark.createDataFrame([(f, m, s) for f, (m, s) in raw["params"].items()], "feature string, mean double, std double")
    return Model(Profile(raw["profile"], tuple(raw["numerical"]), tuple(raw["categorical"])), params, SCORERS[raw["scorer"]], raw["size"], raw.get("serving"))


def bake_serving_block(model: Model, healthy: DataFrame, quantile: float = scoring.QUANTILE, step: int = 10, margin: float | None = None) -> tuple[dict, DataFrame | None]:
    """The serving block that a healthy capture gives, and who may have a threshold of its own and why not.

    The threshold is the quantile of the earlier half; its rate on the later half leaves out the windows that overlap both. With a margin, per_resource has margin x own quantile of each eligible resource; it has a row a resource of the capture."""
    scores = model.score(healthy, {"step_samples": step})
    t = scoring.healthy_threshold(scores, quantile, scoring.gap_windows(model.size, step), per_resource=False).first()
    if not t["n_fit"]:
        raise ValueError("the healthy capture gives no windows")
    block = {"threshold": t["threshold"], "quantile": quantile, "healthy_fpr": t["fpr"], "n_calibration_windows": t["n_fit"], "recon_metric": "numerical_mse_from_mu"}
    if margin is None:
        return block, None
    verdicts = scoring.eligibility(scores, healthy, model.profile.numerical, quantile)
    own = verdicts.where("eligible").select("resource_id", (F.col("quantile") * scoring.checked_margin(margin)).alias("t")).orderBy("resource_id").collect()
    return block | {"per_resource": {r["resource_id"]: r["t"] for r in own}, "margin_multiplier": margin}, verdicts


def load_suite(path: str) -> dict:
    """A suite from YAML with its paths made absolute; all that is wrong with it is said at once."""
    import yaml

    base, raw = Path(path).resolve().parent, yaml.safe_load(Path(path).read_text())
    if not isinstance(raw, dict):
        raise SpecError("a suite is a mapping")
    wrong = [f"unknown key: {k}" for k in sorted(set(raw) - TOP)] + [f"{k} is missing" for k in ("version", "suite", "candidate", "threshold_policy", "rubric", "cases") if not raw.get(k)]

    def found(block: dict, key: str, where: str) -> None:
        at = (base / block[key]).resolve()
        if at.exists():
            block[key] = str(at)
        else:
            wrong.append(f"{where}: {key} not found: {at}")

    candidate, policy = raw.get("candidate") or {}, raw.get("threshold_policy") or {}
    if candidate and candidate.get("type") != "reconstruction":
        wrong.append(f"no such candidate type: {candidate.get('type')}")
    wrong += [f"candidate: {k} is missing" for k in ("model", "profile") if candidate and not candidate.get(k)]
    if candidate.get("model"):
        found(candidate, "model", "candidate")
    if policy and policy.get("type") not in POLICIES:
        wrong.append(f"no such threshold_policy type: {policy.get('type')}")
    if policy.get("calibration"):
        found(policy, "calibration", "threshold_policy")
    elif policy.get("type") in CALIBRATED:
        wrong.append(f"threshold_policy {policy['type']} needs a calibration")
    wrong += [f"threshold_policy: {k} is missing" for k, of in (("threshold", "global_override"), ("margin", "per_resource_margin")) if policy.get("type") == of and policy.get(k) is None]
    for i, c in enumerate(raw.get("cases") or []):
        name = f"case {c.get('name', i)}"
        wrong += [f"{name}: unknown key: {k}" for k in sorted(set(c) - CASE)]
        if c.get("kind") not in KINDS:
            wrong.append(f"{name}: no such kind: {c.get('kind')}")
        if c.get("format") not in (None, "parquet", "csv"):
            wrong.append(f"{name}: no such format: {c['format']}")
        if c.get("capture"):
            found(c, "capture", name)
        else:
            wrong.append(f"{name}: capture is missing")
        if c.get("kind") == "incident_capture" and not c.get("labels"):
            wrong.append(f"{name}: labels are missing")
        if c.get("kind") == "healthy_reference" and c.get("labels"):
            wrong.append(f"{name}: takes no labels")
        if c.get("labels"):
            found(c, "labels", name)
    if raw.get("rubric"):
        found(raw, "rubric", "suite")
        if Path(raw["rubric"]).exists():
            try:
                gates.load_rubric(raw["rubric"])
            except SpecError as e:
                wrong.append(f"rubric: {e}")
    if wrong:
        raise SpecError("; ".join(wrong))
    return raw


def policy_of(spec: dict, model: Model, calibration: DataFrame | None, scores: DataFrame | None) -> scoring.Policy | None:
    """The policy that a suite names; None for healthy_split, which each case fits on itself."""
    kind, quantile = spec["type"], float(spec.get("quantile", scoring.QUANTILE))
    if kind == "global_override":
        return scoring.global_override(float(spec["threshold"]))
    if kind == "serving_block":
        if not model.serving:
            raise SpecError("the model has no serving block")
        return scoring.serving_block(model.params.sparkSession, model.serving)
    if kind == "reference_quantile":
        return scoring.reference_quantile(scores, quantile)
    if kind == "per_resource_margin":
        able = scoring.eligibility(scores, calibration, model.profile.numerical, quantile)
        return scoring.per_resource_margin(scores, scoring.reference_quantile(scores, quantile).fallback, quantile, float(spec["margin"]), able)
    return None


def run_suite(spark: SparkSession, suite: dict | str, names: list[str] | None = None) -> dict:
    """Every case scored on every grid, judged, and reported with what the result depends on."""
    suite = load_suite(suite) if isinstance(suite, str) else suite
    rubric = gates.load_rubric(suite["rubric"])
    read, grids, headline = gates.reading(rubric), rubric["grids"], rubric["headline_grid"]
    model, spec = load_model(spark, suite["candidate"]["model"]), suite["threshold_policy"]
    profile = model.profile.name
    quantile = float(spec.get("quantile", scoring.QUANTILE))
    wanted = [c for c in suite["cases"] if names is None or c["name"] in names]
    if names is not None and len(wanted) < len(names):
        raise SpecError(f"no such case: {sorted(set(names) - {c['name'] for c in wanted})}")
    capture = lambda path, fmt: Files(spark, path, fmt).metrics(names=list(model.profile.features))
    calibration = capture(spec["calibration"], spec.get("format")) if spec.get("calibration") else None
    calibrated = model.score(calibration, grids[headline]).cache() if calibration is not None else None
    policy = policy_of(spec, model, calibration, calibrated)
    clean = scoring.eligibility(calibrated, calibration, model.profile.numerical, quantile) if calibration is not None else None
    results = []
    for case in wanted:
        metrics = capture(case["capture"], case.get("format"))
        labels = labels_frame(spark, load_labels(case["labels"])) if case.get("labels") else None
        scored = {g: model.score(metrics, grids[g]).cache() for g in grids}
        own = policy or scoring.healthy_split_quantile(scored[headline], quantile, per_resource=False)
        hygiene, population = clean, "calibration"
        if hygiene is None:
            hygiene, population = _own_hygiene(scored[headline], metrics, labels, model, quantile, read)
        there = {r["resource_id"] for r in labels.join(scored[headline].select("resource_id").distinct(), "resource_id", "left_semi").select("resource_id").collect()} if labels is not None else set()
        told = {r["resource_id"]: r["resource_id"] in there for r in labels.select("resource_id").collect()} if labels is not None else {}
        rows, judged = {}, []
        for g, scores in scored.items():
            cadence = grids[g].get("cadence_minutes")
            per = cases.case_metrics(detection.flag(scoring.with_threshold(scores, own)), labels, read, cadence * 60 if cadence else None).cache()
            rows[g] = [r.asDict() for r in per.orderBy("resource_id").collect()]
            judged += [r.asDict() for r in gates.judge(per, rubric, g, hygiene, profile, tuple(sorted(k for k, v in told.items() if not v))).collect()]
            per.unpersist()
        judged.sort(key=lambda r: gates.NAMES.index(r["gate"]))
        kind = "healthy_reference" if labels is None else "incident" if labels.where("role = 'incident'").limit(1).count() else "negative_control"
        results.append({"name": case["name"], "kind": kind, "grids": rows, "rubric": {"version": rubric["version"], "gates": judged, "passed": gates.verdict(judged, rubric)}, "reported": {"hygiene_population": population, "profile": profile, "labels_resources_present": told, "vus_pr": None}})
        for s in scored.values():
            s.unpersist()
    passed = all(c["rubric"]["passed"] for c in results)
    files = {"model": suite["candidate"]["model"], "rubric": suite["rubric"]} | {c["name"]: c["capture"] for c in wanted}
    provenance = {"files": gates.provenance_of(spark, files), "profile": profile, "seq_len": model.size, "grids": grids, "sustains": list(detection.SUSTAINS), "detection_mode": read.mode, "policy": spec}
    return gates.validate_report({"suite": suite["suite"], "provenance": provenance, "cases": results, "verdict": "PASS" if passed else "FAIL", "exit_code": 0 if passed else 1})


def _own_hygiene(scores: DataFrame, metrics: DataFrame, labels: DataFrame | None, model: Model, quantile: float, read: cases.Reading) -> tuple[DataFrame, str]:
    """Without a calibration, a case's own windows: those of the lead-in before its first incident, or all."""
    first = None
    if labels is not None:
        first = labels.where("role = 'incident'").agg(F.min(F.unix_micros(F.element_at("onsets", F.col("primary_onset"))))).first()[0]
    if first is None:
        return scoring.eligibility(scores, metrics, model.profile.numerical, quantile), "capture"
    t = F.unix_micros("end_time")
    before = scores.where((t >= first - read.lead_in * 1_000_000) & (t < first))
    return scoring.eligibility(before, metrics, model.profile.numerical, quantile), "pre_onset"
