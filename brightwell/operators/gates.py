"""Rubric gates over the metrics of a case, as rows, and the report they go into.

A rubric is data: version, profile, a detection block, grids, a headline grid, and for each gate whether it
is required, its grid and its limits. A gate looks at every resource of the role it is about.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.operators.cases import FIELDS, Reading

# fixed values: the names of the gates
NAMES = ("no_pre_onset_bridging", "detection_lead", "lead_in_fpr", "alarm_fatigue", "negative_controls_clean", "coverage_integrity", "sanity")
NEEDED = {"lead_in_fpr": ("max_fraction", "min_eval_windows"), "alarm_fatigue": ("max_time_in_alarm_fraction_per_resource", "max_fleet_raises_per_week")}


class SpecError(ValueError):
    """A rubric or suite that cannot be evaluated as written; exit code 2."""


def check_rubric(rubric: object) -> dict:
    """The rubric, if it can be evaluated; all that is wrong with it is said at once."""
    if not isinstance(rubric, dict):
        raise SpecError("a rubric is a mapping")
    grids, gates = rubric.get("grids"), rubric.get("gates") or {}
    wrong = [] if "version" in rubric else ["no version"]
    if not isinstance(grids, dict) or not grids:
        wrong.append("no grids")
        grids = {}
    wrong += [f"grid {g} has no step_samples" for g, v in grids.items() if not isinstance(v, dict) or "step_samples" not in v]
    if rubric.get("headline_grid") not in grids:
        wrong.append(f"headline_grid {rubric.get('headline_grid')} is no grid")
    for name, gate in gates.items():
        gate = gate or {}
        if name not in NAMES:
            wrong.append(f"no such gate: {name}")
        if gate.get("grid") is not None and gate["grid"] not in grids:
            wrong.append(f"gate {name}: no such grid: {gate['grid']}")
        wrong += [f"gate {name} lacks {p}" for p in NEEDED.get(name, ()) if gate.get(p) is None]
    if wrong:
        raise SpecError("; ".join(wrong))
    return rubric


def load_rubric(path: str) -> dict:
    import yaml

    return check_rubric(yaml.safe_load(Path(path).read_text()))


def reading(rubric: dict) -> Reading:
    d = rubric.get("detection") or {}
    return Reading(d.get("mode", "no_bridging"), d.get("onset_anchor", "T0"), int(d.get("sustain", 3)), int(float(d.get("max_leadtime_minutes", 120)) * 60), int(float(d.get("lead_in_hours", 24)) * 3600))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def _odd(c: str) -> Column:
    return F.exists(F.map_values(c), lambda v: ~_finite(v))


def judge(metrics: DataFrame, rubric: dict, grid: str, hygiene: DataFrame | None = None, profile: str | None = None, absent: tuple[str, ...] = (), spans_lead_in: bool = True) -> DataFrame:
    """One row for each gate of the rubric that reads this grid: gate, grid, required, applicable, passed, detail, offenders, observed (by resource).

    metrics: rows of case_metrics. hygiene: resource_id, reasons; a resource without a row has no verdict, which fails coverage. absent: labelled resources that the capture lacks. A gate whose resources are absent passes as not applicable."""
    read = reading(rubric)
    verdicts = hygiene.select("resource_id", F.col("reasons").alias("_reasons")) if hygiene is not None else metrics.limit(0).select("resource_id", F.array().cast("array<string>").alias("_reasons"))
    rows = metrics.join(verdicts, "resource_id", "left")
    incident, control, healthy = F.col("role") == "incident", F.col("role") == "negative_control", F.col("time_in_alarm_fraction").isNotNull()
    never = F.lit(None).cast("double")
    aggregates, shape = [], []
    for name, gate in (rubric.get("gates") or {}).items():
        gate = gate or {}
        if gate.get("grid", rubric["headline_grid"]) != grid:
            continue
        sustain = int(gate.get("sustain", read.sustain)) if name == "alarm_fatigue" else read.sustain
        at = lambda c, s=sustain: F.element_at(c, F.lit(s))
        extra: list[tuple[Column, Column]] = []  # (fails, what is said)
        if name == "no_pre_onset_bridging":
            who, value, bad, said = incident & F.col("detected").isNotNull(), F.col("bridged").cast("double"), F.col("bridged"), "a run from before the onset is on at the onset"
        elif name == "detection_lead":
            vs, least = gate.get("min_lead_vs", read.anchor), float(gate.get("min_lead_seconds", 0.0))
            value = F.element_at("lead_seconds_by_onset", F.lit(vs))
            who, bad, said = incident & F.col("detected").isNotNull(), value.isNull() | (value < least), f"lead to {vs} under {least:g} s, or not detected"
        elif name == "lead_in_fpr":
            least, most = int(gate["min_eval_windows"]), float(gate["max_fraction"])
            value, thin = at("lead_in_fpr"), F.col("n_lead_in_windows") < least
            who, bad, said = incident, thin | value.isNull() | (value > most), f"more than {most:g} of the lead-in in alarm, or underpowered (under {least} windows)"
        elif name == "alarm_fatigue":
            most, raises = float(gate["max_time_in_alarm_fraction_per_resource"]), float(gate["max_fleet_raises_per_week"])
            value = at("time_in_alarm_fraction")
            who, bad, said = healthy, F.coalesce(value > most, F.lit(False)), f"more than {most:g} of the time in alarm"
            weekly = F.sum(F.when(healthy, F.coalesce(at("runs_per_week"), F.lit(0.0))))
            extra.append((weekly > raises, F.format_string(f"the fleet raises %.2f a week, {raises:g} allowed", weekly)))
        elif name == "negative_controls_clean":
            runs = F.coalesce("own_slice_runs", at("sustained_run_counts"), F.lit(0))
            who, value, bad, said = control, runs.cast("double"), runs != 0, "sustained runs at its own threshold"
        elif name == "coverage_integrity":
            clean = F.coalesce(F.size("_reasons") == 0, F.lit(False))
            who, value, bad, said = F.lit(True), clean.cast("double"), ~clean, "fails hygiene, or has no verdict"
            if not spans_lead_in:
                extra.append((F.lit(True), F.lit("the capture does not span the lead-in and the incident")))
        else:
            threshold = F.col("threshold")
            odd = [_odd(c) for c in ("lead_in_fpr", "time_in_alarm_fraction", "runs_per_week")] + [~_finite(F.col(c)) for c in ("coverage_fraction", "clear_lead_vs_end_s", "alarm_seconds_in_incident", "observed_span_days")]
            wild = F.lit(False)
            for o in odd:
                wild = wild | F.coalesce(o, F.lit(False))
            who, value, bad, said = F.lit(True), threshold, ~F.coalesce(_finite(threshold) & (threshold > 0), F.lit(False)) | wild, "a threshold not finite and above 0, or a number that is not finite"
            extra.append((F.coalesce(F.sum("n_eval_windows"), F.lit(0)) <= 0, F.lit("no windows")))
            if profile != rubric.get("profile"):
                extra.append((F.lit(True), F.lit(f"profile {profile}, the rubric is for {rubric.get('profile')}")))
            if absent:
                extra.append((F.lit(True), F.lit(f"labelled, not in the capture: {', '.join(absent)}")))
        offenders = F.array_sort(F.collect_list(F.when(who & bad, F.col("resource_id"))))
        observed = F.map_from_entries(F.array_sort(F.collect_list(F.when(who, F.struct("resource_id", F.coalesce(value, never).alias("value"))))))
        notes = F.array_compact(F.array(F.when(F.size(offenders) > 0, F.concat(F.lit(f"{said}: "), F.array_join(offenders, ", "))), *(F.when(fails, what) for fails, what in extra)))
        n = F.count(F.when(who, 1)) if name != "sanity" else F.lit(1)  # it is about the case, even if nothing was scored
        aggregates += [F.struct(n.alias("n"), offenders.alias("offenders"), observed.alias("observed"), notes.alias("notes")).alias(f"g{len(shape)}")]
        shape.append((name, bool(gate.get("required", False))))
    if not shape:
        return metrics.sparkSession.createDataFrame([], "gate string, grid string, required boolean, applicable boolean, passed boolean, detail string, offenders array<string>, observed map<string,double>")
    one = rows.agg(*aggregates)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("gate"), F.lit(required).alias("required"), F.col(f"g{i}").alias("g")) for i, (name, required) in enumerate(shape)))).alias("r")
    out = one.select(each).select("r.gate", "r.required", "r.g.*")
    applicable = F.col("n") > 0
    passed = ~applicable | (F.size("notes") == 0)
    detail = F.when(~applicable, "no applicable cases").when(passed, "holds").otherwise(F.array_join("notes", "; "))
    return out.select("gate", F.lit(grid).alias("grid"), "required", applicable.alias("applicable"), passed.alias("passed"), detail.alias("detail"), "offenders", "observed")


def verdict(rows: list, rubric: dict) -> bool:
    """Whether all required gates pass; a required gate that is about nothing here is an error unless the rubric allows it."""
    for r in rows:
        if r["required"] and not r["applicable"] and not ((rubric.get("gates") or {})[r["gate"]] or {}).get("allow_absent"):
            raise SpecError(f"required gate {r['gate']} has no applicable cases")
    return all(r["passed"] for r in rows if r["required"])


REPORT = {"suite", "provenance", "cases", "verdict", "exit_code"}
CASE = {"name", "kind", "grids", "rubric", "reported"}
GATE = {"gate", "grid", "required", "applicable", "passed", "detail", "offenders", "observed"}
RESOURCE = {f.split(" ", 1)[0] for f in FIELDS.split(", ")}


def validate_report(report: dict) -> dict:
    """The report, if it has just the fields that one has, at every level."""
    wrong = [] if set(report) == REPORT else [f"report: {sorted(set(report) ^ REPORT)}"]
    for case in report.get("cases", []):
        if set(case) != CASE:
            wrong.append(f"case {case.get('name')}: {sorted(set(case) ^ CASE)}")
            continue
        wrong += [f"case {case['name']}, gate {g.get('gate')}: {sorted(set(g) ^ GATE)}" for g in case["rubric"]["gates"] if set(g) != GATE]
        wrong += [f"case {case['name']}, grid {k}: {sorted(set(r) ^ RESOURCE)}" for k, rows in case["grids"].items() for r in rows if set(r) != RESOURCE]
    if not wrong and (report["verdict"] == "PASS") != all(c["rubric"]["passed"] for c in report["cases"]):
        wrong.append("the verdict is not that of the cases")
    if wrong:
        raise SpecError("; ".join(wrong))
    return report


def write_report(report: dict, path: str) -> int:
    """Writes JSON; gives the exit code, 0 if all passed, else 1."""
    Path(path).write_text(json.dumps(validate_report(report), indent=2, default=str))
    return report["exit_code"]


def provenance_of(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """sha256 of the files that a result depends on, by name; of a folder, of its files' names and digests in order. Files are digested by the executors."""
    out = {}
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))
        rows = files.orderBy("file", "digest").collect()
        out[name] = rows[0]["digest"] if len(rows) == 1 else hashlib.sha256("".join(f"{r['file']}\n{r['digest']}\n" for r in rows).encode()).hexdigest()
    return out
