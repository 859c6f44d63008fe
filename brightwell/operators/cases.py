"""The metrics of a case, one row a resource: detection and leads, lead-in rates, coverage, alarm fatigue, control slices.

flagged: resource_id, window_id, end_time, error, threshold, source, flag. labels: resource_id, role, onsets map,
primary_onset, end. Fields of another role, or of a case without incidents, are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwell.functions import seconds_between
from brightwell.operators import detection
from brightwell.operators.scoring import effective_step

DAY = 86_400


@dataclass(frozen=True)
class Reading:
    """How runs are read: the detection block of a rubric."""

    mode: str = "no_bridging"
    anchor: str = "T0"
    sustain: int = 3
    max_lead: int = detection.MAX_LEAD
    lead_in: int = detection.LEAD_IN


def _map(key: str, value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value))))


def _scored(flagged: DataFrame) -> DataFrame:
    """Per resource its threshold, the number of its windows, and its run counts by sustain."""
    per = flagged.groupBy("resource_id").agg(F.max("threshold").alias("threshold"), F.max("source").alias("threshold_source"), F.count("*").alias("n_eval_windows"))
    grid = per.select("resource_id", F.explode(F.array(*map(F.lit, detection.SUSTAINS))).alias("sustain"))
    n = detection.by_sustain(detection.runs(flagged)).groupBy("resource_id", "sustain").agg(F.count("*").alias("n"))
    counts = grid.join(n, ["resource_id", "sustain"], "left").groupBy("resource_id").agg(_map("sustain", F.coalesce("n", F.lit(0))).alias("sustained_run_counts"))
    return per.join(counts, "resource_id")


def incident_metrics(flagged: DataFrame, labels: DataFrame, reading: Reading = Reading(), cadence: float | None = None) -> DataFrame:
    """Per incident resource: one detection at the anchor onset, its leads to every onset, lead-in rates before and coverage from the primary onset."""
    onset = lambda name: F.element_at("onsets", name)
    of = labels.where("role = 'incident'").select(F.col("resource_id").alias("case_id"), "resource_id", "onsets", onset(F.lit(reading.anchor)).alias("anchor"), onset(F.col("primary_onset")).alias("primary"), "end")
    by_primary = of.select("case_id", "resource_id", F.col("primary").alias("anchor"), "end")
    found = detection.detect(flagged, of.select("case_id", "resource_id", "anchor", "end"), reading.mode, reading.sustain, reading.max_lead)
    found = found.join(of.select("case_id", "onsets"), "case_id").withColumn("lead_seconds_by_onset", F.transform_values("onsets", lambda _, t: seconds_between(t, F.col("detection_time"))))
    rates = detection.lead_in_rates(flagged, by_primary, reading.lead_in).groupBy("case_id").agg(_map("sustain", F.col("fpr")).alias("lead_in_fpr"), F.max("windows").alias("n_lead_in_windows"), F.max(F.when(F.col("sustain") == reading.sustain, F.col("covered"))).alias("covered"))
    step = F.lit(float(cadence)) if cadence else F.col("step")
    spans = detection.sustained(detection.runs(flagged), reading.sustain).join(effective_step(flagged), "resource_id").withColumn("run_end", F.timestamp_micros((F.unix_micros("run_end") + step * 1_000_000).cast("long")))
    covered = detection.incident_coverage(spans, by_primary).select("case_id", F.col("coverage").alias("coverage_fraction"), F.col("clear_lead_seconds").alias("clear_lead_vs_end_s"), F.col("covered_seconds").alias("alarm_seconds_in_incident"))
    return found.join(rates, "case_id").join(covered, "case_id").select(
        "resource_id", F.lit("incident").alias("role"), "detected", "detection_time", "bridged", "runs_before", "runs_from", "lead_seconds_by_onset",
        "lead_in_fpr", "n_lead_in_windows", "coverage_fraction", "clear_lead_vs_end_s", "alarm_seconds_in_incident",
    )


def control_metrics(flagged: DataFrame, labels: DataFrame, reading: Reading = Reading()) -> DataFrame:
    """Per control resource: windows over, and sustained runs, of the one incident's [primary - lead_in, end], at its own and at the incident's threshold."""
    primary = F.element_at("onsets", F.col("primary_onset"))
    one = labels.where("role = 'incident'").select("resource_id", F.timestamp_micros(F.unix_micros(primary) - reading.lead_in * 1_000_000).alias("start"), "end")
    controls = labels.where("role = 'negative_control'").select("resource_id")
    thresholds = flagged.groupBy("resource_id").agg(F.max("threshold").alias("threshold"))
    slices = detection.control_slices(flagged.select("resource_id", "end_time", "window_id", "error"), controls, one, thresholds, reading.sustain)
    kind = F.element_at(F.split("slice_id", "/"), -1)
    return slices.groupBy("resource_id").agg(
        F.lit("negative_control").alias("role"),
        F.max(F.when(kind == "own", F.col("runs"))).alias("own_slice_runs"), F.max(F.when(kind == "own", F.col("over"))).alias("own_slice_over"),
        F.max(F.when(kind == "incident", F.col("runs"))).alias("incident_slice_runs"), F.max(F.when(kind == "incident", F.col("over"))).alias("incident_slice_over"),
    )


def healthy_metrics(flagged: DataFrame, labels: DataFrame | None = None, cadence: float | None = None) -> DataFrame:
    """Per scored resource: time in alarm and runs a week by sustain, and the span seen in days."""
    per = detection.alarm_fatigue(flagged, cadence=cadence)
    out = per.groupBy("resource_id").agg(
        _map("sustain", F.col("time_in_alarm")).alias("time_in_alarm_fraction"), _map("sustain", F.col("runs_per_week")).alias("runs_per_week"),
        _map("sustain", F.col("alarm_seconds")).alias("alarm_seconds"), (F.max("span_seconds") / DAY).alias("observed_span_days"),
    )
    known = labels.select("resource_id", "role") if labels is not None else flagged.limit(0).select("resource_id", F.lit("").alias("role"))
    return out.join(known, "resource_id", "left").withColumn("role", F.coalesce("role", F.lit("excluded")))


#: What a resource's row has, in this order.
FIELDS = (
    "resource_id string, role string, threshold double, threshold_source string, n_eval_windows bigint, detected boolean, detection_time timestamp, bridged boolean, "
    "runs_before bigint, runs_from bigint, lead_seconds_by_onset map<string,double>, lead_in_fpr map<int,double>, n_lead_in_windows bigint, coverage_fraction double, "
    "clear_lead_vs_end_s double, alarm_seconds_in_incident double, time_in_alarm_fraction map<int,double>, runs_per_week map<int,double>, alarm_seconds map<int,double>, "
    "sustained_run_counts map<int,bigint>, observed_span_days double, own_slice_runs bigint, own_slice_over bigint, incident_slice_runs bigint, incident_slice_over bigint"
)


def case_metrics(flagged: DataFrame, labels: DataFrame | None, reading: Reading = Reading(), cadence: float | None = None) -> DataFrame:
    """One row (FIELDS) for each resource that the case speaks of: with incidents, these and the controls; else all that were scored."""
    roles = set() if labels is None else {r["role"] for r in labels.select("role").distinct().limit(8).collect()}
    if "incident" in roles:
        of = incident_metrics(flagged, labels, reading, cadence)
        if "negative_control" in roles:
            of = of.unionByName(control_metrics(flagged, labels, reading), allowMissingColumns=True)
    else:
        of = healthy_metrics(flagged, labels, cadence)
    whole = of.join(_scored(flagged), "resource_id", "left")
    columns = []
    for field in FIELDS.split(", "):
        name, kind = field.split(" ", 1)
        columns.append((F.col(name) if name in whole.columns else F.lit(None)).cast(kind).alias(name))
    return whole.select(*columns)


def fleet(metrics: DataFrame, sustain: int) -> DataFrame:
    """One row over the fleet: time in alarm over time seen, and runs a week, summed."""
    at = lambda c: F.element_at(c, F.lit(sustain))
    return metrics.agg(F.try_divide(F.sum(at("alarm_seconds")), F.sum("observed_span_days") * DAY).alias("time_in_alarm"), F.sum(F.coalesce(at("runs_per_week"), F.lit(0.0))).alias("runs_per_week"))
