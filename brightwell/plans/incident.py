"""One labelled incident capture from preflight to verdict: the bracket to export, checks before, threshold, detections, summary."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.functions import share
from brightwell.operators import detection, scoring

# fixed values: minutes and hours around an incident
LEAD_IN_HOURS, TAIL_MINUTES = 24.0, 30.0


def export_bracket(onset: datetime, end: datetime, lead_in_hours: float = LEAD_IN_HOURS, tail_minutes: float = TAIL_MINUTES) -> tuple[int, int]:
    """(start, end) in epoch seconds: a healthy lead-in before the onset and a tail after the end."""
    return int((onset - timedelta(hours=lead_in_hours)).timestamp()), int((end + timedelta(minutes=tail_minutes)).timestamp())


def write_label(path: str, resource_id: str, kind: str, onset: datetime, end: datetime) -> None:
    """A label file of version 1 with one incident."""
    Path(path).write_text(json.dumps([{"resource_id": resource_id, "type": kind, "start": onset.isoformat(), "end": end.isoformat()}], indent=2))


def preflight(metrics: DataFrame, resource_id: str, numerical: Sequence[str]) -> str | None:
    """What would make an analysis of this capture read as a clean miss, or None: no such resource, or no numerical feature at all."""
    if not metrics.where(F.col("resource_id") == resource_id).limit(1).count():
        some = [r[0] for r in metrics.select("resource_id").where(F.col("resource_id").isNotNull()).distinct().orderBy("resource_id").limit(5).collect()]
        return f"no resource {resource_id!r} in the capture; it has {', '.join(some) or 'none'}"
    if not metrics.where(F.col("metric_name").isin(*numerical)).limit(1).count():
        return "none of the profile's numerical features is in the capture, so there is nothing to score"
    return None


def incident_results(scores: DataFrame, incidents: DataFrame, threshold: float, mode: str = "lookback", sustain: int = 3, max_lead: int = detection.MAX_LEAD) -> DataFrame:
    """One row an incident: detected, first_detection_time, lead_time_seconds, and the largest error of [start, end] (null: no window there). incidents: case_id, resource_id, type, anchor, end."""
    flagged = detection.flag(scores.withColumn("threshold", F.lit(float(threshold))))
    found = detection.detect(flagged, incidents.drop("type"), mode, sustain, max_lead)
    span = incidents.select("case_id", "resource_id", "anchor", F.col("end").alias("_end"))
    inside = scores.join(span, "resource_id").where((F.col("end_time") >= F.col("anchor")) & (F.col("end_time") <= F.col("_end")))
    most = inside.groupBy("case_id").agg(F.max("error").alias("max_error_in_window"))
    out = incidents.select("case_id", "resource_id", "type").join(found.select("case_id", "detected", F.col("detection_time").alias("first_detection_time"), F.col("lead_seconds").alias("lead_time_seconds")), "case_id")
    return out.join(most, "case_id", "left")


def analyse(scores: DataFrame, incidents: DataFrame, *, quantile: float = scoring.QUANTILE, gap: int = 0, threshold: float | None = None, reference: DataFrame | None = None, mode: str = "lookback", sustain: int = 3, max_lead: int = detection.MAX_LEAD) -> dict:
    """The summary of a capture. The threshold is the one given, else the quantile of a healthy reference, else that of the earlier half of the windows that end before the first onset; its false-positive rate is measured on windows before the first onset that it was not fitted on."""
    first = incidents.agg(F.min("anchor")).first()[0]
    before = scores.where(F.col("end_time") < F.lit(first))
    later, source, fitted = before, "override", 0
    if threshold is None and reference is not None:
        q, source = scoring.pooled_quantile(reference, quantile).first(), "reference"
        threshold, fitted = q["threshold"], q["n"]
    elif threshold is None:
        split = scoring.time_split(before, gap, per_resource=False)
        q, source = scoring.pooled_quantile(split.where("part = 'fit'"), quantile).first(), "healthy_split"
        threshold, fitted, later = q["threshold"], q["n"], split.where("part = 'eval'")
    if threshold is None:
        raise ValueError("no healthy windows to fit a threshold on")
    rate = later.agg(F.count("*").alias("n"), share(F.count(F.when(F.col("error") > F.lit(float(threshold)), 1)), F.count("*")).alias("fpr")).first()
    results = incident_results(scores, incidents, threshold, mode, sustain, max_lead).orderBy("case_id").collect()
    return {
        "threshold": threshold, "threshold_source": source, "threshold_quantile": None if source == "override" else quantile, "healthy_fpr": rate["fpr"], "n_windows": scores.count(),
        "n_threshold_windows": fitted, "n_eval_windows": rate["n"], "detection_mode": mode, "sustain": sustain, "incidents": [r.asDict() for r in results],
    }


def report(summary: dict, path: str | None = None) -> tuple[list[str], int]:
    """The summary in words, and the exit code: 1 if an incident had no scored window in its span, which is no verdict."""
    rate = summary["healthy_fpr"]
    lines, code = [f"threshold {summary['threshold']:.6f} by {summary['threshold_source']}, false positives {'n/a' if rate is None else f'{rate:.4f}'} of {summary['n_eval_windows']} windows"], 0
    for i in summary["incidents"]:
        name = f"{i['type']} on {i['resource_id']}"
        if i["detected"]:
            lead = i["lead_time_seconds"]
            lines.append(f"DETECTED {name}: {abs(lead) / 60:.1f} min {'before' if lead >= 0 else 'after'} the onset")
        elif i["max_error_in_window"] is None:
            lines.append(f"error: no scored windows for {name} in its span")
            code = 1
        else:
            lines.append(f"NOT DETECTED {name}")
    if path:
        Path(path).write_text(json.dumps(summary, indent=2, default=str))
    return lines, code
