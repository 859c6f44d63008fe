"""Alarm runs, detection of labelled incidents, and the rates that make an alarm bearable.

flagged: scores with threshold, flag (error > threshold). Runs are maximal stretches of
consecutive flagged windows of a resource; with sustain s only those of s windows or more count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.functions import seconds_between, share

SUSTAINS = (3, 1)
LEAD_IN = 86_400
MAX_LEAD = 7_200
WEEK = 604_800


def flag(scores: DataFrame) -> DataFrame:
    return scores.withColumn("flag", F.coalesce(F.col("error") > F.col("threshold"), F.lit(False)))


def runs(flagged: DataFrame, by: Sequence[str] = ("resource_id",)) -> DataFrame:
    """(by, run_start, run_end, length, first_row): a run is an island of equal difference of two row numbers."""
    order = ("end_time", "window_id")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    among = F.row_number().over(Window.partitionBy(*by, "flag").orderBy(*order))
    islands = flagged.withColumns({"_place": place, "_island": place - among}).where("flag")
    return islands.groupBy(*by, "_island").agg(F.min("end_time").alias("run_start"), F.max("end_time").alias("run_end"), F.count("*").alias("length"), F.min("_place").alias("first_row")).drop("_island")


def sustained(found: DataFrame, sustain: int) -> DataFrame:
    return found.where(F.col("length") >= sustain)


def by_sustain(found: DataFrame, sustains: Sequence[int] = SUSTAINS) -> DataFrame:
    """found once for each accounting that a run's length admits."""
    return found.withColumn("sustain", F.explode(F.array(*map(F.lit, sustains)))).where(F.col("length") >= F.col("sustain"))


def scan_windows(flagged: DataFrame, incidents: DataFrame, max_lead: int = MAX_LEAD) -> DataFrame:
    """Windows of [anchor - max_lead, end] of each incident. incidents: case_id, resource_id, anchor, end."""
    on = flagged.join(incidents.withColumnRenamed("end", "incident_end"), "resource_id")
    t = F.unix_micros("end_time")
    return on.where((t >= F.unix_micros("anchor") - max_lead * 1_000_000) & (t <= F.unix_micros("incident_end")))


def detect(flagged: DataFrame, incidents: DataFrame, mode: str = "lookback", sustain: int = 3, max_lead: int = MAX_LEAD) -> DataFrame:
    """One row an incident: detected, detection_time, lead_seconds, bridged, runs before and from the anchor.

    lookback: a run that is on at the anchor, or ended no more than a median step before it, detects when it starts; otherwise the first run that ends at the anchor or later. no_bridging: the first run that starts at the anchor or later."""
    scanned = scan_windows(flagged, incidents, max_lead)
    key = ("case_id", "resource_id")
    gap = seconds_between(F.col("end_time"), F.lag("end_time").over(Window.partitionBy(*key).orderBy("end_time", "window_id")))
    step = scanned.withColumn("_gap", gap).groupBy("case_id").agg(F.coalesce(F.percentile("_gap", F.lit(0.5)), F.lit(0.0)).alias("step"))
    found = sustained(runs(scanned, key), sustain)
    all_ = incidents.select("case_id", "resource_id", "anchor").join(step, "case_id", "left").join(found.drop("resource_id"), "case_id", "left")
    start, end, anchor = (F.unix_micros(c) / 1e6 for c in ("run_start", "run_end", "anchor"))
    if mode == "lookback":
        at = F.coalesce(F.min(F.when((start <= anchor) & (end >= anchor - F.col("step")), F.col("run_start"))), F.min(F.when(end >= anchor, F.col("run_start"))))
    elif mode == "no_bridging":
        at = F.min(F.when(start >= anchor, F.col("run_start")))
    else:
        raise ValueError(f"no such mode: {mode}")
    out = all_.groupBy(*key, "anchor").agg(
        at.alias("detection_time"),
        F.coalesce(F.bool_or((start < anchor) & (end >= anchor)), F.lit(False)).alias("bridged"),
        F.count(F.when(start < anchor, 1)).alias("runs_before"), F.count(F.when(start >= anchor, 1)).alias("runs_from"),
    )
    return out.withColumns({"detected": F.col("detection_time").isNotNull(), "lead_seconds": seconds_between(F.col("anchor"), F.col("detection_time"))})


def onset_leads(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, onset, lead_seconds): one detection against every named onset. labels: case_id, onsets map."""
    each = labels.select("case_id", F.explode("onsets").alias("onset", "onset_time"))
    return each.join(detections.select("case_id", "detection_time"), "case_id").withColumn("lead_seconds", seconds_between(F.col("onset_time"), F.col("detection_time")))


def slice_stats(scores: DataFrame, slices: DataFrame, sustain: int = 3) -> DataFrame:
    """Per slice (slice_id, resource_id, start, end, threshold; both ends belong): windows, max and mean error, how many are over the threshold and in how many sustained runs. Runs are those of the slice alone."""
    inside = scores.select("resource_id", "end_time", "window_id", "error").join(slices, "resource_id").where((F.col("end_time") >= F.col("start")) & (F.col("end_time") <= F.col("end")))
    inside = flag(inside)
    per = inside.groupBy("slice_id").agg(F.count("*").alias("n"), F.max("error").alias("max_error"), F.avg("error").alias("mean_error"), F.count(F.when(F.col("flag"), 1)).alias("over"))
    found = sustained(runs(inside, ("slice_id",)), sustain).groupBy("slice_id").agg(F.count("*").alias("runs"))
    out = slices.select("slice_id", "resource_id", "threshold").join(per, "slice_id", "left").join(found, "slice_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "over", "runs")}).withColumn("over_share", share(F.col("over"), F.col("n")))


def lead_in_rates(flagged: DataFrame, incidents: DataFrame, lead_in: int = LEAD_IN, sustains: Sequence[int] = SUSTAINS) -> DataFrame:
    """(case_id, sustain, covered, windows, fpr): of the windows of [primary - lead_in, primary), those in a sustained run."""
    on = flagged.join(incidents, "resource_id")
    t, primary = F.unix_micros("end_time"), F.unix_micros("anchor")
    lead = on.where((t >= primary - lead_in * 1_000_000) & (t < primary))
    n = lead.groupBy("case_id").agg(F.count("*").alias("windows"))
    covered = by_sustain(runs(lead, ("case_id",)), sustains).groupBy("case_id", "sustain").agg(F.sum("length").alias("covered"))
    grid = incidents.select("case_id", F.explode(F.array(*map(F.lit, sustains))).alias("sustain"))
    out = grid.join(n, "case_id", "left").join(covered, ["case_id", "sustain"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("windows", "covered")})
    return out.withColumn("fpr", share(F.col("covered"), F.col("windows")))


def pooled_lead_in(rates: DataFrame) -> DataFrame:
    """Per sustain, covered over windows of all incidents; not the mean of their rates."""
    return rates.groupBy("sustain").agg(F.sum("covered").alias("covered"), F.sum("windows").alias("windows")).withColumn("fpr", share(F.col("covered"), F.col("windows")))


def incident_coverage(found: DataFrame, incidents: DataFrame) -> DataFrame:
    """Share of an incident's time that runs cover, and how long before its end the last one cleared. Touching is no overlap."""
    joined = incidents.join(found, "resource_id", "left")
    low, high = F.greatest("run_start", "anchor"), F.least("run_end", "end")
    overlap = seconds_between(high, low)
    out = joined.groupBy("case_id", "resource_id", "anchor", "end").agg(F.coalesce(F.sum(F.when(overlap > 0, overlap)), F.lit(0.0)).alias("covered_seconds"), F.max(F.when(overlap > 0, F.col("run_end"))).alias("last_clear"))
    return out.withColumns({"coverage": share(F.col("covered_seconds"), seconds_between(F.col("end"), F.col("anchor"))), "clear_lead_seconds": seconds_between(F.col("end"), F.col("last_clear"))})


def alarm_fatigue(flagged: DataFrame, sustains: Sequence[int] = SUSTAINS, cadence: float | None = None) -> DataFrame:
    """Per resource and sustain: seconds in alarm (each run lasts a step beyond its last window: the cadence, else the median one), share of the span, runs a week; null for a span of 0."""
    from brightwell.operators.scoring import effective_step

    spans = flagged.groupBy("resource_id").agg(seconds_between(F.max("end_time"), F.min("end_time")).alias("span_seconds"), F.count("*").alias("windows"))
    steps = effective_step(flagged) if cadence is None else flagged.select("resource_id").distinct().withColumn("step", F.lit(float(cadence)))
    base = spans.join(steps, "resource_id").withColumn("sustain", F.explode(F.array(*map(F.lit, sustains))))
    found = by_sustain(runs(flagged), sustains).withColumn("lasts", seconds_between(F.col("run_end"), F.col("run_start")))
    per = found.groupBy("resource_id", "sustain").agg(F.count("*").alias("runs"), F.sum("lasts").alias("lasts"))
    out = base.join(per, ["resource_id", "sustain"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    out = out.withColumn("alarm_seconds", F.coalesce("lasts", F.lit(0.0)) + F.col("runs") * F.col("step")).drop("lasts")
    return out.withColumns({"time_in_alarm": share(F.col("alarm_seconds"), F.col("span_seconds")), "runs_per_week": share(F.col("runs") * WEEK, F.col("span_seconds"))})


def fleet_alarms(per_resource: DataFrame) -> DataFrame:
    """Per sustain over the fleet: alarm time over span time, and the sum of the rates."""
    return per_resource.groupBy("sustain").agg(F.count("*").alias("resources"), share(F.sum("alarm_seconds"), F.sum("span_seconds")).alias("time_in_alarm"), F.sum(F.coalesce("runs_per_week", F.lit(0.0))).alias("runs_per_week"))


def fleet_report(flagged: DataFrame, sustain: int = 3) -> DataFrame:
    """Per resource and, as resource GLOBAL, over all: windows, false-positive rate, runs (summed, not found anew), and runs a week of the span."""
    per = flagged.groupBy("resource_id").agg(F.count("*").alias("windows"), F.count(F.when(F.col("flag"), 1)).alias("over"), F.min("end_time").alias("first"), F.max("end_time").alias("last"))
    n = sustained(runs(flagged), sustain).groupBy("resource_id").agg(F.count("*").alias("runs"))
    per = per.join(n, "resource_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    whole = per.agg(F.lit("GLOBAL").alias("resource_id"), F.sum("windows").alias("windows"), F.sum("over").alias("over"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("runs").alias("runs"))
    both = per.unionByName(whole.where(F.col("windows").isNotNull()))
    span = seconds_between(F.col("last"), F.col("first"))
    return both.withColumns({"fpr": share(F.col("over"), F.col("windows")), "runs_per_week": share(F.col("runs") * WEEK, span)})


def control_slices(scores: DataFrame, controls: DataFrame, incident: DataFrame, thresholds: DataFrame, sustain: int = 3) -> DataFrame:
    """slice_stats of control resources over the one incident's window, at their own and at the incident's threshold. incident: resource_id, start, end; thresholds: resource_id, threshold."""
    if incident.limit(2).count() > 1:
        raise NotImplementedError("controls are compared with one incident")
    one = incident.join(thresholds.withColumnRenamed("threshold", "incident_threshold"), "resource_id").select("start", "end", "incident_threshold")
    own = controls.select("resource_id").join(thresholds, "resource_id").join(F.broadcast(one.limit(1)))
    kinds: list[Column] = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("threshold")) for k, c in (("own", "threshold"), ("incident", "incident_threshold"))]
    slices = own.select("resource_id", "start", "end", F.explode(F.array(*kinds)).alias("k")).select(F.concat_ws("/", "resource_id", "k.kind").alias("slice_id"), "resource_id", "start", "end", "k.threshold")
    return slice_stats(scores, slices, sustain)


def roles(resources: DataFrame, labels: DataFrame) -> DataFrame:
    """resources with their role; those without a label are excluded."""
    return resources.join(labels.select("resource_id", "role"), "resource_id", "left").withColumn("role", F.coalesce("role", F.lit("excluded")))
