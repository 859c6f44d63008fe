"""What a metric table holds and how good it is: summary, coverage, gaps, freshness, counters, lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.functions import seconds_between, share
from brightwell.sources import Profile

FRESH_INTERVALS = 4
WORST = 20
MIN_STEPS, NONDECREASING, INCREASING = 50, 0.99, 0.05


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("rows"), F.countDistinct("resource_id").alias("resources"), F.countDistinct("metric_name").alias("metrics"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


def coverage(profiles: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per profile: features, how many the table has, percent (100 for an empty profile), sorted available and missing. profiles: profile, feature (null: empty)."""
    present = metrics.select(F.col("metric_name").alias("feature")).distinct().withColumn("here", F.lit(True))
    joined = profiles.select("profile", "feature").distinct().join(present, "feature", "left")
    known = F.col("feature").isNotNull()
    out = joined.groupBy("profile").agg(
        F.count("feature").alias("total"), F.count(F.when(known & F.col("here"), 1)).alias("available"),
        F.array_sort(F.collect_list(F.when(known & F.col("here"), F.col("feature")))).alias("available_features"),
        F.array_sort(F.collect_list(F.when(known & F.col("here").isNull(), F.col("feature")))).alias("missing_features"),
    )
    return out.withColumn("coverage", F.coalesce(share(100 * F.col("available"), F.col("total")), F.lit(100.0)))


def coverage_gate(covered: DataFrame, least: float = 80.0) -> DataFrame:
    """covered with ready, and a warning that names up to three missing features."""
    named = F.array_join(F.slice("missing_features", 1, 3), ", ")
    warning = F.format_string("%s: %.1f%% of features present, missing %s", "profile", "coverage", named)
    return covered.withColumn("ready", F.col("coverage") >= least).withColumn("warning", F.when(F.col("coverage") < least, warning))


def missing_features(profiles: DataFrame, metrics: DataFrame) -> DataFrame:
    present = metrics.select(F.col("metric_name").alias("feature")).distinct()
    return profiles.where(F.col("feature").isNotNull()).join(present, "feature", "left_anti").select("profile", "feature", "kind", "ordinal")


def series_quality(metrics: DataFrame, reference: datetime | None = None) -> DataFrame:
    """One row a series (resource, metric): points, usual interval (median of the positive gaps), longest gap, density, and how many intervals it is behind the reference (by default the last time of all).

    One shuffle by series serves the gaps and the aggregate. A series of one point has no interval and is neither dense nor live."""
    known = metrics.where(F.col("timestamp").isNotNull())
    at = F.lit(reference).cast("timestamp") if reference else known.agg(F.max("timestamp")).scalar()
    gap = seconds_between(F.col("timestamp"), F.lag("timestamp").over(Window.partitionBy("resource_id", "metric_name").orderBy("timestamp")))
    gaps = known.select("resource_id", "metric_name", "timestamp", gap.alias("gap"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    series = gaps.groupBy("resource_id", "metric_name").agg(F.count("*").alias("points"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.percentile(positive, F.lit(0.5)).alias("interval"), F.max(positive).alias("longest_gap"))
    expected = F.floor(seconds_between(F.col("last_time"), F.col("first_time")) / F.col("interval")) + 1
    series = series.withColumn("density", F.least(F.lit(1.0), F.col("points") / expected)).withColumn("behind", seconds_between(at, F.col("last_time")) / F.col("interval"))
    return series.withColumn("density", F.when(F.col("interval").isNotNull(), F.col("density"))).withColumn("is_live", F.when(F.col("interval").isNotNull(), F.col("behind") <= FRESH_INTERVALS))


def quality_rollup(series: DataFrame) -> DataFrame:
    """Scores over the series that have an interval: 0 if none has."""
    judged = F.col("interval").isNotNull()
    zero = F.lit(0.0)
    return series.agg(
        F.count("*").alias("series"), F.count(F.when(judged, 1)).alias("analyzed"),
        F.coalesce(100 * F.avg(F.col("is_live").cast("int")), zero).alias("freshness_score"),
        F.coalesce(100 * F.avg("density"), zero).alias("gap_score"),
        F.max("last_time").alias("last_time"), seconds_between(F.current_timestamp(), F.max("last_time")).alias("lag_seconds"),
    )


def quality_gate(rollup: DataFrame, freshness: float = 50.0, gaps: float = 80.0) -> DataFrame:
    return rollup.withColumn("ready", (F.col("freshness_score") >= freshness) & (F.col("gap_score") >= gaps))


def stalest(series: DataFrame, n: int = WORST) -> DataFrame:
    return series.where(~F.col("is_live")).orderBy(F.desc("behind"), "resource_id", "metric_name").limit(n)


def gappiest(series: DataFrame, n: int = WORST) -> DataFrame:
    return series.where(F.col("density") < 1).orderBy("density", "resource_id", "metric_name").limit(n)


def counter_shape(metrics: DataFrame, order: str = "ordinal") -> DataFrame:
    """Metrics that look like counters: per (metric, resource, instance), of more than MIN_STEPS values, nearly all steps do not fall and some rise; a metric is flagged if half of its judged series are.

    Of rows of one time the first to arrive counts, and times whose first value is missing do not."""
    key = ["metric_name", "resource_id", "datasource_instance"]
    first = metrics.groupBy(*key, "timestamp").agg(F.min_by("value", order).alias("value")).where(F.col("value").isNotNull())
    step = F.col("value") - F.lag("value").over(Window.partitionBy(*key).orderBy("timestamp"))
    per = first.withColumn("step", step).groupBy(*key).agg(F.count("*").alias("n"), F.avg((F.col("step") >= 0).cast("int")).alias("kept"), F.avg((F.col("step") > 0).cast("int")).alias("rose")).where(F.col("n") > MIN_STEPS)
    hit = ((F.col("kept") >= NONDECREASING) & (F.col("rose") >= INCREASING)).cast("int")
    return per.groupBy("metric_name").agg(F.count("*").alias("judged"), F.sum(hit).alias("hits")).withColumn("is_counter", 2 * F.col("hits") >= F.col("judged"))


def counter_warnings(shapes: DataFrame) -> DataFrame:
    """(metric_name, warning) of the metrics that counter_shape flags."""
    said = F.format_string("%s rises like a counter on %d of %d series; it will leave any fixed range, so it is no feature for a model", "metric_name", "hits", "judged")
    return shapes.where("is_counter").select("metric_name", said.alias("warning"))


def resolve_resource(metrics: DataFrame, wanted: str) -> DataFrame:
    """Resources that an id or host text means: an exact id, else an exact host, else a part of either, all without regard to case. ambiguous: more than one."""
    w = wanted.lower()
    of = metrics.select("resource_id", "host_name").distinct()
    low, host = F.lower("resource_id"), F.lower(F.coalesce("host_name", F.lit("")))
    tier = F.when(low == w, 0).when(host == w, 1).when(low.contains(w) | host.contains(w), 2)
    hits = of.select("resource_id", tier.alias("tier")).where(F.col("tier").isNotNull())
    best = hits.distinct().join(F.broadcast(hits.agg(F.min("tier").alias("_best"))), F.col("tier") == F.col("_best"))  # one row
    return best.withColumn("ambiguous", F.count("*").over(Window.partitionBy("tier")) > 1).select("tier", "resource_id", "ambiguous")


def classify_metrics(metrics: DataFrame, most_levels: int = 10) -> DataFrame:
    """Per metric: categorical if its values are all 0 or 1, or all whole and few; numerical otherwise."""
    v = F.col("value")
    per = metrics.groupBy("metric_name").agg(F.countDistinct("value").alias("levels"), F.bool_and(v.isin(0.0, 1.0)).alias("binary"), F.bool_and(v == F.floor(v)).alias("whole"))
    categorical: Column = F.col("binary") | (F.col("whole") & (F.col("levels") <= most_levels))
    return per.select("metric_name", "levels", F.when(F.coalesce(categorical, F.lit(False)), "categorical").otherwise("numerical").alias("kind"))


# fixed values: floors below which a discovery is worth a warning
LEAST_NUMERICAL, LEAST_CATEGORICAL = 3, 2


def discover_features(metrics: DataFrame, most_numerical: int = 20, most_categorical: int = 15) -> DataFrame:
    """Classified metrics, of each kind at most so many, in order of name."""
    kinds = classify_metrics(metrics)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("metric_name"))
    return kinds.withColumn("ordinal", rank).where(F.col("ordinal") <= F.when(F.col("kind") == "numerical", most_numerical).otherwise(most_categorical))


def discovered_profile(metrics: DataFrame, name: str = "auto_discovered") -> tuple[Profile, list[str]]:
    """A profile of the discovered features, and warnings where a kind has fewer than its floor; an error if one has none."""
    found = discover_features(metrics.where(F.col("value").isNotNull())).orderBy("ordinal").collect()
    of = {k: tuple(r["metric_name"] for r in found if r["kind"] == k) for k in ("numerical", "categorical")}
    if not all(of.values()):
        raise ValueError(f"too few features: {len(of['numerical'])} numerical, {len(of['categorical'])} categorical")
    floors = {"numerical": LEAST_NUMERICAL, "categorical": LEAST_CATEGORICAL}
    return Profile(name, of["numerical"], of["categorical"], "discovered from the metrics at hand"), [f"only {len(of[k])} {k} features, {n} wanted" for k, n in floors.items() if len(of[k]) < n]
