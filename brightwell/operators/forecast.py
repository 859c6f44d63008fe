"""Drift, forecast intervals, forecast accuracy, cluster stability."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwell.functions import severity_of_violation, share

BINS, EPSILON, DRIFTED = 10, 1e-10, 0.2
DELTA, SIDE = 0.01, 30
HISTORY = 500


def psi(reference: DataFrame, current: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index by feature over shared bins of equal width. Inputs: feature, value. Bins that are empty count as EPSILON."""
    both = reference.select("feature", "value", F.lit(0).alias("side")).unionAll(current.select("feature", "value", F.lit(1).alias("side"))).where(F.col("value").isNotNull())
    edges = both.groupBy("feature").agg((F.min("value") - EPSILON).alias("low"), (F.max("value") + EPSILON).alias("high"), F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
    placed = both.join(F.broadcast(edges.select("feature", "low", "high")), "feature")  # a row a feature
    placed = placed.withColumn("bin", F.least(F.floor((F.col("value") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)))
    counted = placed.groupBy("feature", "bin").agg(F.count(F.when(F.col("side") == 0, 1)).alias("c0"), F.count(F.when(F.col("side") == 1, 1)).alias("c1"))
    dense = edges.select("feature", "n0", "n1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).join(counted, ["feature", "bin"], "left")
    r, c = (F.coalesce(F.try_divide(F.col(f"c{k}").cast("double"), F.col(f"n{k}")), F.lit(0.0)) + EPSILON for k in (0, 1))
    return dense.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi")).withColumn("drifted", F.col("psi") >= DRIFTED)


def change_point(errors: DataFrame, by: Sequence[str], side: int = SIDE, delta: float = DELTA) -> DataFrame:
    """One row for each error stream (by, ordinal, error): has_drift, change_point_index, score, threshold, mean_before, mean_after.

    At each split the means of `side` errors before and from it are compared in units of their spread; there is drift if the largest such score, the first of equal ones, exceeds -ln(delta). The means are of all errors before and from that split. Streams of fewer than 2 * side errors have no score and their mean twice; a stream without spread anywhere scores 0."""
    order = Window.partitionBy(*by).orderBy("ordinal")
    before, after, so_far = order.rowsBetween(-side, -1), order.rowsBetween(0, side - 1), order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    at = errors.withColumns({
        "i": F.row_number().over(order) - 1, "n": F.count("*").over(whole), "all": F.sum("error").over(whole), "head": F.coalesce(F.sum("error").over(so_far), F.lit(0.0)),
        "m0": F.avg("error").over(before), "m1": F.avg("error").over(after), "v0": F.var_pop("error").over(before), "v1": F.var_pop("error").over(after),
    })
    inside = (F.col("i") >= side) & (F.col("i") < F.col("n") - side)
    score = F.abs(F.col("m1") - F.col("m0")) / F.sqrt(((F.col("v0") + F.col("v1")) / 2 + EPSILON) * (2 / side))
    best = F.max(F.when(inside & (score > 0), F.struct(score.alias("score"), (-F.col("i")).alias("back"), "head")))
    out = at.groupBy(*by).agg(best.alias("best"), F.max("n").alias("n"), F.max("all").alias("all"))
    split, long = -F.col("best.back"), F.col("n") >= 2 * side
    mean = F.col("all") / F.col("n")
    return out.select(
        *by, F.coalesce(F.col("best.score") > -math.log(delta), F.lit(False)).alias("has_drift"),
        F.when(F.col("best.score") > -math.log(delta), split).alias("change_point_index"),
        F.when(long, F.coalesce("best.score", F.lit(0.0))).alias("score"), F.when(long, F.lit(-math.log(delta))).alias("threshold"),
        F.coalesce(F.col("best.head") / split, mean).alias("mean_before"), F.coalesce((F.col("all") - F.col("best.head")) / (F.col("n") - split), mean).alias("mean_after"),
    )


def interval_anomaly(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Forecast violations by group: rows have metric_name, actual, lower, upper. Each metric's violation is in interval widths; a group has its worst, the metrics that violate, and a band."""
    width = F.greatest(F.col("upper") - F.col("lower"), F.lit(EPSILON))
    violation = F.greatest((F.col("actual") - F.col("upper")) / width, (F.col("lower") - F.col("actual")) / width, F.lit(0.0))
    per = rows.withColumn("violation", violation).groupBy(*by).agg(F.max("violation").alias("score"), F.array_sort(F.collect_list(F.when(F.col("violation") > 0, F.col("metric_name")))).alias("violated"))
    return per.withColumns({"is_anomaly": F.col("score") > 0, "severity": severity_of_violation(F.col("score"))})


def residuals(rows: DataFrame) -> DataFrame:
    """Forecast rows with residual (actual - median) and interval width: the features that enrich a window."""
    return rows.withColumns({"residual": F.col("actual") - F.col("median"), "width": F.col("upper") - F.col("lower")})


def naive_forecast(series: DataFrame, history: int = 60) -> DataFrame:
    """An empirical-quantile forecast for each row from the `history` rows before it: median, lower (0.1), upper (0.9). A stand-in where no pretrained model is at hand."""
    before = Window.partitionBy("resource_id", "metric_name").orderBy("timestamp").rowsBetween(-history, -1)
    q = {"median": 0.5, "lower": 0.1, "upper": 0.9}
    return series.withColumns({k: F.percentile("value", F.lit(v)).over(before) for k, v in q.items()}).withColumnRenamed("value", "actual").where(F.col("median").isNotNull())


# fixed values: steps ahead, and the quantiles of a forecast
HORIZONS = (15, 60, 240, 1440)
LEVELS = {"lower": 0.1, "median": 0.5, "upper": 0.9}


def history_arrays(series: DataFrame, history: int = HISTORY, by: Sequence[str] = ("resource_id", "metric_name")) -> DataFrame:
    """(by, made_at, values): the last `history` values of each series in order of time. A row a series; only so many values of each leave a task."""
    last = recent(series.where(F.col("value").isNotNull()), by, "timestamp", history)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "value"))), lambda s: s["value"])
    return last.groupBy(*by).agg(F.max("timestamp").alias("made_at"), ordered.alias("values"))


def forecast_horizons(series: DataFrame, horizons: Sequence[int] = HORIZONS, load: Callable[[], Callable] | None = None, history: int = HISTORY, by: Sequence[str] = ("resource_id", "metric_name")) -> DataFrame:
    """(by, made_at, horizon, lower, median, upper), rounded to four digits: a forecast of each series at each horizon.

    load() is called once a Python worker and gives a function from a list of histories and a length to a dict of arrays (series, length) of LEVELS. Without it, the forecast is the last history's quantiles at every horizon: a stand-in that needs no Python."""
    known = history_arrays(series, history, by)
    if load is None:
        place = {k: (F.size("values") - 1) * F.lit(q) for k, q in LEVELS.items()}
        ordered = known.withColumn("_x", F.array_sort("values"))
        value = lambda i: F.element_at("_x", (i + 1).cast("int"))
        at = {k: value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * (p - F.floor(p)) for k, p in place.items()}
        rows = ordered.withColumns(at).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    else:
        kind = "array<struct<horizon int, lower double, median double, upper double>>"

        @F.pandas_udf(kind)
        def ahead(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for values in batches:
                got = model([np.asarray(v, float) for v in values], max(horizons)) if len(values) else None
                yield pd.Series([[{"horizon": h, **{k: float(got[k][i][h - 1]) for k in LEVELS}} for h in horizons] for i in range(len(values))])

        rows = known.withColumn("_f", F.explode(ahead("values"))).select(*by, "made_at", "_f.*")
    return rows.select(*by, "made_at", "horizon", *(F.round(k, 4).alias(k) for k in LEVELS))


def with_actuals(forecasts: DataFrame, series: DataFrame, interval: float = 60.0, by: Sequence[str] = ("resource_id", "metric_name")) -> DataFrame:
    """forecasts with the value that was seen `horizon` intervals after each was made, if one was: an equi-join on series and time."""
    seen = series.select(*by, F.col("timestamp").alias("_at"), F.col("value").alias("actual"))
    due = forecasts.withColumn("_at", F.timestamp_micros(F.unix_micros("made_at") + (F.col("horizon") * F.lit(interval) * 1_000_000).cast("long")))
    return due.join(seen, [*by, "_at"]).withColumnRenamed("_at", "timestamp")


def enrich(rows: DataFrame, features: Sequence[str], horizons: Sequence[int] = HORIZONS, forecasts: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Window rows with a residual and an interval width for each feature and horizon, and these columns' names, residuals first.

    forecasts: feature, horizon, lower, median, upper of each feature's mean window. A residual is that mean window's mean less the median. Without forecasts all are 0."""
    names = [f"{kind}_{f}_{h}" for kind in ("residual", "width") for f in features for h in horizons]
    if forecasts is None:
        return rows.withColumns({n: F.lit(0.0) for n in names}), names
    mean = rows.groupBy("pos").agg(*(F.avg(f).alias(f) for f in features)).agg(*(F.avg(f).alias(f"_mean_{f}") for f in features))
    pick = lambda f, h, c: F.max(F.when((F.col("feature") == f) & (F.col("horizon") == h), c))
    told = forecasts.agg(*(x for f in features for h in horizons for x in (pick(f, h, F.col("median")).alias(f"_m_{f}_{h}"), pick(f, h, F.col("upper") - F.col("lower")).alias(f"_w_{f}_{h}"))))
    one = mean.join(told).select(*((F.col(f"_mean_{f}") - F.col(f"_m_{f}_{h}")).alias(f"residual_{f}_{h}") for f in features for h in horizons), *(F.col(f"_w_{f}_{h}").alias(f"width_{f}_{h}") for f in features for h in horizons))
    return rows.join(F.broadcast(one)), names  # one row


def mean_windows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, timestamp, value): the mean window of each feature, by position as seconds, for forecast_horizons by feature."""
    mean = rows.groupBy("pos").agg(*(F.avg(f).alias(f) for f in features))
    long = mean.select("pos", F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "value"))
    return long.select("feature", F.timestamp_seconds("pos").alias("timestamp"), "value")


def at_horizons(forecasts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Forecast arrays (median, lower, upper) to a row for each horizon, the h-th value each."""
    each = forecasts.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return each.withColumns({c: F.try_element_at(c, F.col("horizon")) for c in ("median", "lower", "upper")})


def drift_report(reference: DataFrame, current: DataFrame, errors: DataFrame, by: Sequence[str], limit: float = DRIFTED) -> DataFrame:
    """One row an error stream (by, ordinal, error): drift of the features (psi of each, the largest), which all streams share, and of its errors, and when it was looked at."""
    by_feature = psi(reference, current).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("psi_per_feature"), F.max("psi").alias("max_psi"))
    of_features = by_feature.select(F.struct((F.col("max_psi") >= limit).alias("has_drift"), "psi_per_feature", "max_psi", F.lit(limit).alias("threshold")).alias("feature_drift"))
    of_errors = change_point(errors, by).select(*by, F.struct("has_drift", "change_point_index", "score", "threshold", "mean_before", "mean_after").alias("prediction_drift"))
    return of_errors.join(F.broadcast(of_features)).withColumn("timestamp", F.current_timestamp())  # one row


def accuracy_report(forecasts: DataFrame, clusters: DataFrame, order: str = "ordinal", history: int = HISTORY) -> DataFrame:
    """One row: accuracy by horizon, stability of the cluster stream (share of the commonest in percent), how many observations of it, and when it was looked at. Both streams count by their last `history` rows."""
    per = accuracy(forecasts, order, history).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", F.struct("picp", "mpiw", "mae", "mase"))))).alias("horizons"))
    last = recent(clusters.withColumn("_stream", F.lit(0)), ["_stream"], order, history)
    s = cluster_stability(last, ["_stream"], order)
    stable = s.agg(F.struct(F.coalesce(F.max("transition_rate"), F.lit(0.0)).alias("transition_rate"), F.coalesce(F.max("confidence_std"), F.lit(0.0)).alias("confidence_std"), F.coalesce(100 * F.max("dominant_share"), F.lit(0.0)).alias("dominant_cluster_pct")).alias("stability"), F.coalesce(F.max("n"), F.lit(0)).alias("observation_count"))
    return per.join(stable).withColumn("timestamp", F.current_timestamp())


def recent(rows: DataFrame, by: Sequence[str], order: str, n: int = HISTORY) -> DataFrame:
    """The last n rows of each group; tasks send on no more than n of a group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def accuracy(rows: DataFrame, order: str = "ordinal", history: int = HISTORY) -> DataFrame:
    """Per horizon over the last observations (actual, median, lower, upper): coverage, mean width, mean absolute error, and that error over the error of repeating the last value (null for fewer than two, or where that hardly errs)."""
    kept = recent(rows, ["horizon"], order, history)
    step = F.abs(F.col("actual") - F.lag("actual").over(Window.partitionBy("horizon").orderBy(order)))
    out = kept.withColumn("_step", step).groupBy("horizon").agg(F.count("*").alias("n"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("int")).alias("picp"), F.avg(F.col("upper") - F.col("lower")).alias("mpiw"), F.avg(F.abs(F.col("actual") - F.col("median"))).alias("mae"), F.avg("_step").alias("_naive"))
    return out.withColumn("mase", F.when((F.col("n") >= 2) & (F.col("_naive") >= EPSILON), F.col("mae") / F.col("_naive"))).drop("_naive")


def accuracy_status(accurate: DataFrame) -> DataFrame:
    """One flat row a horizon, missing as 0, rounded half to even."""
    return accurate.select("horizon", *(F.bround(F.coalesce(c, F.lit(0.0)), d).alias(c) for c, d in (("picp", 4), ("mpiw", 4), ("mae", 4), ("mase", 4))))


def cluster_stability(rows: DataFrame, by: Sequence[str], order: str = "ordinal") -> DataFrame:
    """Per stream (by): share of steps that change cluster, spread of confidence, and share of the commonest cluster. rows: by, order, cluster_id, confidence."""
    moved = (F.col("cluster_id") != F.lag("cluster_id").over(Window.partitionBy(*by).orderBy(order))).cast("int")
    out = rows.withColumn("_moved", moved).groupBy(*by).agg(F.avg("_moved").alias("transition_rate"), F.stddev_pop("confidence").alias("confidence_std"), F.count("*").alias("n"))
    sizes = rows.groupBy(*by, "cluster_id").agg(F.count("*").alias("size")).groupBy(*by).agg(F.max("size").alias("_top"))
    return out.join(sizes, list(by)).withColumn("dominant_share", share(F.col("_top"), F.col("n"))).drop("_top")
