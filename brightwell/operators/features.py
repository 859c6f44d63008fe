"""Long metrics to wide rows, sliding windows, in-window fill, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_wide(metrics: DataFrame, features: Sequence[str], order: str | None = None) -> DataFrame:
    """One row for each (resource, time) with any value of a feature; of several values the first in `order` counts (by default the least). Absent features are null columns."""
    known = metrics.where(F.col("value").isNotNull() & F.col("metric_name").isin(*features))
    own = lambda f, c: F.when(F.col("metric_name") == f, F.col(c))
    of = [F.min_by(own(f, "value"), own(f, order)) if order else F.min(own(f, "value")) for f in features]
    return known.groupBy("resource_id", "timestamp").agg(*(c.alias(f) for c, f in zip(of, features, strict=True)))


def absent_features(metrics: DataFrame, features: Sequence[str]) -> list[str]:
    """Features without any value in the whole capture; a result as small as the profile."""
    have = {r[0] for r in metrics.where(F.col("value").isNotNull() & F.col("metric_name").isin(*features)).select("metric_name").distinct().collect()}
    return [f for f in features if f not in have]


def _copied(ranked: DataFrame, size: int, step: int) -> DataFrame:
    """Rows with _rn and _n, their place and count in the resource, once for each window that holds them."""
    lo = F.greatest(F.lit(0), F.floor((F.col("_rn") - size + step - 1) / step)).cast("int")
    hi = F.floor(F.least(F.col("_rn") - 1, F.col("_n") - size) / step).cast("int")
    return ranked.where(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi))).withColumn("pos", F.col("_rn") - F.col("window_id") * step - 1)


def window_rows(wide: DataFrame, size: int, step: int = 1) -> DataFrame:
    """wide once for each sliding window that holds the row: window_id (starts at row window_id * step of its resource) and pos (0 to size - 1).

    Windows count rows of a resource, not time. A row is copied to size / step windows at most."""
    by = Window.partitionBy("resource_id")
    ranked = wide.withColumns({"_rn": F.row_number().over(by.orderBy("timestamp")), "_n": F.count("*").over(by)})
    return _copied(ranked, size, step).drop("_rn", "_n")


def filled_windows(wide: DataFrame, features: Sequence[str], size: int, step: int = 1) -> DataFrame:
    """window_rows without missing values: within a window the last before, else the first after, else 0. Never across windows.

    What is known last and next, and at which row, is looked up once for each row of a resource, before rows are copied; a copy only asks whether that row lies in its window."""
    order = Window.partitionBy("resource_id").orderBy("timestamp")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = wide.withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("resource_id"))})
    known = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col("_rn").alias("at"), F.col(f).alias("x")))
    ranked = ranked.withColumns({f"_{side}_{f}": g(known(f), ignorenulls=True).over(w) for f in features for side, g, w in (("back", F.last, back), ("ahead", F.first, ahead))})
    start = F.col("_rn") - F.col("pos")
    filled = {f: F.when(F.col(f"_back_{f}.at") >= start, F.col(f"_back_{f}.x")).when(F.col(f"_ahead_{f}.at") < start + size, F.col(f"_ahead_{f}.x")).otherwise(F.lit(0.0)) for f in features}
    return _copied(ranked, size, step).withColumns(filled).drop("_rn", "_n", *(f"_{side}_{f}" for f in features for side in ("back", "ahead")))


def window_arrays(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row a window: end_time and x, the values by position and feature; for scorers that take a window whole."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "timestamp", F.array(*features).alias("x"))))
    out = rows.groupBy("resource_id", "window_id").agg(packed.alias("p"))
    return out.select("resource_id", "window_id", F.element_at("p", -1)["timestamp"].alias("end_time"), F.transform("p", lambda s: s["x"]).alias("x"))


def fit_zscore(filled: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std) over windowed rows, overlaps counted each time; std 0 becomes 1."""
    sums = filled.agg(*(F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features))
    long = sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "p"))
    return long.select("feature", "p.mean", F.when(F.col("p.std") == 0, 1.0).otherwise(F.col("p.std")).alias("std"))


def _one_row(params: DataFrame, features: Sequence[str], *names: str) -> DataFrame:
    """Parameters by feature as one row, so that they can be joined where the rows are."""
    return F.broadcast(params.agg(*(F.max(F.when(F.col("feature") == f, F.col(n))).alias(f"_{n}_{f}") for f in features for n in names)))


def apply_zscore(filled: DataFrame, params: DataFrame, features: Sequence[str], absent: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / std by feature name; features that the capture lacks are 0."""
    with_params = filled.join(_one_row(params, features, "mean", "std"))
    scaled = {f: F.lit(0.0) if f in absent else (F.col(f) - F.col(f"_mean_{f}")) / F.col(f"_std_{f}") for f in features}
    return with_params.withColumns(scaled).drop(*(f"_{n}_{f}" for f in features for n in ("mean", "std")))


def fit_minmax(filled: DataFrame, features: Sequence[str]) -> DataFrame:
    sums = filled.agg(*(F.struct(F.min(F.coalesce(f, F.lit(0.0))).alias("low"), F.max(F.coalesce(f, F.lit(0.0))).alias("high")).alias(f) for f in features))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "p")).select("feature", "p.low", "p.high")


def apply_minmax(rows: DataFrame, params: DataFrame, features: Sequence[str], clip: bool = False, absent: Sequence[str] = ()) -> DataFrame:
    """(x - low) / (high - low); a constant feature is 1 if it is above 0, else 0. clip: into [0, 1], as when serving."""
    out = {}
    for f in features:
        x, low, high = F.coalesce(F.col(f), F.lit(0.0)), F.col(f"_low_{f}"), F.col(f"_high_{f}")
        y = F.when(high > low, (x - low) / (high - low)).otherwise((high > 0).cast("double"))
        out[f] = F.lit(0.0) if f in absent else F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) if clip else y
    return rows.join(_one_row(params, features, "low", "high")).withColumns(out).drop(*(f"_{n}_{f}" for f in features for n in ("low", "high")))


def series_frame(requests: DataFrame, base: str = "2000-01-01 00:00:00") -> DataFrame:
    """Request series (request_id, metrics map<string, array<double>>) as long rows on a one-minute grid, all series ending at the same minute."""
    each = requests.select("request_id", F.explode("metrics").alias("metric_name", "values"), F.aggregate(F.map_values("metrics"), F.lit(0), lambda a, v: F.greatest(a, F.size(v))).alias("longest"))
    rows = each.select("request_id", "metric_name", "longest", F.size("values").alias("n"), F.posexplode("values").alias("pos", "value"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + 60 * (F.col("longest") - F.col("n") + F.col("pos")))
    return rows.select(F.col("request_id").alias("resource_id"), "metric_name", at.alias("timestamp"), "value")
