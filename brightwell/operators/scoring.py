"""Scorers of windows, time splits, cadence grids, quantile thresholds and their policies.

A scorer turns normalised window rows into (resource_id, window_id, end_time, error), the mean
over steps and features of the squared reconstruction error. What comes after needs only that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightwell.functions import seconds_between, severity_of_ratio, share, small_table

QUANTILE = 0.99
LEAST_WINDOWS = 50
SERVING_CADENCE = 600


class Scorer(Protocol):
    def __call__(self, rows: DataFrame, features: Sequence[str]) -> DataFrame: ...


def _mean(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)


def score_training_mean(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The reconstruction is the training mean, 0 after normalisation."""
    error = _mean([F.avg(F.col(f) * F.col(f)) for f in features])
    return rows.groupBy("resource_id", "window_id").agg(F.max("timestamp").alias("end_time"), error.alias("error"))


def score_window_mean(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The reconstruction is the window's own mean: large while a window mixes two states."""
    error = _mean([F.var_pop(f) for f in features])
    return rows.groupBy("resource_id", "window_id").agg(F.max("timestamp").alias("end_time"), error.alias("error"))


def pca_scorer(k: int = 3) -> Scorer:
    """A linear auto-encoder: flattened windows through the first k principal axes and back."""

    def score(rows: DataFrame, features: Sequence[str]) -> DataFrame:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        from brightwell.operators.features import window_arrays

        flat = window_arrays(rows, features).withColumn("v", F.flatten("x"))
        model = PCA(k=k, inputCol="vec", outputCol="z").fit(flat.withColumn("vec", array_to_vector("v")))
        axes = model.pc.toArray()  # window length x features by k
        n = axes.shape[0]
        dots = [F.aggregate(F.zip_with("v", F.array(*(F.lit(float(a)) for a in axes[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(axes.shape[1])]
        coded = flat.withColumn("z", F.array(*dots))
        total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
        kept = F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b)  # the axes are orthonormal
        return coded.select("resource_id", "window_id", "end_time", (F.greatest(total - kept, F.lit(0.0)) / n).alias("error"))

    return score


def pandas_scorer(load: Callable[[], Callable]) -> Scorer:
    """A learned model: load() is called once in each Python worker and gives a function from a (windows, steps, features) array to errors."""

    def score(rows: DataFrame, features: Sequence[str]) -> DataFrame:
        from collections.abc import Iterator

        import numpy as np
        import pandas as pd

        from brightwell.operators.features import window_arrays

        @F.pandas_udf("double")
        def errors(windows: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for w in windows:
                yield pd.Series(model(np.array([np.stack(x) for x in w])) if len(w) else [])

        return window_arrays(rows, features).select("resource_id", "window_id", "end_time", errors("x").alias("error"))

    return score


def on_stride(scores: DataFrame, stride: int) -> DataFrame:
    """The windows that a coarser step would have made: those whose id is a multiple."""
    return scores.where(F.col("window_id") % stride == 0)


def on_cadence(scores: DataFrame, seconds: int = SERVING_CADENCE) -> DataFrame:
    """The windows that a poll on a wall-clock lattice would see: at each tick the last one that has ended, once.

    Closed form of the as-of join: a window is seen iff the first tick at or after its end comes before the next window's end, and is no later than the last tick of all resources."""
    end = F.unix_seconds("end_time")
    tick = F.ceil(end / seconds) * seconds
    following = F.lead(end).over(Window.partitionBy("resource_id").orderBy("end_time", "window_id"))
    last = scores.agg(F.floor(F.max(end) / seconds) * seconds).scalar()
    return scores.withColumn("_next", following).where((tick <= last) & (F.col("_next").isNull() | (tick < F.col("_next")))).drop("_next")


def time_split(scores: DataFrame, gap: int = 0, per_resource: bool = True) -> DataFrame:
    """scores with part: fit (earlier half), eval (later half after `gap` windows) or null. Fewer than two windows are all fit.

    Over all resources, a window's rank is its rank among those that end with it plus the number that end before, so only the counts of distinct times are summed in one place."""
    if per_resource:
        by = Window.partitionBy("resource_id")
        ranked = scores.withColumns({"_rank": F.row_number().over(by.orderBy("end_time", "window_id")), "_all": F.count("*").over(by)})
    else:
        times = scores.groupBy("end_time").agg(F.count("*").alias("_here"))
        everything = Window.orderBy("end_time")
        times = times.select(F.col("end_time").alias("_at"), (F.sum("_here").over(everything) - F.col("_here")).alias("_before"), F.sum("_here").over(Window.partitionBy()).alias("_all"))
        here = F.row_number().over(Window.partitionBy("end_time").orderBy("resource_id", "window_id"))
        ranked = scores.join(times, F.col("end_time").eqNullSafe(F.col("_at"))).withColumn("_rank", F.col("_before") + here).drop("_at", "_before")
    rank, n, half = F.col("_rank"), F.col("_all"), F.floor(F.col("_all") / 2)
    return ranked.withColumn("part", F.when((n < 2) | (rank <= half), "fit").when(rank > half + gap, "eval")).drop("_rank", "_all")


def gap_windows(size: int, step: int) -> int:
    return -(-size // step)


BRACKET = 10_000  # accuracy of the bracket around a quantile
EXACT_ROWS = 100_000  # up to so many errors are looked at all together


def pooled_quantile(scores: DataFrame, quantile: float) -> DataFrame:
    """One row (threshold, n): the exact, interpolated quantile of all errors.

    Two approximate quantiles bracket it; errors below are counted and only those inside, some 1 / 2500 of all, come to one task."""
    few = F.col("n") <= EXACT_ROWS
    at = [min(max(quantile + d / BRACKET, 0.0), 1.0) for d in (-2, 2)]
    known = scores.select("error").where(F.col("error").isNotNull())
    near = known.agg(F.count("*").alias("n"), F.percentile_approx("error", at, BRACKET).alias("p"), F.min("error").alias("low"), F.max("error").alias("high"))
    near = near.select("n", F.when(few, F.col("low")).otherwise(F.col("p")[0]).alias("low"), F.when(few, F.col("high")).otherwise(F.col("p")[1]).alias("high"))
    inside = known.join(F.broadcast(near)).agg(  # one row
        F.max("n").alias("n"), F.count(F.when(F.col("error") < F.col("low"), 1)).alias("below"),
        F.array_sort(F.collect_list(F.when(F.col("error").between(F.col("low"), F.col("high")), F.col("error")))).alias("x"),
    )
    place = (F.col("n") - 1) * F.lit(quantile) - F.col("below")
    value = lambda i: F.try_element_at("x", (i + 1).cast("int"))
    low, high = value(F.floor(place)), value(F.ceil(place))
    return inside.select((low + (high - low) * (place - F.floor(place))).alias("threshold"), F.coalesce("n", F.lit(0)).alias("n"))


def quantile_threshold(scores: DataFrame, quantile: float = QUANTILE, by: Sequence[str] = ()) -> DataFrame:
    """The exact, interpolated quantile of errors: of each group, whose errors are in one task, or of all."""
    if not by:
        return pooled_quantile(scores, quantile)
    return scores.groupBy(*by).agg(F.percentile("error", F.lit(quantile)).alias("threshold"), F.count("*").alias("n"))


def healthy_threshold(scores: DataFrame, quantile: float = QUANTILE, gap: int = 0, per_resource: bool = True) -> DataFrame:
    """One row: the quantile of the earlier half, its false-positive rate on the later half, and both sizes."""
    split = time_split(scores, gap, per_resource)
    fit = pooled_quantile(split.where(F.col("part") == "fit"), quantile).withColumnRenamed("n", "n_fit")
    later = split.where(F.col("part") == "eval").select("error").join(F.broadcast(fit))
    rate = later.agg(F.avg((F.col("error") > F.col("threshold")).cast("int")).alias("fpr"), F.count("*").alias("n_eval"))
    return fit.join(F.broadcast(rate))


@dataclass(frozen=True)
class Policy:
    """A threshold policy as data: one fallback and, for some resources, their own."""

    fallback: float
    source: str
    own: DataFrame | None = None  # resource_id, threshold

    def thresholds(self, spark: SparkSession) -> DataFrame:
        return self.own if self.own is not None else small_table(spark, [], "resource_id string, threshold double")


def checked_margin(margin: float) -> float:
    if not 0 < margin < float("inf"):
        raise ValueError("a margin is finite and above 0")
    return margin


def global_override(threshold: float) -> Policy:
    return Policy(threshold, "override")


def reference_quantile(reference: DataFrame, quantile: float = QUANTILE) -> Policy:
    return Policy(_value(pooled_quantile(reference, quantile)), "reference_quantile")


def healthy_split_quantile(scores: DataFrame, quantile: float = QUANTILE, gap: int = 0, per_resource: bool = True) -> Policy:
    return Policy(_value(healthy_threshold(scores, quantile, gap, per_resource).select("threshold")), "healthy_split")


def per_resource_margin(calibration: DataFrame, fallback: float, quantile: float = QUANTILE, margin: float = 1.5, eligible: DataFrame | None = None) -> Policy:
    """margin x own quantile for eligible resources with LEAST_WINDOWS windows and a quantile above 0."""
    own = quantile_threshold(calibration, quantile, ["resource_id"]).where((F.col("n") >= LEAST_WINDOWS) & (F.col("threshold") > 0))
    if eligible is not None:
        own = own.join(eligible.where("eligible").select("resource_id"), "resource_id", "left_semi")
    return Policy(fallback, "global", own.select("resource_id", (F.col("threshold") * checked_margin(margin)).alias("threshold")))


def serving_block(spark: SparkSession, block: dict) -> Policy:
    """A baked block: threshold, and optionally thresholds of resources' own, times `margin` if the block has one."""
    own = [(r, float(q) * checked_margin(block.get("margin", 1.0))) for r, q in (block.get("per_resource") or {}).items()]
    return Policy(block["threshold"], "global", small_table(spark, own, "resource_id string, threshold double"))


def _value(one: DataFrame) -> float:
    value = one.first()[0]
    if value is None:
        raise ValueError("no windows to calibrate on")
    return float(value)


def with_threshold(scores: DataFrame, policy: Policy) -> DataFrame:
    """scores with threshold and source: a resource's own, else the fallback. Thresholds have a row a resource, so Spark broadcasts them while they are small."""
    own = policy.thresholds(scores.sparkSession).select("resource_id", F.col("threshold").alias("_own"))
    joined = scores.join(own, "resource_id", "left")
    return joined.withColumns({"threshold": F.coalesce("_own", F.lit(policy.fallback)), "source": F.when(F.col("_own").isNotNull(), "per_resource").otherwise(policy.source)}).drop("_own")


def eligibility(scores: DataFrame, metrics: DataFrame, features: Sequence[str], quantile: float = QUANTILE, least: int = LEAST_WINDOWS) -> DataFrame:
    """Per resource all reasons against a threshold of its own: features that others have and it lacks, too few windows, a quantile of 0 or less."""
    named = metrics.where(F.col("metric_name").isin(*features) & F.col("value").isNotNull())
    have = named.groupBy("resource_id").agg(F.collect_set("metric_name").alias("have"))
    everything = F.broadcast(named.agg(F.collect_set("metric_name").alias("everything")))  # one row, as wide as the profile
    per = quantile_threshold(scores, quantile, ["resource_id"]).join(have, "resource_id", "left").join(everything)
    lacking = F.array_sort(F.array_except("everything", F.coalesce("have", F.array().cast("array<string>"))))
    # fixed values: the reason codes
    reasons = F.array_compact(F.array(
        F.when(F.size(lacking) > 0, F.concat(F.lit("divergent-coverage:"), F.array_join(lacking, ","))),
        F.when(F.col("n") < least, F.concat(F.lit("insufficient-windows:"), F.col("n").cast("string"), F.lit(f"<{least}"))),
        F.when(F.col("threshold") <= 0, F.concat(F.lit("non-positive-quantile:"), F.col("threshold").cast("string"))),
    ))
    return per.select("resource_id", "n", F.col("threshold").alias("quantile"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def latest_scores(scores: DataFrame, policy: Policy) -> DataFrame:
    """Per resource its last window against its threshold: ratio, is_anomaly, severity."""
    last = F.row_number().over(Window.partitionBy("resource_id").orderBy(F.desc("end_time"), F.desc("window_id")))
    latest = with_threshold(scores.withColumn("_rank", last).where("_rank = 1").drop("_rank"), policy)
    ratio = share(F.col("error"), F.col("threshold"))
    return latest.withColumns({"ratio": ratio, "is_anomaly": ratio > 1, "severity": severity_of_ratio(ratio)})


def effective_step(scores: DataFrame, by: Sequence[str] = ("resource_id",)) -> DataFrame:
    """The median spacing of window ends, 0 for a single window."""
    gap = seconds_between(F.col("end_time"), F.lag("end_time").over(Window.partitionBy(*by).orderBy("end_time", "window_id")))
    return scores.withColumn("_gap", gap).groupBy(*by).agg(F.coalesce(F.percentile("_gap", F.lit(0.5)), F.lit(0.0)).alias("step"))
