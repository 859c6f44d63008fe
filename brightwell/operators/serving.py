"""What a service answers, as functions: lookups, request series, batch scores of all resources."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.functions import last_or_padded, severity_of_ratio
from brightwell.operators import features, scoring
from brightwell.operators.quality import resolve_resource


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


def lookup(metrics: DataFrame, wanted: str) -> str:
    """The one resource that a text means; NotFound, or Ambiguous with up to 20 candidates."""
    hits = [r["resource_id"] for r in resolve_resource(metrics, wanted).orderBy("resource_id").limit(21).collect()]
    if not hits:
        raise NotFound(wanted)
    if len(hits) > 1:
        raise Ambiguous(", ".join(hits[:20]))
    return hits[0]


def recent_rows(metrics: DataFrame, size: int) -> DataFrame:
    """Rows of the last `size` distinct times of each resource."""
    rank = F.dense_rank().over(Window.partitionBy("resource_id").orderBy(F.desc("timestamp")))
    return metrics.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def score_latest(metrics: DataFrame, names: Sequence[str], params: DataFrame, policy: scoring.Policy, size: int = 30, scorer: scoring.Scorer = scoring.score_window_mean) -> DataFrame:
    """Every resource's last window at once, with ratio, severity and the share of numerical features it has; resources with fewer than `size` times, or no feature, have no row."""
    recent = recent_rows(metrics.where(F.col("metric_name").isin(*names) & F.col("value").isNotNull()), size)
    have = recent.groupBy("resource_id").agg((F.countDistinct("metric_name") / len(names)).alias("coverage"))
    wide = features.pivot_wide(recent, names)
    rows = features.filled_windows(wide, names, size)
    scores = scorer(features.apply_zscore(rows, params, list(names)), list(names))
    return scoring.latest_scores(scores, policy).join(have, "resource_id")


def split_series(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per resource and kind, a map of metric to its values in order of time. profiles: feature, kind."""
    of = metrics.where(F.col("value").isNotNull()).join(profiles.select(F.col("feature").alias("metric_name"), "kind"), "metric_name")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "value"))), lambda s: s["value"])
    series = of.groupBy("resource_id", "kind", "metric_name").agg(ordered.alias("values"))
    return series.groupBy("resource_id", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "values")))).alias("series"))


def fit_length(series: DataFrame, size: int, column: str = "values") -> DataFrame:
    return series.withColumn(column, last_or_padded(F.col(column), size))


def _filled(values: Column) -> Column:
    """Missing values of a series as the last before, else the first after, else 0."""
    first = F.coalesce(F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(1)), F.lit(0.0))
    begin = F.struct(F.array().cast("array<double>").alias("out"), first.alias("last"))

    def step(a: Column, v: Column) -> Column:
        x = F.coalesce(F.nanvl(v, F.lit(None).cast("double")), a["last"])
        return F.struct(F.concat(a["out"], F.array(x)).alias("out"), x.alias("last"))

    return F.aggregate(values, begin, step, lambda a: a["out"])


def request_windows(requests: DataFrame, numerical: Mapping[str, tuple[float, float]], categorical: Mapping[str, tuple[float, float]], size: int = 30) -> DataFrame:
    """Request series as one window each, aligned to a model's features by name.

    requests: request_id, numerical and categorical maps of name to values, the last `size` of which count; shorter ones get zeros in front. numerical: mean and deviation of each feature; categorical: least and largest value. A feature that a request lacks is 0, the mean; missing_numerical and missing_categorical name such features. Unknown names are ignored."""
    none = F.array_repeat(F.lit(0.0), size)
    series, lacking = [], {"numerical": [], "categorical": []}
    for kind, known in (("numerical", numerical), ("categorical", categorical)):
        for name, (a, b) in known.items():
            scaled = partial(lambda v, m, s: (v - m) / s, m=a, s=b or 1.0) if kind == "numerical" else partial(lambda v, lo, hi: F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)), lo=a, hi=b)
            given = F.try_element_at(kind, F.lit(name))
            lacks = F.coalesce(F.size(given), F.lit(0)) <= 0
            if kind == "numerical":
                ready = F.transform(last_or_padded(_filled(given), size), lambda v: scaled(v))  # noqa: B023
            elif b > a:
                ready = F.transform(last_or_padded(_zeroed(given), size), lambda v: scaled(v))  # noqa: B023
            else:
                ready = F.array_repeat(F.lit(1.0 if b > 0 else 0.0), size)
            series.append(F.when(lacks, none).otherwise(ready))
            lacking[kind].append(F.when(lacks, F.lit(name)))
    steps = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.array(*(F.element_at(s, i) for s in series)))
    named = lambda kind: F.array_compact(F.array(*lacking[kind])) if lacking[kind] else F.array().cast("array<string>")
    return requests.select(
        F.col("request_id").alias("resource_id"), F.lit(0).cast("long").alias("window_id"), F.lit(None).cast("timestamp").alias("end_time"), steps.alias("x"),
        named("numerical").alias("missing_numerical"), named("categorical").alias("missing_categorical"),
    )


def _zeroed(values: Column) -> Column:
    return F.transform(values, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def predict(requests: DataFrame, numerical: Mapping[str, tuple[float, float]], categorical: Mapping[str, tuple[float, float]], load: Callable, size: int = 30, threshold: float | None = None) -> DataFrame:
    """Per request its cluster, what to do about it, how sure, the reconstruction error, how many features it had, and with a threshold the ratio to it, whether it is an anomaly, and how severe."""
    from brightwell.operators import clustering, neural

    windows = request_windows(requests, numerical, categorical, size)
    scored = neural.score_arrays(windows, len(numerical), load).drop("window_id", "end_time")
    share_of = lambda kind, n: (1 - F.size(f"missing_{kind}") / n if n else F.lit(1.0)).alias(f"{kind}_coverage")
    had = windows.select("resource_id", "missing_numerical", "missing_categorical", share_of("numerical", len(numerical)), share_of("categorical", len(categorical)))
    out = clustering.describe_clusters(scored.join(had, "resource_id")).withColumnRenamed("resource_id", "request_id")
    if threshold is None:
        return out
    ratio = F.col("error") / F.lit(float(threshold))
    return out.withColumns({"ratio": ratio, "is_anomaly": ratio > 1, "severity": severity_of_ratio(ratio)})


def health(metrics: DataFrame | None = None, model: object | None = None) -> dict:
    """Whether there is a model, a source that answers, and a baked threshold."""
    try:
        reads = metrics is not None and metrics.limit(1).count() >= 0
    except Exception as e:  # noqa: BLE001  whatever a source raises, it does not answer
        return {"status": "degraded", "model_loaded": model is not None, "source": False, "serving_block": bool(getattr(model, "serving", None)), "reason": type(e).__name__}
    return {"status": "healthy" if model is not None and reads else "degraded", "model_loaded": model is not None, "source": reads, "serving_block": bool(getattr(model, "serving", None)), "reason": None}
