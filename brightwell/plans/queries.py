"""Each operator as a query over the event metrics, beside DuckDB SQL that gives the same rows.

Times leave as epoch seconds, floats rounded, so both engines' rows can be compared by value."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from brightwell import streaming
from brightwell.functions import severity_of_ratio, small_table
from brightwell.operators import cases, clustering, detection, features, forecast, gates, neural, quality, scoring, serving
from brightwell.plans import incident, suite
from brightwell.sources import Profile, canonical, event_metrics, hourly_metrics, in_range, lookback, profiles_frame, unpivot_payload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.unix_seconds(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


NUMERICAL, CATEGORICAL = ("click", "view", "purchase"), ("signup", "error")
PROFILES = [Profile("full", NUMERICAL, CATEGORICAL), Profile("partial", ("click", "latency")), Profile("absent", ("cpu", "memory"))]
SIZE, STEP, QUANTILE = 12, 5, 0.9
M = "m AS (SELECT CAST(user_id AS VARCHAR) AS resource_id, event_type AS metric_name, ts AS timestamp, value, event_id AS ordinal, props FROM events)"
H = "h AS (SELECT CAST(user_id % 10 AS VARCHAR) AS resource_id, event_type AS metric_name, date_trunc('hour', ts) AS timestamp, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2, 3)"
WIDE = H + ", wide AS (SELECT resource_id, timestamp, " + ", ".join(f"max(CASE WHEN metric_name = '{f}' THEN value END) AS {f}" for f in NUMERICAL + CATEGORICAL) + " FROM h WHERE value IS NOT NULL GROUP BY 1, 2)"


def _windows(step: int) -> str:
    fill = ", ".join(f"coalesce(last_value({f} IGNORE NULLS) OVER back, first_value({f} IGNORE NULLS) OVER ahead, 0) AS {f}" for f in NUMERICAL + CATEGORICAL)
    return f"""{WIDE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY resource_id) AS n FROM wide),
  spread AS (SELECT *, unnest(generate_series(greatest(0, (rn - {SIZE} + {step} - 1) // {step}), least(rn - 1, n - {SIZE}) // {step})) AS window_id FROM ranked WHERE n >= {SIZE}),
  raw AS (SELECT *, rn - window_id * {step} - 1 AS pos FROM spread WHERE window_id * {step} <= n - {SIZE} AND window_id * {step} < rn AND rn <= window_id * {step} + {SIZE}),
  filled AS (SELECT resource_id, window_id, pos, timestamp, {fill} FROM raw
    WINDOW back AS (PARTITION BY resource_id, window_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           ahead AS (PARTITION BY resource_id, window_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  params AS (SELECT {', '.join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in NUMERICAL)} FROM filled)"""


W5 = _windows(STEP)
SCORES = _windows(1) + f", scores AS (SELECT resource_id, window_id, max(timestamp) AS end_time, ({' + '.join(f'var_pop(({f} - m_{f}) / s_{f})' for f in NUMERICAL)}) / 3 AS error FROM filled, params GROUP BY 1, 2)"
FLAGGED = SCORES + f""", thr AS (SELECT quantile_cont(error, {QUANTILE}) AS threshold FROM scores),
  flagged AS (SELECT scores.*, threshold, error > threshold AS flag FROM scores, thr)"""
RUNS = """SELECT {by}, min(end_time) AS run_start, max(end_time) AS run_end, count(*) AS length FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY end_time, window_id) - row_number() OVER (PARTITION BY {by}, flag ORDER BY end_time, window_id) AS island FROM {of}) WHERE flag GROUP BY {by}, island"""
INCIDENTS = [("a", "1", "2024-01-10 00:00:00", "2024-01-11 12:00:00"), ("b", "2", "2024-01-15 06:00:00", "2024-01-16 06:00:00"), ("c", "7", "2024-01-20 00:00:00", "2024-01-22 00:00:00")]
I_SQL = "incidents AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}', TIMESTAMP '{a}', TIMESTAMP '{e}')" for c, r, a, e in INCIDENTS) + ') v(case_id, resource_id, anchor, "end"))'
LONGEST_LEAD = 12 * 3600  # the longest lead looked for, as the stand-in grid is hourly


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pivot_wide(hourly_metrics(spark, sf_dir), NUMERICAL + CATEGORICAL)


def _filled(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    return features.filled_windows(_wide(spark, sf_dir), NUMERICAL + CATEGORICAL, SIZE, step)


def _normalised(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    filled = _filled(spark, sf_dir, step)
    return features.apply_zscore(filled, features.fit_zscore(filled, NUMERICAL), NUMERICAL)


_made: dict[tuple[str, str], DataFrame] = {}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table of a capture, made once in a session and read by all that needs scores; on disk, as rows are few beside the windows they sum up."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        _made[key] = scoring.score_window_mean(_normalised(spark, sf_dir, 1), NUMERICAL).persist(StorageLevel.DISK_ONLY)
    return _made[key]


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    at = scoring.pooled_quantile(scores, QUANTILE).select("threshold")
    return detection.flag(scores.join(F.broadcast(at)))  # one row


def _incidents(spark: SparkSession) -> DataFrame:
    rows = small_table(spark, INCIDENTS, "case_id string, resource_id string, anchor string, end string")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("anchor", "end")})


# -- what a table holds ------------------------------------------------------------------------


@query(f"WITH {M} SELECT count(*) AS rows, count(DISTINCT resource_id) AS resources, count(DISTINCT metric_name) AS metrics, CAST(floor(epoch(min(timestamp))) AS BIGINT) AS first_time, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS last_time FROM m")
def metrics_summary(spark, sf_dir):
    return rounded(quality.summary(event_metrics(spark, sf_dir)))


@query(f"WITH {M} SELECT DISTINCT resource_id FROM m ORDER BY 1")
def distinct_resources(spark, sf_dir):
    return event_metrics(spark, sf_dir).select("resource_id").distinct().orderBy("resource_id")


@query(f"WITH {M} SELECT DISTINCT metric_name FROM m ORDER BY 1")
def distinct_metric_names(spark, sf_dir):
    return event_metrics(spark, sf_dir).select("metric_name").distinct().orderBy("metric_name")


@query(f"WITH {M} SELECT resource_id, metric_name, epoch_us(timestamp) AS at, value FROM m WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15' AND metric_name IN ('click', 'view')")
def range_profile_scan(spark, sf_dir):
    utc = timezone.utc
    kept = in_range(event_metrics(spark, sf_dir), datetime(2024, 1, 8, tzinfo=utc), datetime(2024, 1, 15, tzinfo=utc), ["click", "view"])
    return kept.select("resource_id", "metric_name", F.unix_micros("timestamp").alias("at"), "value")


@query("SELECT CAST(user_id AS VARCHAR) AS resource_id, coalesce(json_extract_string(props, '$.host_name'), 'h' || CAST(user_id % 7 AS VARCHAR)) AS host_name, event_type AS metric_name, epoch_us(ts) AS at, CAST(value AS DOUBLE) AS value FROM events")
def canonicalize_json_attrs(spark, sf_dir):
    raw = event_metrics(spark, sf_dir).select(
        F.col("resource_id").alias("resource_hash"), F.concat(F.lit("h"), (F.col("resource_id").cast("long") % 7).cast("string")).alias("host_name"), "metric_name",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("value").cast("string").alias("value_double"), "attributes",
    )
    return canonical(raw).select("resource_id", "host_name", "metric_name", F.unix_micros("timestamp").alias("at"), "value")


P_SQL = "p AS (SELECT * FROM (VALUES ('full', 'click', 'numerical', 0), ('full', 'view', 'numerical', 1), ('full', 'purchase', 'numerical', 2), ('full', 'signup', 'categorical', 3), ('full', 'error', 'categorical', 4), ('partial', 'click', 'numerical', 0), ('partial', 'latency', 'numerical', 1), ('absent', 'cpu', 'numerical', 0), ('absent', 'memory', 'numerical', 1)) v(profile, feature, kind, ordinal))"


@query(f"""WITH {M}, {P_SQL}, all_p AS (SELECT profile, feature FROM p UNION ALL SELECT 'empty', NULL), d AS (SELECT DISTINCT metric_name FROM m)
SELECT profile, count(feature) AS total, count(metric_name) AS available, coalesce(string_agg(CASE WHEN metric_name IS NULL THEN feature END, ',' ORDER BY feature), '') AS missing,
  coalesce(100.0 * count(metric_name) / nullif(count(feature), 0), 100) AS coverage FROM all_p LEFT JOIN d ON feature = metric_name GROUP BY profile""")
def profile_coverage(spark, sf_dir):
    profiles = profiles_frame(spark, PROFILES).select("profile", "feature").unionAll(spark.sql("SELECT 'empty', CAST(NULL AS STRING)"))
    covered = quality.coverage_gate(quality.coverage(profiles, event_metrics(spark, sf_dir)))
    return covered.select("profile", "total", "available", F.array_join("missing_features", ",").alias("missing"), "coverage")


@query(f"WITH {M}, {P_SQL} SELECT profile, feature, kind, ordinal FROM p WHERE feature NOT IN (SELECT metric_name FROM m)")
def missing_features(spark, sf_dir):
    return quality.missing_features(profiles_frame(spark, PROFILES), event_metrics(spark, sf_dir))


Q_SQL = f"""{M}, ref AS (SELECT max(timestamp) AS ref_at FROM m), g AS (SELECT resource_id, metric_name, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY resource_id, metric_name ORDER BY timestamp))) / 1e6 AS gap FROM m WHERE timestamp IS NOT NULL),
  s AS (SELECT resource_id, metric_name, count(*) AS points, min(timestamp) AS t0, max(timestamp) AS t1, quantile_cont(gap, 0.5) FILTER (gap > 0) AS interval_, max(gap) FILTER (gap > 0) AS longest FROM g GROUP BY 1, 2),
  q AS (SELECT resource_id, metric_name, points, interval_, longest, CASE WHEN interval_ IS NOT NULL THEN least(1.0, points / (floor((epoch_us(t1) - epoch_us(t0)) / 1e6 / interval_) + 1)) END AS density,
    (epoch_us(ref_at) - epoch_us(t1)) / 1e6 / interval_ AS behind, CASE WHEN interval_ IS NOT NULL THEN (epoch_us(ref_at) - epoch_us(t1)) / 1e6 / interval_ <= 4 END AS is_live FROM s, ref)"""


@query(f"WITH {Q_SQL} SELECT resource_id, metric_name, points, round(interval_, 2) AS interval, round(longest, 2) AS longest_gap, round(density, 6) AS density, round(behind, 4) AS behind, is_live FROM q")
def series_quality(spark, sf_dir):
    s = quality.series_quality(event_metrics(spark, sf_dir))
    return s.select("resource_id", "metric_name", "points", F.round("interval", 2).alias("interval"), F.round("longest_gap", 2).alias("longest_gap"), F.round("density", 6).alias("density"), F.round("behind", 4).alias("behind"), "is_live")


@query(f"WITH {Q_SQL} SELECT count(*) AS series, count(interval_) AS analyzed, round(coalesce(100 * avg(CAST(is_live AS INT)), 0), 6) AS freshness_score, round(coalesce(100 * avg(density), 0), 6) AS gap_score FROM q")
def quality_rollup(spark, sf_dir):
    return rounded(quality.quality_gate(quality.quality_rollup(quality.series_quality(event_metrics(spark, sf_dir)))).select("series", "analyzed", "freshness_score", "gap_score"))


@query(f"WITH {Q_SQL} SELECT resource_id, metric_name, round(behind, 4) AS behind FROM q WHERE NOT is_live ORDER BY q.behind DESC, resource_id, metric_name LIMIT 20")
def stale_top_n(spark, sf_dir):
    return quality.stalest(quality.series_quality(event_metrics(spark, sf_dir))).select("resource_id", "metric_name", F.round("behind", 4).alias("behind"))


@query(f"WITH {Q_SQL} SELECT resource_id, metric_name, round(density, 6) AS density FROM q WHERE density < 1 ORDER BY q.density, resource_id, metric_name LIMIT 20")
def gappy_top_n(spark, sf_dir):
    return quality.gappiest(quality.series_quality(event_metrics(spark, sf_dir))).select("resource_id", "metric_name", F.round("density", 6).alias("density"))


@query("""WITH m AS (SELECT user_id % 8 AS r, event_type, ts, arg_min(CASE WHEN event_type = 'click' THEN event_id ELSE value END, event_id) AS v FROM events GROUP BY 1, 2, 3),
s AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type, r ORDER BY ts) AS d FROM m WHERE v IS NOT NULL),
k AS (SELECT event_type, r, count(*) AS n, avg(CAST(d >= 0 AS INT)) AS kept, avg(CAST(d > 0 AS INT)) AS rose FROM s GROUP BY 1, 2 HAVING count(*) > 50)
SELECT event_type AS metric_name, count(*) AS judged, CAST(sum(CAST(kept >= 0.99 AND rose >= 0.05 AS INT)) AS BIGINT) AS hits, 2 * sum(CAST(kept >= 0.99 AND rose >= 0.05 AS INT)) >= count(*) AS is_counter FROM k GROUP BY 1""")
def counter_shape(spark, sf_dir):
    m = event_metrics(spark, sf_dir).withColumns({"resource_id": F.col("resource_id").cast("long") % 8, "datasource_instance": F.lit(None).cast("string"), "value": F.when(F.col("metric_name") == "click", F.col("ordinal").cast("double")).otherwise(F.col("value"))})
    return quality.counter_shape(m)


@query("""WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS resource_id, 'host-' || CAST(user_id % 5 AS VARCHAR) AS host_name FROM events),
t AS (SELECT resource_id, CASE WHEN resource_id = 'host-3' THEN 0 WHEN host_name = 'host-3' THEN 1 WHEN contains(resource_id, 'host-3') OR contains(host_name, 'host-3') THEN 2 END AS tier FROM d)
SELECT tier, resource_id, count(*) OVER () > 1 AS ambiguous FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def resource_resolution(spark, sf_dir):
    m = event_metrics(spark, sf_dir).withColumn("host_name", F.concat(F.lit("host-"), (F.col("resource_id").cast("long") % 5).cast("string")))
    return quality.resolve_resource(m, "HOST-3")


@query("""SELECT event_type AS metric_name, count(DISTINCT v) AS levels, CASE WHEN bool_and(v IN (0, 1)) OR (bool_and(v = floor(v)) AND count(DISTINCT v) <= 10) THEN 'categorical' ELSE 'numerical' END AS kind
FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN CAST(event_id % 2 AS DOUBLE) WHEN event_type = 'signup' THEN CAST(event_id % 7 AS DOUBLE) ELSE value END AS v FROM events) GROUP BY 1""")
def metric_type_classification(spark, sf_dir):
    n = F.col("ordinal")
    m = event_metrics(spark, sf_dir).withColumn("value", F.when(F.col("metric_name") == "error", (n % 2).cast("double")).when(F.col("metric_name") == "signup", (n % 7).cast("double")).otherwise(F.col("value")))
    return quality.discover_features(m).select("metric_name", "levels", "kind")


# -- wide rows and windows ---------------------------------------------------------------------


@query(f"WITH {WIDE} SELECT resource_id, CAST(epoch(timestamp) AS BIGINT) AS timestamp, {', '.join(f'round({f}, 6) AS {f}' for f in NUMERICAL + CATEGORICAL)} FROM wide")
def pivot_wide(spark, sf_dir):
    return rounded(_wide(spark, sf_dir))


@query(f"WITH {W5} SELECT resource_id, window_id, count(*) AS steps, CAST(epoch(max(timestamp)) AS BIGINT) AS end_time, count(click) AS clicks FROM raw GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    rows = features.window_rows(_wide(spark, sf_dir), SIZE, STEP)
    return rounded(rows.groupBy("resource_id", F.col("window_id").cast("long").alias("window_id")).agg(F.count("*").alias("steps"), F.max("timestamp").alias("end_time"), F.count("click").alias("clicks")))


@query(f"WITH {W5} SELECT resource_id, window_id, pos, {', '.join(f'round({f}, 6) AS {f}' for f in NUMERICAL + CATEGORICAL)} FROM filled")
def window_fill(spark, sf_dir):
    return rounded(_filled(spark, sf_dir).select("resource_id", F.col("window_id").cast("long").alias("window_id"), F.col("pos").cast("long").alias("pos"), *NUMERICAL, *CATEGORICAL))


@query(f"WITH {W5} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std FROM params" for f in NUMERICAL))
def zscore_params(spark, sf_dir):
    return rounded(features.fit_zscore(_filled(spark, sf_dir), NUMERICAL))


@query(f"WITH {W5} SELECT resource_id, window_id, pos, {', '.join(f'round(({f} - m_{f}) / s_{f}, 6) AS {f}' for f in NUMERICAL)} FROM filled, params")
def zscore_apply(spark, sf_dir):
    return rounded(_normalised(spark, sf_dir).select("resource_id", F.col("window_id").cast("long").alias("window_id"), F.col("pos").cast("long").alias("pos"), *NUMERICAL))


@query(f"WITH {W5}, b AS (SELECT min(signup) AS l1, max(signup) AS h1, min(error) AS l2, max(error) AS h2 FROM filled) SELECT resource_id, window_id, pos, round((signup - l1) / (h1 - l1), 6) AS signup, round((error - l2) / (h2 - l2), 6) AS error FROM filled, b")
def minmax_encode(spark, sf_dir):
    filled = _filled(spark, sf_dir)
    return rounded(features.apply_minmax(filled, features.fit_minmax(filled, CATEGORICAL), CATEGORICAL).select("resource_id", F.col("window_id").cast("long").alias("window_id"), F.col("pos").cast("long").alias("pos"), *CATEGORICAL))


# -- scores and thresholds ---------------------------------------------------------------------


def _keyed(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("window_id", F.col("window_id").cast("long")))


@query(f"WITH {SCORES} SELECT resource_id, window_id, CAST(epoch(end_time) AS BIGINT) AS end_time, round(error, 6) AS error FROM scores")
def window_scores(spark, sf_dir):
    return _keyed(_scores(spark, sf_dir))


@query(f"WITH {_windows(1)} SELECT resource_id, window_id, CAST(epoch(max(timestamp)) AS BIGINT) AS end_time, round(({' + '.join(f'avg((({f} - m_{f}) / s_{f}) * (({f} - m_{f}) / s_{f}))' for f in NUMERICAL)}) / 3, 6) AS error FROM filled, params GROUP BY 1, 2")
def training_mean_scores(spark, sf_dir):
    return _keyed(scoring.score_training_mean(_normalised(spark, sf_dir, 1), NUMERICAL))


SPLIT = f"{SCORES}, ord AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY end_time, window_id) AS rn, count(*) OVER (PARTITION BY resource_id) AS cnt FROM scores), split AS (SELECT *, CASE WHEN cnt < 2 OR rn <= cnt // 2 THEN 'fit' WHEN rn > cnt // 2 + 12 THEN 'eval' END AS part FROM ord)"


@query(f"WITH {SPLIT} SELECT resource_id, coalesce(part, 'gap') AS part, count(*) AS n, CAST(min(epoch(end_time)) AS BIGINT) AS first_end FROM split GROUP BY 1, 2")
def per_resource_time_split(spark, sf_dir):
    split = scoring.time_split(_scores(spark, sf_dir), scoring.gap_windows(SIZE, 1))
    return rounded(split.groupBy("resource_id", F.coalesce("part", F.lit("gap")).alias("part")).agg(F.count("*").alias("n"), F.min("end_time").alias("first_end")))


@query(f"WITH {SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY end_time, resource_id, window_id) AS rn, count(*) OVER () AS n FROM scores) SELECT count(*) FILTER (rn <= n // 2) AS fit, count(*) FILTER (rn > n // 2 + 12) AS later FROM o")
def pooled_time_split(spark, sf_dir):
    split = scoring.time_split(_scores(spark, sf_dir), 12, per_resource=False)
    return split.agg(F.count(F.when(F.col("part") == "fit", 1)).alias("fit"), F.count(F.when(F.col("part") == "eval", 1)).alias("later"))


HEALTHY = f"{SPLIT}, t AS (SELECT quantile_cont(error, {QUANTILE}) AS threshold, count(*) AS n_fit FROM split WHERE part = 'fit')"


@query(f"WITH {HEALTHY} SELECT round(threshold, 6) AS threshold, n_fit FROM t")
def healthy_threshold(spark, sf_dir):
    return rounded(scoring.healthy_threshold(_scores(spark, sf_dir), QUANTILE, 12).select("threshold", "n_fit"))


@query(f"WITH {HEALTHY} SELECT round(avg(CAST(error > threshold AS INT)), 6) AS fpr, count(*) AS n_eval FROM split, t WHERE part = 'eval'")
def healthy_fpr(spark, sf_dir):
    return rounded(scoring.healthy_threshold(_scores(spark, sf_dir), QUANTILE, 12).select("fpr", "n_eval"))


@query(f"WITH {SCORES} SELECT round(quantile_cont(error, 0.99), 6) AS threshold, count(*) AS n FROM scores WHERE resource_id IN ('0', '4', '5')")
def reference_quantile(spark, sf_dir):
    return rounded(scoring.quantile_threshold(_scores(spark, sf_dir).where(F.col("resource_id").isin("0", "4", "5"))))


@query(f"WITH {SCORES} SELECT resource_id, round(1.5 * quantile_cont(error, 0.99), 6) AS threshold FROM scores GROUP BY 1 HAVING count(*) >= 50 AND quantile_cont(error, 0.99) > 0")
def per_resource_margin_thresholds(spark, sf_dir):
    return rounded(scoring.per_resource_margin(_scores(spark, sf_dir), fallback=1.0).own)


@query(f"""WITH {SCORES}, hv AS (SELECT DISTINCT resource_id, metric_name FROM h WHERE value IS NOT NULL AND NOT (resource_id = '4' AND metric_name = 'click')), u AS (SELECT DISTINCT metric_name FROM hv WHERE metric_name IN ('click', 'view', 'purchase')),
k AS (SELECT resource_id, count(*) AS n, quantile_cont(error, 0.99) AS q FROM scores GROUP BY 1),
l AS (SELECT k.resource_id, string_agg(u.metric_name, ',' ORDER BY u.metric_name) AS lacking FROM k CROSS JOIN u LEFT JOIN hv ON hv.resource_id = k.resource_id AND hv.metric_name = u.metric_name WHERE hv.metric_name IS NULL GROUP BY 1)
SELECT k.resource_id, n, concat_ws('|', 'divergent-coverage:' || lacking, CASE WHEN n < 200 THEN 'insufficient-windows:' || CAST(n AS VARCHAR) || '<200' END, CASE WHEN q <= 0 THEN 'non-positive-quantile:' || CAST(q AS VARCHAR) END) AS reasons FROM k LEFT JOIN l USING (resource_id)""")
def eligibility_gates(spark, sf_dir):
    metrics = hourly_metrics(spark, sf_dir).where(~((F.col("resource_id") == "4") & (F.col("metric_name") == "click")))
    return scoring.eligibility(_scores(spark, sf_dir), metrics, NUMERICAL, least=200).select("resource_id", "n", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {SCORES} SELECT resource_id, window_id, CASE resource_id WHEN '1' THEN 0.5 WHEN '2' THEN 0.7 ELSE 1.1 END AS threshold, CASE WHEN resource_id IN ('1', '2') THEN 'per_resource' ELSE 'global' END AS source FROM scores")
def threshold_fallback_join(spark, sf_dir):
    policy = scoring.serving_block(spark, {"threshold": 1.1, "margin": 1.0, "per_resource": {"1": 0.5, "2": 0.7}})
    return _keyed(scoring.with_threshold(_scores(spark, sf_dir), policy).select("resource_id", "window_id", "threshold", "source"))


@query(f"""WITH {SCORES}, x AS (SELECT *, CAST(ceil(epoch(end_time) / 21600) * 21600 AS BIGINT) AS c, lead(epoch(end_time)) OVER (PARTITION BY resource_id ORDER BY end_time, window_id) AS nx, (SELECT floor(max(epoch(end_time)) / 21600) * 21600 FROM scores) AS lt FROM scores)
SELECT resource_id, window_id, CAST(epoch(end_time) AS BIGINT) AS end_time FROM x WHERE c <= lt AND (nx IS NULL OR c < nx)""")
def grid_cadence_subsample(spark, sf_dir):
    return _keyed(scoring.on_cadence(_scores(spark, sf_dir), 21600).select("resource_id", "window_id", "end_time"))


@query(f"WITH {SCORES} SELECT resource_id, window_id, round(error, 6) AS error FROM scores WHERE window_id % 10 = 0")
def grid_stride_subsample(spark, sf_dir):
    return _keyed(scoring.on_stride(_scores(spark, sf_dir), 10).select("resource_id", "window_id", "error"))


L_SQL = f"{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY end_time DESC, window_id DESC) AS k FROM scores), l AS (SELECT *, error / CASE resource_id WHEN '1' THEN 0.5 WHEN '2' THEN 0.7 ELSE 1.1 END AS ratio FROM r WHERE k = 1)"


@query(f"WITH {L_SQL} SELECT resource_id, CAST(epoch(end_time) AS BIGINT) AS end_time, round(ratio, 6) AS ratio, ratio > 1 AS is_anomaly, CASE WHEN ratio > 2 THEN 4 WHEN ratio > 1.5 THEN 3 WHEN ratio > 1 THEN 2 ELSE 1 END AS severity FROM l")
def latest_window_score(spark, sf_dir):
    policy = scoring.serving_block(spark, {"threshold": 1.1, "per_resource": {"1": 0.5, "2": 0.7}})
    return rounded(scoring.latest_scores(_scores(spark, sf_dir), policy).select("resource_id", "end_time", "ratio", "is_anomaly", "severity"))


@query(f"WITH {SCORES} SELECT CASE WHEN error / 0.9 > 2 THEN 4 WHEN error / 0.9 > 1.5 THEN 3 WHEN error / 0.9 > 1 THEN 2 ELSE 1 END AS severity, count(*) AS n FROM scores GROUP BY 1")
def severity_bands(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy(severity_of_ratio(F.col("error") / 0.9).alias("severity")).agg(F.count("*").alias("n"))


# -- runs, incidents, alarms -------------------------------------------------------------------


@query(f"WITH {FLAGGED}, runs AS ({RUNS.format(by='resource_id', of='flagged')}) SELECT resource_id, CAST(epoch(run_start) AS BIGINT) AS run_start, CAST(epoch(run_end) AS BIGINT) AS run_end, length FROM runs WHERE length >= 3")
def sustained_runs(spark, sf_dir):
    return rounded(detection.sustained(detection.runs(_flagged(spark, sf_dir)), 3).drop("first_row"))


SCAN = f"""{FLAGGED}, {I_SQL}, scan AS (SELECT f.*, i.case_id, i.anchor FROM flagged f JOIN incidents i ON f.resource_id = i.resource_id AND f.end_time >= i.anchor - INTERVAL 12 HOUR AND f.end_time <= i."end"),
  step AS (SELECT case_id, coalesce(quantile_cont(gap, 0.5), 0) AS step FROM (SELECT case_id, epoch(end_time) - epoch(lag(end_time) OVER (PARTITION BY case_id ORDER BY end_time, window_id)) AS gap FROM scan) GROUP BY 1),
  runs AS (SELECT * FROM ({RUNS.format(by='case_id', of='scan')}) WHERE length >= 3),
  j AS (SELECT i.case_id, i.anchor, step, run_start, run_end FROM incidents i LEFT JOIN step USING (case_id) LEFT JOIN runs USING (case_id))"""


def _detect_sql(at: str) -> str:
    return f"""WITH {SCAN}, d AS (SELECT case_id, anchor, {at} AS t, coalesce(bool_or(run_start < anchor AND run_end >= anchor), false) AS bridged, count(CASE WHEN run_start < anchor THEN 1 END) AS runs_before, count(CASE WHEN run_start >= anchor THEN 1 END) AS runs_from FROM j GROUP BY 1, 2)
SELECT case_id, t IS NOT NULL AS detected, CAST(epoch(t) AS DOUBLE) AS detection_time, epoch(anchor) - epoch(t) AS lead_seconds, bridged, runs_before, runs_from FROM d"""


LOOKBACK = "coalesce(min(run_start) FILTER (run_start <= anchor AND epoch(run_end) >= epoch(anchor) - step), min(run_start) FILTER (run_end >= anchor))"


def _detected(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out = detection.detect(_flagged(spark, sf_dir), _incidents(spark), mode, max_lead=LONGEST_LEAD)
    out = out.withColumn("detection_time", F.unix_seconds("detection_time").cast("double"))
    return rounded(out.select("case_id", "detected", "detection_time", "lead_seconds", "bridged", "runs_before", "runs_from"))


@query(_detect_sql(LOOKBACK))
def detection_lookback(spark, sf_dir):
    return _detected(spark, sf_dir, "lookback")


@query(_detect_sql("min(run_start) FILTER (run_start >= anchor)"))
def detection_no_bridging(spark, sf_dir):
    return _detected(spark, sf_dir, "no_bridging")


ON_SQL = "o AS (SELECT case_id, onset, anchor + CASE onset WHEN 'T0' THEN INTERVAL 0 HOUR ELSE INTERVAL 6 HOUR END AS onset_time FROM incidents, (VALUES ('T0'), ('T2')) v(onset))"


def _onsets(spark: SparkSession) -> DataFrame:
    later = F.timestamp_seconds(F.unix_seconds("anchor") + 6 * 3600)
    return _incidents(spark).withColumn("onsets", F.create_map(F.lit("T0"), "anchor", F.lit("T2"), later))


@query(f"WITH {SCAN}, {ON_SQL}, d AS (SELECT case_id, {LOOKBACK} AS t FROM j GROUP BY 1) SELECT o.case_id, onset, epoch(onset_time) - epoch(t) AS lead_seconds FROM o JOIN d USING (case_id)")
def onset_leads(spark, sf_dir):
    found = detection.detect(_flagged(spark, sf_dir), _incidents(spark), max_lead=LONGEST_LEAD)
    return detection.onset_leads(found, _onsets(spark)).select("case_id", "onset", "lead_seconds")


@query(f"WITH {I_SQL}, {ON_SQL} SELECT case_id, onset, CAST(epoch(onset_time) AS BIGINT) AS onset_time FROM o")
def label_explode(spark, sf_dir):
    return rounded(_onsets(spark).select("case_id", F.explode("onsets").alias("onset", "onset_time")))


@query(f"""WITH {SCORES}, {I_SQL}, ins AS (SELECT s.*, case_id, error > 1.0 AS flag FROM scores s JOIN incidents i ON s.resource_id = i.resource_id AND s.end_time BETWEEN i.anchor AND i."end"), runs AS ({RUNS.format(by='case_id', of='ins')}),
k AS (SELECT case_id, count(*) AS n, max(error) AS mx, avg(error) AS mn, count(*) FILTER (flag) AS ov FROM ins GROUP BY 1), rr AS (SELECT case_id, count(*) AS runs FROM runs WHERE length >= 3 GROUP BY 1)
SELECT i.case_id AS slice_id, coalesce(n, 0) AS n, round(mx, 6) AS max_error, round(mn, 6) AS mean_error, coalesce(ov, 0) AS over, round(CAST(ov AS DOUBLE) / n, 6) AS over_share, coalesce(runs, 0) AS runs FROM incidents i LEFT JOIN k USING (case_id) LEFT JOIN rr USING (case_id)""")
def slice_stats(spark, sf_dir):
    slices = _incidents(spark).select(F.col("case_id").alias("slice_id"), "resource_id", F.col("anchor").alias("start"), "end", F.lit(1.0).alias("threshold"))
    return rounded(detection.slice_stats(_scores(spark, sf_dir), slices).select("slice_id", "n", "max_error", "mean_error", "over", "over_share", "runs"))


LEADIN = f"""{FLAGGED}, {I_SQL}, ld AS (SELECT f.*, case_id FROM flagged f JOIN incidents i ON f.resource_id = i.resource_id AND f.end_time >= i.anchor - INTERVAL 1 DAY AND f.end_time < i.anchor), runs AS ({RUNS.format(by='case_id', of='ld')}),
  g AS (SELECT case_id, s AS sustain FROM incidents, (VALUES (3), (1)) v(s)), rates AS (SELECT g.case_id, g.sustain, CAST(coalesce((SELECT sum(length) FROM runs WHERE runs.case_id = g.case_id AND length >= g.sustain), 0) AS BIGINT) AS covered, (SELECT count(*) FROM ld WHERE ld.case_id = g.case_id) AS windows FROM g)"""


@query(f"WITH {LEADIN} SELECT case_id, sustain, covered, windows, round(CAST(covered AS DOUBLE) / nullif(windows, 0), 6) AS fpr FROM rates")
def lead_in_fpr(spark, sf_dir):
    return rounded(detection.lead_in_rates(_flagged(spark, sf_dir), _incidents(spark)).select("case_id", "sustain", "covered", "windows", "fpr"))


@query(f"WITH {LEADIN} SELECT sustain, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(windows) AS BIGINT) AS windows, round(CAST(sum(covered) AS DOUBLE) / nullif(sum(windows), 0), 6) AS fpr FROM rates GROUP BY 1")
def pooled_lead_in_fpr(spark, sf_dir):
    return rounded(detection.pooled_lead_in(detection.lead_in_rates(_flagged(spark, sf_dir), _incidents(spark))))


@query(f"""WITH {FLAGGED}, {I_SQL}, runs AS ({RUNS.format(by='resource_id', of='flagged')}), o AS (SELECT i.*, epoch(least(run_end, i."end")) - epoch(greatest(run_start, anchor)) AS ov, run_end FROM incidents i LEFT JOIN runs ON i.resource_id = runs.resource_id)
SELECT case_id, coalesce(sum(ov) FILTER (ov > 0), 0) AS covered_seconds, round(coalesce(sum(ov) FILTER (ov > 0), 0) / (epoch("end") - epoch(anchor)), 6) AS coverage, epoch("end") - epoch(max(run_end) FILTER (ov > 0)) AS clear_lead_seconds FROM o GROUP BY case_id, anchor, "end" """)
def incident_coverage(spark, sf_dir):
    return rounded(detection.incident_coverage(detection.runs(_flagged(spark, sf_dir)), _incidents(spark)).select("case_id", "covered_seconds", "coverage", "clear_lead_seconds"))


FATIGUE = f"""{FLAGGED}, runs AS ({RUNS.format(by='resource_id', of='flagged')}), st AS (SELECT resource_id, coalesce(quantile_cont(gap, 0.5), 0) AS step FROM (SELECT resource_id, epoch(end_time) - epoch(lag(end_time) OVER (PARTITION BY resource_id ORDER BY end_time, window_id)) AS gap FROM flagged) GROUP BY 1),
  sp AS (SELECT resource_id, epoch(max(end_time)) - epoch(min(end_time)) AS span FROM flagged GROUP BY 1), g AS (SELECT resource_id, span, step, s AS sustain FROM sp JOIN st USING (resource_id), (VALUES (3), (1)) v(s)),
  k AS (SELECT g.resource_id, g.sustain, any_value(span) AS span, count(runs.length) AS runs, coalesce(sum(epoch(run_end) - epoch(run_start)), 0) + count(runs.length) * any_value(step) AS secs FROM g LEFT JOIN runs ON runs.resource_id = g.resource_id AND length >= g.sustain GROUP BY 1, 2),
  fat AS (SELECT *, secs / nullif(span, 0) AS share, runs * 604800 / nullif(span, 0) AS rate FROM k)"""


@query(f"WITH {FATIGUE} SELECT resource_id, sustain, runs, round(secs, 6) AS alarm_seconds, round(share, 6) AS time_in_alarm, round(rate, 6) AS runs_per_week FROM fat")
def alarm_fatigue(spark, sf_dir):
    return rounded(detection.alarm_fatigue(_flagged(spark, sf_dir)).select("resource_id", "sustain", "runs", "alarm_seconds", "time_in_alarm", "runs_per_week"))


@query(f"WITH {FATIGUE} SELECT sustain, count(*) AS resources, round(sum(secs) / nullif(sum(span), 0), 6) AS time_in_alarm, round(sum(coalesce(rate, 0)), 6) AS runs_per_week FROM fat GROUP BY 1")
def fleet_alarm_rollup(spark, sf_dir):
    return rounded(detection.fleet_alarms(detection.alarm_fatigue(_flagged(spark, sf_dir))))


@query(f"""WITH {FLAGGED}, runs AS ({RUNS.format(by='resource_id', of='flagged')}), k AS (SELECT resource_id, count(*) AS w, count(*) FILTER (flag) AS o, min(end_time) AS a, max(end_time) AS b, (SELECT count(*) FROM runs WHERE runs.resource_id = flagged.resource_id AND length >= 3) AS r FROM flagged GROUP BY 1),
u AS (SELECT * FROM k UNION ALL SELECT 'GLOBAL', CAST(sum(w) AS BIGINT), CAST(sum(o) AS BIGINT), min(a), max(b), CAST(sum(r) AS BIGINT) FROM k)
SELECT resource_id, w AS windows, r AS runs, round(CAST(o AS DOUBLE) / w, 6) AS fpr, round(r * 604800 / nullif(epoch(b) - epoch(a), 0), 6) AS runs_per_week FROM u""")
def fleet_report(spark, sf_dir):
    return rounded(detection.fleet_report(_flagged(spark, sf_dir)).select("resource_id", "windows", "runs", "fpr", "runs_per_week"))


@query(f"""WITH {SCORES}, th AS (SELECT resource_id, quantile_cont(error, {QUANTILE}) AS threshold FROM scores GROUP BY 1), sl AS (SELECT resource_id || '/' || kind AS slice_id, resource_id, CASE kind WHEN 'own' THEN threshold ELSE (SELECT threshold FROM th WHERE resource_id = '2') END AS thr FROM th, (VALUES ('own'), ('incident')) v(kind) WHERE resource_id IN ('3', '5')),
ins AS (SELECT s.*, slice_id, error > thr AS flag FROM scores s JOIN sl USING (resource_id) WHERE end_time BETWEEN TIMESTAMP '2024-01-15 06:00:00' AND TIMESTAMP '2024-01-16 06:00:00'), runs AS ({RUNS.format(by='slice_id', of='ins')})
SELECT sl.slice_id, count(ins.window_id) AS n, count(ins.window_id) FILTER (ins.flag) AS over, (SELECT count(*) FROM runs WHERE runs.slice_id = sl.slice_id AND length >= 3) AS runs FROM sl LEFT JOIN ins ON ins.slice_id = sl.slice_id GROUP BY 1""")
def control_slices(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    one = _incidents(spark).where("case_id = 'b'").select("resource_id", F.col("anchor").alias("start"), "end")
    controls = spark.createDataFrame([("3",), ("5",)], "resource_id string")
    return detection.control_slices(scores, controls, one, scoring.quantile_threshold(scores, QUANTILE, ["resource_id"]).drop("n")).select("slice_id", "n", "over", "runs")


@query(f"WITH {M}, {I_SQL} SELECT DISTINCT m.resource_id, CASE WHEN case_id IS NULL THEN 'excluded' ELSE 'incident' END AS role FROM m LEFT JOIN incidents i ON i.resource_id = m.resource_id")
def label_roles(spark, sf_dir):
    labels = _incidents(spark).select("resource_id", F.lit("incident").alias("role"))
    return detection.roles(event_metrics(spark, sf_dir).select("resource_id").distinct(), labels)


# -- drift and forecasts -----------------------------------------------------------------------


@query("""WITH m AS (SELECT event_type AS f, value AS v, ts >= TIMESTAMP '2024-01-15' AS late FROM events), e AS (SELECT f, min(v) - 1e-10 AS lo, max(v) + 1e-10 AS hi, count(*) FILTER (NOT late) AS n0, count(*) FILTER (late) AS n1 FROM m GROUP BY 1),
b AS (SELECT m.f, least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS b, late FROM m JOIN e USING (f)), c AS (SELECT f, b, count(*) FILTER (NOT late) AS c0, count(*) FILTER (late) AS c1 FROM b GROUP BY 1, 2),
d AS (SELECT e.f, coalesce(CAST(c0 AS DOUBLE), 0) / n0 + 1e-10 AS r, coalesce(CAST(c1 AS DOUBLE), 0) / n1 + 1e-10 AS k FROM e CROSS JOIN range(10) g(b) LEFT JOIN c ON c.f = e.f AND c.b = g.b)
SELECT f AS feature, round(sum((k - r) * ln(k / r)), 6) AS psi, sum((k - r) * ln(k / r)) >= 0.2 AS drifted FROM d GROUP BY 1""")
def psi_drift(spark, sf_dir):
    m = event_metrics(spark, sf_dir).select(F.col("metric_name").alias("feature"), "value", "timestamp")
    cut = F.lit("2024-01-15").cast("timestamp")
    return rounded(forecast.psi(m.where(F.col("timestamp") < cut), m.where(F.col("timestamp") >= cut)))


@query(f"""WITH {SCORES}, o AS (SELECT resource_id, error, row_number() OVER w - 1 AS i, count(*) OVER p AS n, sum(error) OVER p AS al, sum(error) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head,
    avg(error) OVER b AS m0, var_pop(error) OVER b AS v0, avg(error) OVER a AS m1, var_pop(error) OVER a AS v1 FROM scores
  WINDOW p AS (PARTITION BY resource_id), w AS (PARTITION BY resource_id ORDER BY window_id), b AS (PARTITION BY resource_id ORDER BY window_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY resource_id ORDER BY window_id ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
s AS (SELECT *, abs(m1 - m0) / sqrt(((v0 + v1) / 2 + 1e-10) * (1.0 / 30 + 1.0 / 30)) AS score FROM o WHERE i >= 30 AND i < n - 30),
k AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY score DESC, i) AS best FROM s), t AS (SELECT resource_id, count(*) AS n, avg(error) AS mean FROM scores GROUP BY 1)
SELECT t.resource_id, coalesce(score > -ln(0.01), false) AS has_drift, CASE WHEN score > -ln(0.01) THEN i END AS change_point_index, round(CASE WHEN t.n >= 60 THEN coalesce(score, 0) END, 5) AS score, round(coalesce(head / i, mean), 6) AS mean_before, round(coalesce((al - head) / (k.n - i), mean), 6) AS mean_after
FROM t LEFT JOIN k ON k.resource_id = t.resource_id AND best = 1""")
def change_point(spark, sf_dir):
    found = forecast.change_point(_scores(spark, sf_dir).withColumn("ordinal", F.col("window_id")), ["resource_id"])
    return found.select("resource_id", "has_drift", F.col("change_point_index").cast("long").alias("change_point_index"), F.round("score", 5).alias("score"), F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.naive_forecast(hourly_metrics(spark, sf_dir), 20)


FC = f"{H}, fc AS (SELECT resource_id, metric_name, timestamp, value AS actual, quantile_cont(value, 0.5) OVER w AS median, quantile_cont(value, 0.1) OVER w AS lower, quantile_cont(value, 0.9) OVER w AS upper FROM h WINDOW w AS (PARTITION BY resource_id, metric_name ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), f AS (SELECT * FROM fc WHERE median IS NOT NULL)"


# ln(1 + score) compares scores by relative precision, as intervals of no width give 1e10 and more
@query(f"""WITH {FC}, v AS (SELECT *, greatest((actual - upper) / greatest(upper - lower, 1e-10), (lower - actual) / greatest(upper - lower, 1e-10), 0) AS x FROM f), g AS (SELECT resource_id, timestamp, max(x) AS score, coalesce(string_agg(CASE WHEN x > 0 THEN metric_name END, ',' ORDER BY metric_name), '') AS violated FROM v GROUP BY 1, 2)
SELECT resource_id, CAST(epoch(timestamp) AS BIGINT) AS timestamp, round(ln(1 + score), 4) AS log_score, violated, CASE WHEN score >= 2 THEN 'critical' WHEN score >= 1 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM g""")
def interval_anomaly(spark, sf_dir):
    out = forecast.interval_anomaly(_forecasts(spark, sf_dir), ["resource_id", "timestamp"])
    return rounded(out.select("resource_id", "timestamp", F.round(F.log1p("score"), 4).alias("log_score"), F.array_join("violated", ",").alias("violated"), "severity"))


@query(f"WITH {FC} SELECT resource_id, metric_name, CAST(epoch(timestamp) AS BIGINT) AS timestamp, round(actual - median, 6) AS residual, round(upper - lower, 6) AS width FROM f")
def residual_features(spark, sf_dir):
    return rounded(forecast.residuals(_forecasts(spark, sf_dir)).select("resource_id", "metric_name", "timestamp", "residual", "width"))


@query(f"""WITH {FC}, o AS (SELECT metric_name AS horizon, actual, median, lower, upper, epoch(timestamp) * 100 + CAST(resource_id AS BIGINT) AS ordinal FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ordinal DESC) AS k FROM o), l AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY horizon ORDER BY ordinal)) AS step FROM r WHERE k <= 500)
SELECT horizon, count(*) AS n, round(avg(CAST(actual BETWEEN lower AND upper AS INT)), 6) AS picp, round(avg(upper - lower), 6) AS mpiw, round(avg(abs(actual - median)), 6) AS mae, round(CASE WHEN count(*) >= 2 AND avg(step) >= 1e-10 THEN avg(abs(actual - median)) / avg(step) END, 6) AS mase FROM l GROUP BY 1""")
def forecast_accuracy(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).withColumns({"horizon": F.col("metric_name"), "ordinal": F.unix_seconds("timestamp") * 100 + F.col("resource_id").cast("long")})
    return rounded(forecast.accuracy(rows))


@query("""WITH r AS (SELECT user_id % 6 AS g, event_id, CAST(user_id % 4 AS INT) AS c, value AS v FROM events), l AS (SELECT *, CAST(c <> lag(c) OVER (PARTITION BY g ORDER BY event_id) AS INT) AS moved FROM r), s AS (SELECT g, max(n) AS top FROM (SELECT g, c, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT l.g AS "group", round(avg(moved), 6) AS transition_rate, round(stddev_pop(v), 5) AS confidence_std, count(*) AS n, round(CAST(any_value(top) AS DOUBLE) / count(*), 6) AS dominant_share FROM l JOIN s ON s.g = l.g GROUP BY 1""")
def cluster_stability(spark, sf_dir):
    user = F.col("resource_id").cast("long")
    rows = event_metrics(spark, sf_dir).select((user % 6).alias("group"), "ordinal", (user % 4).cast("int").alias("cluster_id"), F.col("value").alias("confidence"))
    out = forecast.cluster_stability(rows, ["group"])
    return out.select("group", F.round("transition_rate", 6).alias("transition_rate"), F.round("confidence_std", 5).alias("confidence_std"), "n", F.round("dominant_share", 6).alias("dominant_share"))


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, event_type AS metric_name, round(max(value), 6) AS max_value, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2""")
def hourly_rollup(spark, sf_dir):
    m = event_metrics(spark, sf_dir).groupBy(F.window("timestamp", "1 hour").alias("w"), "metric_name").agg(F.max("value").alias("x"), F.sum("value").alias("s"), F.avg("value").alias("a"))
    return m.select(F.unix_seconds("w.start").alias("hour"), "metric_name", F.round("x", 6).alias("max_value"), F.round("s", 4).alias("sum_value"), F.round("a", 6).alias("avg_value"))


@query(f"""WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY resource_id, metric_name ORDER BY timestamp DESC) AS k FROM h WHERE value IS NOT NULL),
q AS (SELECT resource_id, metric_name, max(timestamp) AS made_at, quantile_cont(value, 0.1) AS lower, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS upper FROM r WHERE k <= 500 GROUP BY 1, 2)
SELECT resource_id, metric_name, CAST(epoch(made_at) AS BIGINT) AS made_at, horizon, round(lower, 4) AS lower, round(median, 4) AS median, round(upper, 4) AS upper FROM q, (VALUES (15), (60), (240), (1440)) v(horizon)""")
def forecast_horizons(spark, sf_dir):
    return rounded(forecast.forecast_horizons(hourly_metrics(spark, sf_dir)))


@query(f"""WITH {FC} SELECT f.resource_id, f.metric_name, CAST(epoch(f.timestamp) AS BIGINT) AS made_at, horizon, round(h.value - f.median, 6) AS residual, round(f.upper - f.lower, 6) AS width
FROM f, (VALUES (1), (6)) v(horizon), h WHERE h.resource_id = f.resource_id AND h.metric_name = f.metric_name AND h.timestamp = f.timestamp + horizon * INTERVAL 1 HOUR""")
def forecast_actuals(spark, sf_dir):
    made = _forecasts(spark, sf_dir).drop("actual").withColumnRenamed("timestamp", "made_at").withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(6))))
    return rounded(forecast.residuals(forecast.with_actuals(made, hourly_metrics(spark, sf_dir), 3600.0)).select("resource_id", "metric_name", "made_at", "horizon", "residual", "width"))


@query(f"""WITH {W5}, ctx AS (SELECT pos, {', '.join(f'avg({f}) AS {f}' for f in NUMERICAL)} FROM filled GROUP BY 1), u AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS x FROM ctx" for f in NUMERICAL)}),
q AS (SELECT feature, avg(x) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.9), 4) - round(quantile_cont(x, 0.1), 4) AS width FROM u GROUP BY 1)
SELECT kind || '_' || feature || '_' || CAST(horizon AS VARCHAR) AS name, round(CASE kind WHEN 'residual' THEN mean - median ELSE width END, 5) AS value FROM q, (VALUES ('residual'), ('width')) k(kind), (VALUES (15), (60), (240), (1440)) v(horizon)""")
def enriched_windows(spark, sf_dir):
    rows = _filled(spark, sf_dir)
    told = forecast.forecast_horizons(forecast.mean_windows(rows, NUMERICAL), by=["feature"])
    wide, names = forecast.enrich(rows, NUMERICAL, forecasts=told)
    one = wide.agg(*(F.max(n).alias(n) for n in names))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("name", "value")).select("name", F.round("value", 5).alias("value"))


# -- clusters ----------------------------------------------------------------------------------

C_SQL = """e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), c AS (SELECT label AS cluster_id, p, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),
  d AS (SELECT vec_id, any_value(label) AS label, cluster_id, sum((e.x - c.x) * (e.x - c.x)) AS d2 FROM e JOIN c USING (p) GROUP BY vec_id, cluster_id),
  q AS (SELECT vec_id, cluster_id, label, d2, (1 / (1 + d2)) / sum(1 / (1 + d2)) OVER (PARTITION BY vec_id) AS q FROM d)"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return clustering.soft_assign(rows, clustering.centroids(rows))


@query(f"WITH {C_SQL} SELECT vec_id, cluster_id, round(q, 5) AS q FROM q")
def soft_assignment(spark, sf_dir):
    return rounded(_soft(spark, sf_dir), 5)


@query(f"WITH {C_SQL}, f AS (SELECT cluster_id, sum(q) AS f FROM q GROUP BY 1), p AS (SELECT vec_id, cluster_id, q * q / f AS p FROM q JOIN f USING (cluster_id)) SELECT vec_id, cluster_id, round(p / sum(p) OVER (PARTITION BY vec_id), 5) AS p FROM p")
def target_distribution(spark, sf_dir):
    return rounded(clustering.target_distribution(_soft(spark, sf_dir)).drop("q"), 5)


@query(f"""WITH {C_SQL}, f AS (SELECT cluster_id, sum(q) AS f FROM q GROUP BY 1), t AS (SELECT vec_id, cluster_id, q.q, q.q * q.q / f AS p FROM q JOIN f USING (cluster_id)), s AS (SELECT vec_id, cluster_id, q, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM t),
  k AS (SELECT vec_id, sum(p * ln((p + 1e-10) / (q + 1e-10))) AS kl FROM s GROUP BY 1), z AS (SELECT cluster_id, avg(q) AS f FROM s GROUP BY 1)
SELECT round(avg(kl), 6) AS kl_cluster, count(*) AS rows, (SELECT round(-sum(f * ln(f + 1e-10)), 6) FROM z) AS balance_entropy FROM k""")
def cluster_losses(spark, sf_dir):
    q = _soft(spark, sf_dir)
    return rounded(clustering.divergence(q, clustering.target_distribution(q)))


@query(f"WITH {C_SQL} SELECT cluster_id, count(*) AS size, round(avg(sqrt(d2)), 5) AS mean_distance, round(stddev_pop(sqrt(d2)), 5) AS distance_std, round((SELECT avg(s) FROM (SELECT stddev_pop(CAST(x AS DOUBLE)) AS s FROM e WHERE e.label = d.cluster_id GROUP BY p)), 5) AS mean_std, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 5) AS percent FROM d WHERE cluster_id = label GROUP BY 1")
def cluster_summary(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return rounded(clustering.cluster_summary(rows, rows.select("vec_id", F.col("label").alias("cluster_id")), clustering.centroids(rows)), 5).select("cluster_id", "size", "mean_distance", "distance_std", "mean_std", "percent")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN label = own AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> own THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette, count(*) AS rows FROM m""")
def silhouette(spark, sf_dir):
    return rounded(clustering.silhouette(_embeddings(spark, sf_dir)))


@query()
def kmeans_clusters(spark, sf_dir):
    return clustering.kmeans(_embeddings(spark, sf_dir), 10)


@query()
def pca_scores(spark, sf_dir):
    return scoring.pca_scorer(3)(_normalised(spark, sf_dir), NUMERICAL)


# -- sources -----------------------------------------------------------------------------------


@query("""WITH x AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms, value, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS resource_id, name AS metric_name, ms, round(CASE name WHEN 'value' THEN value ELSE CAST(event_id AS DOUBLE) END, 6) AS value FROM x, (VALUES ('value'), ('id')) v(name) WHERE NOT (name = 'value' AND event_id % 3 = 0)""")
def vendor_unpivot(spark, sf_dir):
    return _unpivoted(event_metrics(spark, sf_dir))


def _unpivoted(events: DataFrame) -> DataFrame:
    cell = F.when(F.col("ordinal") % 3 == 0, "No Data").otherwise(F.col("value").cast("string"))
    payload = events.select("resource_id", F.lit("h").alias("host_name"), F.lit("ds").alias("datasource_name"), F.lit("i").alias("datasource_instance"), F.array(F.lit("value"), F.lit("id")).alias("data_points"), F.array(F.unix_millis("timestamp")).alias("time"), F.array(F.array(cell, F.col("ordinal").cast("string"))).alias("values"))
    return unpivot_payload(payload).select("resource_id", "metric_name", F.unix_millis("timestamp").alias("ms"), F.round("value", 6).alias("value"))


@query(f"WITH {M} SELECT resource_id, metric_name, epoch_us(timestamp) AS at FROM m WHERE timestamp <= TIMESTAMP '2024-01-20' AND timestamp > TIMESTAMP '2024-01-20' - INTERVAL 36 HOUR")
def lookback_scan(spark, sf_dir):
    kept = lookback(event_metrics(spark, sf_dir), datetime(2024, 1, 20, tzinfo=timezone.utc), 36)
    return kept.select("resource_id", "metric_name", F.unix_micros("timestamp").alias("at"))


# -- serving -----------------------------------------------------------------------------------


@query(f"WITH {H}, r AS (SELECT *, dense_rank() OVER (PARTITION BY resource_id ORDER BY timestamp DESC) AS k FROM h) SELECT resource_id, count(*) AS cells, count(DISTINCT metric_name) AS metrics, CAST(epoch(min(timestamp)) AS BIGINT) AS first_time FROM r WHERE k <= 12 GROUP BY 1")
def recent_window(spark, sf_dir):
    recent = serving.recent_rows(hourly_metrics(spark, sf_dir), SIZE)
    return rounded(recent.groupBy("resource_id").agg(F.count("*").alias("cells"), F.countDistinct("metric_name").alias("metrics"), F.min("timestamp").alias("first_time")))


@query(f"""WITH {H}, l AS (SELECT resource_id, metric_name, list(value ORDER BY timestamp) AS v FROM h WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT resource_id, metric_name, CASE WHEN metric_name IN ('signup', 'error') THEN 'categorical' ELSE 'numerical' END AS kind, len(v) AS n, round(list_sum(v[-50:]), 4) AS last_sum, round(CASE WHEN len(v) >= 50 THEN v[-50] ELSE 0 END, 6) AS first_kept FROM l""")
def request_series(spark, sf_dir):
    series = serving.split_series(hourly_metrics(spark, sf_dir), profiles_frame(spark, PROFILES[:1])).select("resource_id", "kind", F.explode("series").alias("metric_name", "values"))
    fitted = serving.fit_length(series.withColumn("n", F.size("values").cast("long")), 50)
    return fitted.select("resource_id", "metric_name", "kind", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("last_sum"), F.round(F.element_at("values", 1), 6).alias("first_kept"))


@query(f"""WITH {Q_SQL}, r AS (SELECT coalesce(100 * avg(CAST(is_live AS INT)), 0) AS f, coalesce(100 * avg(density), 0) AS g FROM q) SELECT f >= 50 AND g >= 80 AS ready FROM r""")
def quality_gate(spark, sf_dir):
    return quality.quality_gate(quality.quality_rollup(quality.series_quality(event_metrics(spark, sf_dir)))).select("ready")


LAST = ", ".join(f"coalesce(last_value({f} IGNORE NULLS) OVER back, first_value({f} IGNORE NULLS) OVER ahead, 0) AS {f}" for f in NUMERICAL)


@query(f"""WITH {W5}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY resource_id ORDER BY timestamp DESC) AS k FROM h WHERE value IS NOT NULL AND metric_name IN ('click', 'view', 'purchase')), rec AS (SELECT * FROM rk WHERE k <= {SIZE}),
  lw AS (SELECT resource_id, timestamp, {', '.join(f"max(CASE WHEN metric_name = '{f}' THEN value END) AS {f}" for f in NUMERICAL)} FROM rec GROUP BY 1, 2),
  lf AS (SELECT resource_id, timestamp, {LAST} FROM lw WINDOW back AS (PARTITION BY resource_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY resource_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  sc AS (SELECT resource_id, max(timestamp) AS end_time, ({' + '.join(f'var_pop(({f} - m_{f}) / s_{f})' for f in NUMERICAL)}) / 3 AS error FROM lf, params GROUP BY 1 HAVING count(*) = {SIZE}),
  cv AS (SELECT resource_id, count(DISTINCT metric_name) / 3.0 AS coverage FROM rec GROUP BY 1)
SELECT resource_id, CAST(epoch(end_time) AS BIGINT) AS end_time, round(error, 6) AS error, round(error / 0.9, 6) AS ratio, error / 0.9 > 1 AS is_anomaly, CASE WHEN error / 0.9 > 2 THEN 4 WHEN error / 0.9 > 1.5 THEN 3 WHEN error / 0.9 > 1 THEN 2 ELSE 1 END AS severity, round(coverage, 6) AS coverage FROM sc JOIN cv USING (resource_id)""")
def served_scores(spark, sf_dir):
    """The last window of every resource, scored in one job."""
    params = features.fit_zscore(_filled(spark, sf_dir), NUMERICAL)
    out = serving.score_latest(hourly_metrics(spark, sf_dir), NUMERICAL, params, scoring.global_override(0.9), SIZE)
    return rounded(out.select("resource_id", "end_time", "error", "ratio", "is_anomaly", "severity", "coverage"))


RUBRIC = {
    "version": 1, "profile": "events", "headline_grid": "offline", "grids": {"offline": {"step_samples": 1}},
    "detection": {"mode": "lookback", "onset_anchor": "T0", "sustain": 3, "lead_in_hours": 24, "max_leadtime_minutes": LONGEST_LEAD // 60},
    "gates": {
        "no_pre_onset_bridging": {"required": True, "allow_absent": True}, "detection_lead": {"required": True, "allow_absent": True, "min_lead_vs": "T2", "min_lead_seconds": 0},
        "lead_in_fpr": {"required": True, "allow_absent": True, "max_fraction": 0.05, "min_eval_windows": 12},
        "alarm_fatigue": {"required": True, "allow_absent": True, "sustain": 1, "max_time_in_alarm_fraction_per_resource": 0.15, "max_fleet_raises_per_week": 10},
        "negative_controls_clean": {"required": True, "allow_absent": True}, "coverage_integrity": {"required": True}, "sanity": {"required": True},
    },
}
NO_CASES = "SELECT '{case}' AS case_name, '{gate}' AS gate, false AS applicable, true AS passed, '' AS offenders"


@query(f"""WITH {SCAN}, det AS (SELECT case_id, anchor, {LOOKBACK} AS t, coalesce(bool_or(run_start < anchor AND run_end >= anchor), false) AS bridged FROM j WHERE case_id = 'b' GROUP BY 1, 2),
  ld AS (SELECT f.* FROM flagged f JOIN incidents i ON case_id = 'b' AND f.resource_id = i.resource_id AND f.end_time >= i.anchor - INTERVAL 1 DAY AND f.end_time < i.anchor), lr AS ({RUNS.format(by='resource_id', of='ld')}),
  li AS (SELECT (SELECT count(*) FROM ld) AS n, coalesce((SELECT sum(length) FROM lr WHERE length >= 3), 0) AS covered),
  cs AS (SELECT f.* FROM flagged f JOIN incidents i ON case_id = 'b' AND f.resource_id IN ('3', '5') AND f.end_time >= i.anchor - INTERVAL 1 DAY AND f.end_time <= i."end"), cr AS ({RUNS.format(by='resource_id', of='cs')}),
  hv AS (SELECT DISTINCT resource_id, metric_name FROM h WHERE value IS NOT NULL AND metric_name IN ('click', 'view', 'purchase')), ur AS (SELECT DISTINCT metric_name FROM hv),
  el AS (SELECT resource_id, count(*) < 50 OR quantile_cont(error, 0.99) <= 0 OR (SELECT count(*) FROM hv WHERE hv.resource_id = scores.resource_id) < (SELECT count(*) FROM ur) AS dirty FROM scores GROUP BY 1),
  fr AS ({RUNS.format(by='resource_id', of='flagged')}), st AS (SELECT resource_id, coalesce(quantile_cont(gap, 0.5), 0) AS step FROM (SELECT resource_id, epoch(end_time) - epoch(lag(end_time) OVER (PARTITION BY resource_id ORDER BY end_time, window_id)) AS gap FROM flagged) GROUP BY 1),
  sp AS (SELECT resource_id, epoch(max(end_time)) - epoch(min(end_time)) AS span FROM flagged GROUP BY 1),
  fa AS (SELECT sp.resource_id, (coalesce(sum(epoch(run_end) - epoch(run_start)), 0) + count(length) * any_value(step)) / nullif(any_value(span), 0) AS share, count(length) * 604800 / nullif(any_value(span), 0) AS rate FROM sp JOIN st USING (resource_id) LEFT JOIN fr ON fr.resource_id = sp.resource_id GROUP BY 1),
  who AS (SELECT 'incident' AS case_name, unnest(['2', '3', '5']) AS resource_id UNION ALL SELECT 'healthy', resource_id FROM sp),
  bad AS (SELECT case_name, coalesce(string_agg(CASE WHEN coalesce(dirty, true) THEN who.resource_id END, ',' ORDER BY who.resource_id), '') AS offenders FROM who LEFT JOIN el ON el.resource_id = who.resource_id GROUP BY 1),
  tired AS (SELECT coalesce(string_agg(CASE WHEN share > 0.15 THEN resource_id END, ',' ORDER BY resource_id), '') AS offenders, sum(coalesce(rate, 0)) AS weekly FROM fa),
  noisy AS (SELECT coalesce(string_agg(DISTINCT resource_id, ',' ORDER BY resource_id), '') AS offenders FROM cr WHERE length >= 3)
SELECT 'incident' AS case_name, 'no_pre_onset_bridging' AS gate, true AS applicable, NOT bridged AS passed, CASE WHEN bridged THEN '2' ELSE '' END AS offenders FROM det
UNION ALL SELECT 'incident', 'detection_lead', true, t IS NOT NULL AND epoch(anchor) + 21600 - epoch(t) >= 0, CASE WHEN t IS NOT NULL AND epoch(anchor) + 21600 - epoch(t) >= 0 THEN '' ELSE '2' END FROM det
UNION ALL SELECT 'incident', 'lead_in_fpr', true, n >= 12 AND covered <= 0.05 * n, CASE WHEN n >= 12 AND covered <= 0.05 * n THEN '' ELSE '2' END FROM li
UNION ALL SELECT 'incident', 'negative_controls_clean', true, offenders = '', offenders FROM noisy
UNION ALL SELECT case_name, 'coverage_integrity', true, offenders = '', offenders FROM bad
UNION ALL SELECT c, 'sanity', true, (SELECT threshold > 0 FROM thr), CASE WHEN (SELECT threshold > 0 FROM thr) THEN '' ELSE 'all' END FROM (VALUES ('incident'), ('healthy')) v(c)
UNION ALL SELECT 'healthy', 'alarm_fatigue', true, offenders = '' AND weekly <= 10, offenders FROM tired
UNION ALL {NO_CASES.format(case='incident', gate='alarm_fatigue')}
UNION ALL {" UNION ALL ".join(NO_CASES.format(case='healthy', gate=g) for g in ('no_pre_onset_bridging', 'detection_lead', 'lead_in_fpr', 'negative_controls_clean'))}""")
def rubric_gates(spark, sf_dir):
    """All seven gates on a case with an incident and two controls, and on the whole fleet taken as healthy."""
    flagged = _flagged(spark, sf_dir).withColumn("source", F.lit("global"))
    later = F.timestamp_seconds(F.unix_seconds("anchor") + 6 * 3600)
    incident = _incidents(spark).where("case_id = 'b'").select("resource_id", F.lit("incident").alias("role"), F.create_map(F.lit("T0"), "anchor", F.lit("T2"), later).alias("onsets"), F.lit("T0").alias("primary_onset"), "end")
    controls = spark.createDataFrame([("3",), ("5",)], "resource_id string").withColumn("role", F.lit("negative_control"))
    labels = incident.unionByName(controls, allowMissingColumns=True)
    hygiene = scoring.eligibility(_scores(spark, sf_dir), hourly_metrics(spark, sf_dir), NUMERICAL)
    read = gates.reading(RUBRIC)
    out = None
    for name, known in (("incident", labels), ("healthy", None)):
        judged = gates.judge(cases.case_metrics(flagged, known, read), RUBRIC, "offline", hygiene, "events").withColumn("case_name", F.lit(name))
        out = judged if out is None else out.unionByName(judged)
    return out.select("case_name", "gate", "applicable", "passed", F.array_join("offenders", ",").alias("offenders"))


@query(f"""WITH {FLAGGED}, {I_SQL}, fr AS ({RUNS.format(by='resource_id', of='flagged')}), st AS (SELECT resource_id, coalesce(quantile_cont(gap, 0.5), 0) AS step FROM (SELECT resource_id, epoch(end_time) - epoch(lag(end_time) OVER (PARTITION BY resource_id ORDER BY end_time, window_id)) AS gap FROM flagged) GROUP BY 1),
  o AS (SELECT i.resource_id, epoch(i."end") - epoch(anchor) AS span, epoch(run_end) + step AS cleared, least(epoch(run_end) + step, epoch(i."end")) - greatest(epoch(run_start), epoch(anchor)) AS ov, epoch(i."end") AS e FROM incidents i LEFT JOIN st ON st.resource_id = i.resource_id LEFT JOIN fr ON fr.resource_id = i.resource_id AND length >= 3),
  c AS (SELECT resource_id, any_value(span) AS span, coalesce(sum(ov) FILTER (ov > 0), 0) AS secs, any_value(e) - max(cleared) FILTER (ov > 0) AS clear FROM o GROUP BY 1)
SELECT c.resource_id, 'incident' AS role, round(secs, 6) AS alarm_seconds_in_incident, round(secs / span, 6) AS coverage_fraction, round(clear, 6) AS clear_lead_vs_end_s, (SELECT count(*) FROM flagged f WHERE f.resource_id = c.resource_id) AS n_eval_windows,
  (SELECT count(*) FROM fr WHERE fr.resource_id = c.resource_id AND length >= 3) AS runs_3, (SELECT count(*) FROM fr WHERE fr.resource_id = c.resource_id) AS runs_1 FROM c""")
def case_metrics(spark, sf_dir):
    """What the harness says of each incident resource, with alarms lasting a step beyond their last window."""
    labels = _incidents(spark).select("resource_id", F.lit("incident").alias("role"), F.create_map(F.lit("T0"), "anchor").alias("onsets"), F.lit("T0").alias("primary_onset"), "end")
    per = cases.case_metrics(_flagged(spark, sf_dir).withColumn("source", F.lit("global")), labels, gates.reading(RUBRIC))
    runs = lambda s: F.element_at("sustained_run_counts", F.lit(s))
    return rounded(per.select("resource_id", "role", "alarm_seconds_in_incident", "coverage_fraction", "clear_lead_vs_end_s", "n_eval_windows", runs(3).alias("runs_3"), runs(1).alias("runs_1")))


POOLED = f"{SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY end_time, resource_id, window_id) AS rn, count(*) OVER () AS n FROM scores), t AS (SELECT quantile_cont(error, 0.99) AS threshold FROM o WHERE rn <= n // 2)"


@query(f"""WITH {POOLED}, hv AS (SELECT DISTINCT resource_id, metric_name FROM h WHERE value IS NOT NULL AND metric_name IN ('click', 'view', 'purchase')), ur AS (SELECT DISTINCT metric_name FROM hv),
own AS (SELECT resource_id, 1.5 * quantile_cont(error, 0.99) AS threshold FROM scores GROUP BY 1 HAVING count(*) >= 50 AND quantile_cont(error, 0.99) > 0 AND (SELECT count(*) FROM hv WHERE hv.resource_id = scores.resource_id) = (SELECT count(*) FROM ur))
SELECT 'GLOBAL' AS resource_id, round(threshold, 6) AS threshold, (SELECT round(avg(CAST(error > threshold AS INT)), 6) FROM o WHERE rn > n // 2 + 12) AS healthy_fpr FROM t UNION ALL SELECT resource_id, round(threshold, 6), NULL FROM own""")
def serving_bake(spark, sf_dir):
    """The block that a healthy capture bakes into a model, as rows."""
    model = suite.Model(Profile("events", NUMERICAL, CATEGORICAL), features.fit_zscore(_filled(spark, sf_dir, 1), NUMERICAL), scoring.score_window_mean, SIZE)
    block, _ = suite.bake_serving_block(model, hourly_metrics(spark, sf_dir), 0.99, 1, 1.5)
    rows = [("GLOBAL", block["threshold"], block["healthy_fpr"]), *((r, t, None) for r, t in block["per_resource"].items())]
    return rounded(spark.createDataFrame(rows, "resource_id string, threshold double, healthy_fpr double"))


@query(f"""WITH {SCORES}, {I_SQL}, pre AS (SELECT *, row_number() OVER (ORDER BY end_time, resource_id, window_id) AS rn, count(*) OVER () AS n FROM scores WHERE end_time < (SELECT min(anchor) FROM incidents)),
  thr AS (SELECT quantile_cont(error, {QUANTILE}) AS threshold FROM pre WHERE rn <= n // 2), flagged AS (SELECT scores.*, error > threshold AS flag FROM scores, thr),
  scan AS (SELECT f.*, i.case_id FROM flagged f JOIN incidents i ON f.resource_id = i.resource_id AND f.end_time >= i.anchor - INTERVAL 12 HOUR AND f.end_time <= i."end"),
  step AS (SELECT case_id, coalesce(quantile_cont(gap, 0.5), 0) AS step FROM (SELECT case_id, epoch(end_time) - epoch(lag(end_time) OVER (PARTITION BY case_id ORDER BY end_time, window_id)) AS gap FROM scan) GROUP BY 1),
  runs AS (SELECT * FROM ({RUNS.format(by='case_id', of='scan')}) WHERE length >= 3), j AS (SELECT i.case_id, i.anchor, step, run_start, run_end FROM incidents i LEFT JOIN step USING (case_id) LEFT JOIN runs USING (case_id)),
  d AS (SELECT case_id, any_value(anchor) AS anchor, {LOOKBACK} AS t FROM j GROUP BY 1)
SELECT d.case_id, t IS NOT NULL AS detected, epoch(anchor) - epoch(t) AS lead_time_seconds, (SELECT round(max(error), 6) FROM scores s JOIN incidents i ON i.case_id = d.case_id AND s.resource_id = i.resource_id AND s.end_time BETWEEN i.anchor AND i."end") AS max_error_in_window,
  (SELECT round(threshold, 6) FROM thr) AS threshold, (SELECT round(avg(CAST(error > threshold AS INT)), 6) FROM pre, thr WHERE rn > n // 2 + 12) AS healthy_fpr FROM d""")
def incident_summary(spark, sf_dir):
    """A capture with incidents from threshold to leads."""
    out = incident.analyse(_scores(spark, sf_dir), _incidents(spark).withColumn("type", F.lit("load")), quantile=QUANTILE, gap=SIZE, max_lead=LONGEST_LEAD)
    rows = [(i["case_id"], i["detected"], i["lead_time_seconds"], i["max_error_in_window"], out["threshold"], out["healthy_fpr"]) for i in out["incidents"]]
    return rounded(spark.createDataFrame(rows, "case_id string, detected boolean, lead_time_seconds double, max_error_in_window double, threshold double, healthy_fpr double"))


@query()
def cluster_predictions(spark, sf_dir):
    """Every resource's last window through a recurrent auto-encoder: cluster, what to do, how sure. The weights are seeded stand-ins."""
    filled = _filled(spark, sf_dir)
    rows = features.apply_minmax(features.apply_zscore(filled, features.fit_zscore(filled, NUMERICAL), NUMERICAL), features.fit_minmax(filled, CATEGORICAL), CATEGORICAL, clip=True)
    load = partial(neural.random_network, len(NUMERICAL), len(CATEGORICAL))
    return neural.predictions(neural.score_windows(rows, NUMERICAL, CATEGORICAL, load))


@query()
def served_requests(spark, sf_dir):
    """Every resource's series as a request, predicted by the recurrent auto-encoder with stand-in weights."""
    split = serving.split_series(hourly_metrics(spark, sf_dir), profiles_frame(spark, PROFILES[:1]))
    per = split.groupBy(F.col("resource_id").alias("request_id")).agg(*(F.first(F.when(F.col("kind") == k, F.col("series")), ignorenulls=True).alias(k) for k in ("numerical", "categorical")))
    load = partial(neural.random_network, len(NUMERICAL), len(CATEGORICAL))
    return serving.predict(per, dict.fromkeys(NUMERICAL, (50.0, 30.0)), dict.fromkeys(CATEGORICAL, (0.0, 100.0)), load, 30, 1.0)


# -- small reports -----------------------------------------------------------------------------


@query(f"""WITH {M}, {P_SQL}, d AS (SELECT DISTINCT metric_name FROM m), c AS (SELECT profile, 100.0 * count(metric_name) / count(*) AS coverage, string_agg(CASE WHEN metric_name IS NULL THEN feature END, ', ' ORDER BY feature) AS missing FROM p LEFT JOIN d ON feature = metric_name GROUP BY 1)
SELECT profile, coverage >= 80 AS ready, CASE WHEN coverage < 80 THEN printf('%s: %.1f%% of features present, missing %s', profile, coverage, missing) END AS warning FROM c""")
def coverage_gate(spark, sf_dir):
    covered = quality.coverage(profiles_frame(spark, PROFILES).select("profile", "feature"), event_metrics(spark, sf_dir))
    return quality.coverage_gate(covered).select("profile", "ready", "warning")


@query(f"WITH {M}, {P_SQL} SELECT DISTINCT feature FROM p WHERE feature NOT IN (SELECT metric_name FROM m WHERE value IS NOT NULL)")
def absent_features(spark, sf_dir):
    names = sorted({f for p in PROFILES for f in p.features})
    return small_table(spark, [(f,) for f in features.absent_features(event_metrics(spark, sf_dir), names)], "feature string")


@query("""WITH m AS (SELECT user_id % 8 AS r, event_type, ts, arg_min(CASE WHEN event_type = 'click' THEN event_id ELSE value END, event_id) AS v FROM events GROUP BY 1, 2, 3), s AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type, r ORDER BY ts) AS d FROM m WHERE v IS NOT NULL),
k AS (SELECT event_type, r, avg(CAST(d >= 0 AS INT)) >= 0.99 AND avg(CAST(d > 0 AS INT)) >= 0.05 AS hit FROM s GROUP BY 1, 2 HAVING count(*) > 50), w AS (SELECT event_type, count(*) AS judged, count(*) FILTER (hit) AS hits FROM k GROUP BY 1)
SELECT event_type AS metric_name, printf('%s rises like a counter on %d of %d series; it will leave any fixed range, so it is no feature for a model', event_type, hits, judged) AS warning FROM w WHERE 2 * hits >= judged""")
def counter_warnings(spark, sf_dir):
    m = event_metrics(spark, sf_dir).withColumns({"resource_id": F.col("resource_id").cast("long") % 8, "datasource_instance": F.lit(None).cast("string"), "value": F.when(F.col("metric_name") == "click", F.col("ordinal").cast("double")).otherwise(F.col("value"))})
    return quality.counter_warnings(quality.counter_shape(m))


@query(f"""WITH {FC}, o AS (SELECT metric_name AS horizon, actual, median, lower, upper, epoch(timestamp) * 100 + CAST(resource_id AS BIGINT) AS ordinal FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ordinal DESC) AS k FROM o), l AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY horizon ORDER BY ordinal)) AS step FROM r WHERE k <= 500)
SELECT horizon, round_even(avg(CAST(actual BETWEEN lower AND upper AS INT)), 4) AS picp, round_even(avg(upper - lower), 4) AS mpiw, round_even(avg(abs(actual - median)), 4) AS mae, round_even(avg(abs(actual - median)) / avg(step), 4) AS mase FROM l GROUP BY 1""")
def accuracy_status(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).withColumns({"horizon": F.col("metric_name"), "ordinal": F.unix_seconds("timestamp") * 100 + F.col("resource_id").cast("long")})
    return forecast.accuracy_status(forecast.accuracy(rows))


@query(f"WITH {C_SQL}, r AS (SELECT vec_id, label, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, cluster_id) AS k FROM q) SELECT round(avg(CAST(label <> cluster_id AS INT)), 6) AS changed FROM r WHERE k = 1")
def cluster_convergence(spark, sf_dir):
    before = _embeddings(spark, sf_dir).select("vec_id", F.col("label").alias("cluster_id"))
    return rounded(clustering.changed_share(before, clustering.hard_assign(_soft(spark, sf_dir))))


@query(f"""WITH {H}, l AS (SELECT resource_id, metric_name, list(value ORDER BY timestamp) AS v FROM h WHERE value IS NOT NULL AND metric_name IN ('click', 'view', 'purchase') GROUP BY 1, 2), g AS (SELECT *, max(len(v)) OVER (PARTITION BY resource_id) AS longest FROM l),
x AS (SELECT resource_id, metric_name, longest, len(v) AS n, unnest(v) AS value, unnest(range(len(v))) AS pos FROM g) SELECT resource_id, metric_name, 946684800 + 60 * (longest - n + pos) AS timestamp, round(value, 6) AS value FROM x""")
def series_frame(spark, sf_dir):
    split = serving.split_series(hourly_metrics(spark, sf_dir), profiles_frame(spark, PROFILES[:1])).where("kind = 'numerical'")
    return rounded(features.series_frame(split.select(F.col("resource_id").alias("request_id"), F.col("series").alias("metrics"))))


# -- streams -----------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All events as a stream, to its end; what it has given so far as a table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    metrics = stream.select(F.col("user_id").cast("string").alias("resource_id"), F.col("event_type").alias("metric_name"), F.col("ts").cast("timestamp").alias("timestamp"), "value", F.col("event_id").alias("ordinal"))
    name = f"streamed_{uuid.uuid4().hex}"
    of(metrics).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type AS metric_name, round(max(value), 6) AS max_value, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2""")
def streamed_rollup(spark, sf_dir):
    out = _streamed(spark, sf_dir, streaming.rollup, "complete")
    return out.select(F.unix_seconds("start").alias("start"), "metric_name", F.round("max_value", 6).alias("max_value"), F.round("sum_value", 4).alias("sum_value"), F.round("avg_value", 6).alias("avg_value"))


@query("""WITH r AS (SELECT event_type AS stream, event_id, value AS error, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events), l AS (SELECT stream, event_id, error, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY stream) AS n,
    avg(error) OVER b AS m0, var_pop(error) OVER b AS v0, avg(error) OVER a AS m1, var_pop(error) OVER a AS v1 FROM r WHERE k <= 500
  WINDOW w AS (PARTITION BY stream ORDER BY event_id), b AS (PARTITION BY stream ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY stream ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
s AS (SELECT *, abs(m1 - m0) / sqrt(((v0 + v1) / 2 + 1e-10) * (1.0 / 30 + 1.0 / 30)) AS score FROM l WHERE i >= 30 AND i < n - 30), t AS (SELECT stream, max(score) AS score FROM s GROUP BY 1)
SELECT l.stream, count(*) AS n, coalesce(any_value(t.score) > -ln(0.01), false) AS has_drift, round(CASE WHEN count(*) >= 60 THEN coalesce(any_value(t.score), 0) END, 5) AS score FROM l LEFT JOIN t ON t.stream = l.stream GROUP BY 1""")
def streamed_change_points(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda m: streaming.change_points(m.select(F.col("metric_name").alias("stream"), "ordinal", F.col("value").alias("error"))), "update")
    return out.select("stream", "n", "has_drift", F.round("score", 5).alias("score"))
