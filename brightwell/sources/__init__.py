"""Metric tables in and out: Parquet and CSV scans, canonical columns, vendor payloads, labels, sinks."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from pathlib import Path
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwell.functions import moment, number, small_table

CANONICAL = T.StructType(
    [
        T.StructField("resource_id", T.StringType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("datasource_instance", T.StringType()),
        T.StructField("datasource_name", T.StringType()),
    ]
)
#: Where Hadoop's file systems have other names than object stores' own tools.
SCHEMES = {"s3": "s3a", "gcs": "gs", "az": "abfss", "azure": "abfss"}


class MetricSource(Protocol):
    """What a metric source offers; any object with these methods will do."""

    def metrics(self, start: datetime | None, end: datetime | None, names: list[str] | None) -> DataFrame: ...

    def resources(self) -> DataFrame: ...

    def metric_names(self) -> DataFrame: ...

    def summary(self) -> DataFrame: ...


@dataclass(frozen=True)
class Profile:
    """An ordered list of numerical and categorical features."""

    name: str
    numerical: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    description: str = ""
    model: dict = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return self.numerical + self.categorical


def profiles_frame(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    rows = [(p.name, f, "numerical" if i < len(p.numerical) else "categorical", i) for p in profiles for i, f in enumerate(p.features)]
    return small_table(spark, rows, "profile string, feature string, kind string, ordinal int")


def load_profiles(path: str) -> list[Profile]:
    """Profiles of a YAML file: a map of name to numerical_features, categorical_features, description and model."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    raw = raw.get("profiles", raw)
    return [Profile(k, tuple(v.get("numerical_features") or ()), tuple(v.get("categorical_features") or ()), v.get("description", ""), v.get("model") or {}) for k, v in raw.items()]


def located(uri: str) -> str:
    scheme, found, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else uri


def _is_csv(path: str, fmt: str | None) -> bool:
    return (fmt or ("csv" if path.lower().endswith(".csv") else "parquet")) == "csv"


def read_files(spark: SparkSession, uri: str, fmt: str | None = None, hive: bool = True) -> DataFrame:
    """A scan of files, globs included, with columns united by name. fmt: csv or parquet, by default by suffix. CSV columns are texts, which `canonical` types."""
    path = located(uri)
    reader = spark.read.option("recursiveFileLookup", str(not hive).lower())
    if not _is_csv(path, fmt):
        return reader.option("mergeSchema", "true").parquet(path)
    # Spark reads all files of a CSV scan by the first one's header, so each header gets a scan of its own
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    scans = []
    for r in heads:
        names = next(csv.reader([r["head"].removeprefix("\ufeff")]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        scans.append(spark.read.schema(schema).csv([unquote(f) for f in r["files"]], header=True))
    if not scans:
        return reader.csv(path, header=True)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def resource_column(columns: list[str]) -> str | None:
    return next((c for c in ("resource_id", "resource_hash") if c in columns), None)


def canonical(raw: DataFrame) -> DataFrame:
    """Any known layout as the canonical columns.

    Which columns exist is decided by schema, values by row: a key of attributes (a JSON text) wins
    over a column of its own, even if the key's value is null; value over value_double over value_int. What is no number or no time
    becomes null; missing columns are null."""
    have = set(raw.columns)

    def first(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def attribute(key: str, *names: str) -> Column:
        if "attributes" not in have:
            return first(*names)
        text = F.col("attributes").cast("string")
        told = F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))
        return F.when(told, F.get_json_object(text, f"$.{key}")).otherwise(first(*names))

    values = [number(F.col(c)) for c in ("value", "value_double", "value_int") if c in have]
    resource = resource_column(raw.columns)
    return raw.select(
        (F.col(resource).cast("string") if resource else F.lit(None).cast("string")).alias("resource_id"),
        attribute("host_name", "host_name").alias("host_name"),
        first("metric_name").alias("metric_name"),
        (moment(F.col("timestamp")) if "timestamp" in have else F.lit(None).cast("timestamp")).alias("timestamp"),
        (F.coalesce(*values) if values else F.lit(None).cast("double")).alias("value"),
        attribute("dataSourceInstanceName", "datasource_instance").alias("datasource_instance"),
        first("datasource_name").alias("datasource_name"),
    )


def in_range(metrics: DataFrame, start: datetime | None = None, end: datetime | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of [start, end) and of the named metrics; no names, no filter. Both reach the Parquet scan."""
    if start is not None:
        metrics = metrics.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        metrics = metrics.where(F.col("timestamp") < F.lit(end))
    return metrics.where(F.col("metric_name").isin(*names)) if names else metrics


def lookback(metrics: DataFrame, reference: datetime, hours: float) -> DataFrame:
    """Rows of (reference - hours, reference]."""
    at = F.lit(reference).cast("timestamp")
    return metrics.where((F.col("timestamp") <= at) & (F.unix_micros("timestamp") > F.unix_micros(at) - int(hours * 3_600_000_000)))


class Files:
    """A metric source over files that Spark can read."""

    def __init__(self, spark: SparkSession, uri: str, fmt: str | None = None) -> None:
        self.table = canonical(read_files(spark, uri, fmt))

    def metrics(self, start: datetime | None = None, end: datetime | None = None, names: list[str] | None = None) -> DataFrame:
        return in_range(self.table, start, end, names)

    def resources(self) -> DataFrame:
        return self.table.select("resource_id").where(F.col("resource_id").isNotNull()).distinct().orderBy("resource_id")

    def metric_names(self) -> DataFrame:
        return self.table.select("metric_name").where(F.col("metric_name").isNotNull()).distinct().orderBy("metric_name")

    def summary(self) -> DataFrame:
        from brightwell.operators.quality import summary

        return summary(self.table)


def write_canonical(metrics: DataFrame, uri: str, fmt: str | None = None) -> dict[str, int]:
    """Write, and count: rows while writing, resources and metrics from two columns of what was written."""
    path, seen = located(uri), Observation()
    metrics = metrics.select(*(F.col(f.name).cast(f.dataType) for f in CANONICAL)).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer, spark = metrics.write.mode("overwrite"), metrics.sparkSession
    if _is_csv(path, fmt):
        writer.csv(path, header=True)
        again = spark.read.schema(CANONICAL).csv(path, header=True)
    else:
        writer.parquet(path)
        again = spark.read.schema(CANONICAL).parquet(path)
    named = again.agg(F.countDistinct("resource_id").alias("resources"), F.countDistinct("metric_name").alias("metrics")).first()
    return {"rows": seen.get["rows"], "resources": named["resources"], "metrics": named["metrics"]}


def unpivot_payload(payload: DataFrame) -> DataFrame:
    """Vendor pages to canonical rows. payload: resource_id, host_name, datasource_name, datasource_instance,
    data_points array<string>, time array<long> (epoch ms), values array<array<string>>; what is no number is dropped."""
    ticks = payload.withColumn("tick", F.explode(F.arrays_zip(F.col("time").alias("ms"), F.col("values").alias("row"))))
    cells = ticks.select("resource_id", "host_name", "datasource_name", "datasource_instance", F.col("tick.ms").alias("ms"), F.explode(F.arrays_zip(F.col("data_points").alias("name"), F.col("tick.row").alias("text"))).alias("cell"))
    return cells.select("resource_id", "host_name", F.col("cell.name").alias("metric_name"), F.timestamp_millis("ms").alias("timestamp"), number(F.col("cell.text")).alias("value"), "datasource_instance", "datasource_name").where(F.col("value").isNotNull())


ROLES = ("incident", "negative_control", "excluded")
ONSETS = ("T0", "T1", "T2", "T2b")


def _utc(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{text!r} has no offset")
    return at


def load_labels(path: str) -> dict:
    """Labels of either version as {capture, cases: [{resource_id, role, type, onsets, primary_onset, end, notes}]}."""
    raw = json.loads(Path(path).read_text())
    if isinstance(raw, list):
        cases = []
        for r in raw:
            if missing := {"resource_id", "type", "start", "end"} - set(r):
                raise ValueError(f"a label lacks {sorted(missing)}")
            cases.append({"resource_id": r["resource_id"], "role": "incident", "type": r["type"], "onsets": {"T0": _utc(r["start"])}, "primary_onset": "T0", "end": _utc(r["end"]), "notes": ""})
        return {"capture": None, "cases": cases}
    if raw.get("version") != 2:
        raise ValueError("labels are of version 1 or 2")
    cases = []
    for c in raw["cases"]:
        if c["role"] not in ROLES:
            raise ValueError(f"no such role: {c['role']}")
        onsets = {k: _utc(v) for k, v in (c.get("onsets") or {}).items()}
        if bad := set(onsets) - set(ONSETS):
            raise ValueError(f"no such onsets: {sorted(bad)}")
        cases.append(c | {"onsets": onsets, "end": _utc(c["end"]) if c.get("end") else None, "notes": c.get("notes", "")})
    return {"capture": raw.get("capture"), "cases": cases}


def dump_labels(labels: dict, path: str) -> None:
    """Always version 2, times in UTC with Z."""
    z = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ") if t else None
    cases = [c | {"onsets": {k: z(v) for k, v in c["onsets"].items()}, "end": z(c["end"])} for c in labels["cases"]]
    Path(path).write_text(json.dumps({"version": 2, "capture": labels["capture"], "cases": cases}, indent=2))


LABELS = "resource_id string, role string, type string, onsets map<string, timestamp>, primary_onset string, end timestamp"


def labels_frame(spark: SparkSession, labels: dict) -> DataFrame:
    return spark.createDataFrame([(c["resource_id"], c["role"], c.get("type"), c["onsets"], c.get("primary_onset"), c["end"]) for c in labels["cases"]], LABELS)


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as metrics: a resource is a user, a metric an event type; ordinal is the order of arrival."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("resource_id"), F.col("event_type").alias("metric_name"), F.col("ts").cast("timestamp").alias("timestamp"), number(F.col("value")).alias("value"), F.col("event_id").alias("ordinal"), F.col("props").alias("attributes"))


def hourly_metrics(spark: SparkSession, sf_dir: str, resources: int = 10) -> DataFrame:
    """A dense stand-in for a fleet: users dealt to a few resources, the first value of each hour."""
    m = event_metrics(spark, sf_dir).withColumn("resource_id", (F.col("resource_id").cast("long") % resources).cast("string")).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return m.groupBy("resource_id", "metric_name", "timestamp").agg(F.min_by("value", "ordinal").alias("value"))
