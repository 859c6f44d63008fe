"""Training sets: seeded samples and splits of windows, stored with their normalisation; a made-up fleet; settings."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def _order(seed: int, key: tuple[str, ...]):
    return F.xxhash64(F.lit(seed), *key)


def seeded_sample(rows: DataFrame, share: float, seed: int = 42, key: tuple[str, ...] = ("resource_id", "window_id")) -> DataFrame:
    """Rows with a hash among the lowest `share`; the same rows for the same seed, however the table is dealt."""
    return rows.where(F.pmod(_order(seed, key), F.lit(1 << 32)) < int(share * (1 << 32)))


def seeded_split(rows: DataFrame, validation: float = 0.2, seed: int = 42, key: tuple[str, ...] = ("resource_id", "window_id")) -> DataFrame:
    """rows with part, train or validation, by hash."""
    low = F.pmod(_order(seed, key), F.lit(1 << 32)) < int(validation * (1 << 32))
    return rows.withColumn("part", F.when(low, "validation").otherwise("train"))


def write_training_set(windows: DataFrame, params: DataFrame, path: str, profile: str) -> None:
    """Windows (arrays) by part, and beside them the normalisation of each feature."""
    windows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/windows")
    params.withColumn("profile", F.lit(profile)).coalesce(1).write.mode("overwrite").json(f"{path}/params")


PARAMS = StructType([StructField("feature", StringType()), StructField("mean", DoubleType()), StructField("std", DoubleType()), StructField("profile", StringType())])


def read_training_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/windows"), spark.read.schema(PARAMS).json(f"{path}/params")


# fixed values: base, amplitude and trend a minute of each made-up metric, and the names of its states
SIGNALS = {
    "cpuUsageNanoCores": (2.0e8, 5.0e7, 0.0), "memoryUsageBytes": (5.0e8, 4.0e7, 1.0e5), "memoryWorkingSetBytes": (4.5e8, 3.5e7, 1.0e5), "memoryRssBytes": (4.0e8, 3.0e7, 0.0),
    "networkRxBytes": (1.0e6, 3.0e5, 0.0), "networkTxBytes": (8.0e5, 2.0e5, 0.0), "fsUsedBytes": (2.0e9, 1.0e7, 5.0e5), "kubeDeploymentStatusReplicasAvailable": (3.0, 0.0, 0.0),
}
STATES = ("podConditionPhase", "kubePodStatusReady", "kubePodContainerStatusRunning", "kubePodContainerStatusWaiting", "kubePodContainerStatusTerminated", "kubePodContainerStatusReady", "kubeNodeStatusConditionReady", "status")
RESTARTS = "kubePodContainerStatusRestartsTotal"


def sample_fleet(spark: SparkSession, resources: int = 5, minutes: int = 240, seed: int = 7, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """Canonical rows of a made-up fleet: hourly waves with noise and trend, states, restarts; the last resource's cpu and memory climb over the last three tenths. Nothing is made on the driver, and noise is a hash, so rows do not depend on partitions."""
    from pyspark.sql import Window

    unit = lambda *k: (F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    grid = spark.range(resources * minutes).select((F.col("id") / minutes).cast("long").alias("r"), (F.col("id") % minutes).alias("t"))
    grid = grid.withColumns({"resource_id": F.concat(F.lit("node-"), F.col("r").cast("string")), "failing": F.col("r") == resources - 1})
    bend = int(minutes * 0.7)
    climb = F.when(F.col("failing") & (F.col("t") >= bend), (F.col("t") - bend) / max(minutes - bend - 1, 1)).otherwise(0.0)

    def wave(name: str, base: float, amplitude: float, trend: float):
        noise = F.sqrt(-2 * F.ln(unit("r", "t", F.lit(name)))) * F.cos(2 * F.pi() * unit("r", "t", F.lit(name), F.lit("angle")))
        x = base + amplitude * F.sin(2 * F.pi() * F.col("t") / 60) + noise * (amplitude * 0.1) + trend * F.col("t")
        return F.greatest(F.lit(0.0), x + climb * (3 * amplitude) if name.startswith(("cpu", "memory")) else x)

    wide = grid.withColumns({n: wave(n, *s) for n, s in SIGNALS.items()})
    fell = (unit("r", "t", F.lit("restart")) < F.when(F.col("failing"), 0.06).otherwise(0.005)).cast("double")
    wide = wide.withColumn(RESTARTS, F.sum(fell).over(Window.partitionBy("r").orderBy("t")))
    ready = (F.col("cpuUsageNanoCores") < 4.0e8).cast("double")
    of = {"podConditionPhase": F.when(ready == 1, 2.0).otherwise(4.0), "kubePodContainerStatusWaiting": 1 - ready, "kubePodContainerStatusTerminated": F.lit(0.0), "kubeNodeStatusConditionReady": F.lit(1.0)}
    wide = wide.withColumns({n: of.get(n, ready) for n in STATES})
    names = [*SIGNALS, RESTARTS, *STATES]
    long = wide.select("resource_id", "t", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric_name", "value"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + 60 * F.col("t"))
    return long.select("resource_id", F.col("resource_id").alias("host_name"), "metric_name", at.alias("timestamp"), "value", F.concat("resource_id", F.lit("-inst")).alias("datasource_instance"), F.lit("Kubernetes_KSM_Pods").alias("datasource_name"))


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; numbers are above 0 (weights may be 0)."""

    data_uri: str | None = None
    model_path: str = "models/model.json"
    num_clusters: int = 5
    sequence_length: int = 30
    window_step: int = 10
    batch_size: int = 64
    latent_dim: int = 8
    learning_rate: float = 1e-3
    beta: float = 1.0
    lambda_cluster: float = 0.1
    lambda_balance: float = 0.0

    def __post_init__(self) -> None:
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, (int, float)) and (x < 0 or (x == 0 and not f.name.startswith(("beta", "lambda")))):
                raise ValueError(f"{f.name} must be above 0")

    @classmethod
    def load(cls, given: Mapping[str, str] | None = None, prefix: str = "BRIGHTWELL_") -> Settings:
        """From variables such as BRIGHTWELL_WINDOW_STEP, by default those of the environment; others are ignored."""
        given = os.environ if given is None else given
        kinds = {f.name: {"int": int, "float": float}.get(str(f.type), str) for f in fields(cls)}
        return cls(**{n: kind(given[prefix + n.upper()]) for n, kind in kinds.items() if prefix + n.upper() in given})


def dump_profile(profile, path: str) -> None:
    """A profile as JSON."""
    with open(path, "w") as f:
        json.dump({"name": profile.name, "numerical_features": profile.numerical, "categorical_features": profile.categorical, "description": profile.description}, f)
