"""Streams of metrics and of scores: windowed rollups, latest windows, alarm runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brightwell.functions import severity_of_ratio

RUN = "resource_id string, run_start timestamp, length long, seen timestamp, alarming boolean"
LATEST = "resource_id string, end_time timestamp, x array<double>"


LATE_INTERVALS = 4


def lateness(interval_seconds: float, intervals: int = LATE_INTERVALS) -> str:
    """The watermark that lets a series be as late as it may be behind and still be live."""
    return f"{max(1, round(interval_seconds * intervals))} seconds"


def rollup(metrics: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by metric: max, sum, mean. Rows later than `late` are dropped by the watermark."""
    per = metrics.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "metric_name")
    return per.agg(F.max("value").alias("max_value"), F.sum("value").alias("sum_value"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("start"), "metric_name", "max_value", "sum_value", "avg_value")


def alarm_runs(scores: DataFrame, sustain: int = 3, idle: str | None = None) -> DataFrame:
    """The run state of each resource after every batch: scores are resource_id, end_time, flag.

    State is the start and length of the current run and the last time seen; windows that come before that time are late and ignored."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, length, seen = state.get if state.exists else (None, 0, None)
        for b in batches:
            for r in b.sort_values("end_time", kind="stable").itertuples():
                at = r.end_time.value
                if seen is not None and at <= seen:
                    continue
                seen = at
                start, length = (at if length == 0 else start, length + 1) if r.flag else (None, 0)
        state.update((start, length, seen))
        yield pd.DataFrame({"resource_id": [key[0]], "run_start": [pd.Timestamp(start) if start is not None else pd.NaT], "length": [length], "seen": [pd.Timestamp(seen) if seen is not None else pd.NaT], "alarming": [length >= sustain]})

    return scores.groupBy("resource_id").applyInPandasWithState(step, RUN, "start long, length long, seen long", "update", GroupStateTimeout.NoTimeout)


def _keep_last(state: GroupState, batches: Iterator[pd.DataFrame], names: list[str], size: int) -> tuple[list[int], dict[int, list[float]]]:
    """The last `size` times that a resource has had, and their rows; kept as its state."""
    have = {t: v for t, v in zip(*state.get, strict=True)} if state.exists else {}
    for b in batches:
        for r in b.itertuples():
            have[r.timestamp.value] = [float("nan") if pd.isna(v) else float(v) for v in (getattr(r, n) for n in names)]
    kept = sorted(have)[-size:]
    state.update((kept, [have[t] for t in kept]))
    return kept, have


STATE = "times array<long>, rows array<array<double>>"


def latest_windows(wide: DataFrame, names: list[str], size: int) -> DataFrame:
    """The last `size` distinct times of each resource after every batch, flattened by time; only resources that have as many. State is bounded by size."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, have = _keep_last(state, batches, names, size)
        if len(kept) == size:
            yield pd.DataFrame({"resource_id": [key[0]], "end_time": [pd.Timestamp(kept[-1])], "x": [[v for t in kept for v in have[t]]]})

    return wide.select("resource_id", "timestamp", *names).groupBy("resource_id").applyInPandasWithState(step, LATEST, STATE, "update", GroupStateTimeout.NoTimeout)


def scored_windows(wide: DataFrame, names: list[str], size: int, load: Callable[[], Callable], threshold: float) -> DataFrame:
    """Latest windows with their score after every batch: load() gives a function from (windows, steps, features) to errors, once a task; missing values are 0 there, the mean of normalised features."""
    loaded: list[Callable] = []

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, have = _keep_last(state, batches, names, size)
        if len(kept) == size:
            if not loaded:
                loaded.append(load())
            error = float(loaded[0](np.nan_to_num(np.array([[have[t] for t in kept]])))[0])
            yield pd.DataFrame({"resource_id": [key[0]], "end_time": [pd.Timestamp(kept[-1])], "error": [error]})

    scored = wide.select("resource_id", "timestamp", *names).groupBy("resource_id").applyInPandasWithState(step, "resource_id string, end_time timestamp, error double", STATE, "update", GroupStateTimeout.NoTimeout)
    ratio = F.col("error") / F.lit(float(threshold))
    return scored.withColumns({"ratio": ratio, "is_anomaly": ratio > 1, "severity": severity_of_ratio(ratio)})


TICKED = "resource_id string, tick timestamp, end_time timestamp, error double"


def on_cadence(scores: DataFrame, seconds: int = 600) -> DataFrame:
    """What a poll on a wall-clock lattice serves: at each tick the last window that has ended, once. scores: resource_id, end_time, error.

    A window is served when a later window of its resource shows that its tick came first, or when its own tick has passed in the times seen; state is the last window and the last tick served."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, error, served = state.get if state.exists else (None, None, None)
        width, out = seconds * 1_000_000_000, []
        rows = pd.concat(list(batches)).sort_values("end_time", kind="stable")
        for r in rows.itertuples():
            at = r.end_time.value
            if end is not None and at <= end:
                continue
            if end is not None:
                tick = -(-end // width) * width
                if tick < at and (served is None or tick > served):
                    out.append((key[0], pd.Timestamp(tick), pd.Timestamp(end), error))
                    served = tick
            end, error = at, float(r.error)
        state.update((end, error, served))
        yield pd.DataFrame(out, columns=["resource_id", "tick", "end_time", "error"])

    return scores.select("resource_id", "end_time", "error").groupBy("resource_id").applyInPandasWithState(step, TICKED, "end long, error double, served long", "append", GroupStateTimeout.NoTimeout)


TRACKED = "horizon string, n long, picp double, mpiw double, mae double, mase double"


def accuracy(observations: DataFrame, history: int = 500) -> DataFrame:
    """Accuracy of each horizon over its last `history` observations after every batch. observations: horizon, ordinal, actual, median, lower, upper. State holds no more than that."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = [list(x) for x in state.get[0]] if state.exists else []
        new = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
        have = (have + new[["actual", "median", "lower", "upper"]].astype(float).to_numpy().tolist())[-history:]
        state.update(([*have],))
        a, m, low, high = np.array(have).T
        naive = float(np.abs(np.diff(a)).mean()) if len(a) > 1 else 0.0
        mae = float(np.abs(a - m).mean())
        yield pd.DataFrame({"horizon": [key[0]], "n": [len(a)], "picp": [float(((a >= low) & (a <= high)).mean())], "mpiw": [float((high - low).mean())], "mae": [mae], "mase": [mae / naive if naive >= 1e-10 else None]})

    return observations.select("horizon", "ordinal", "actual", "median", "lower", "upper").groupBy("horizon").applyInPandasWithState(step, TRACKED, "rows array<array<double>>", "update", GroupStateTimeout.NoTimeout)


CHANGED = "stream string, n long, has_drift boolean, change_point_ordinal long, score double"


def change_points(errors: DataFrame, side: int = 30, delta: float = 0.01, history: int = 500) -> DataFrame:
    """Drift of each error stream (stream, ordinal, error) over its last `history` errors after every batch: the ordinal of the split whose means before and from it differ most, if they do. State holds no more than that."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, have = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
        seen, have = (seen + new.ordinal.astype(int).tolist())[-history:], (have + new.error.astype(float).tolist())[-history:]
        state.update((seen, have))
        e, best, split = np.array(have), 0.0, None
        splits = np.arange(side, len(e) - side)
        if len(splits):
            part = np.lib.stride_tricks.sliding_window_view(e, side)
            mean, spread = part.mean(1), part.var(1)
            score = np.abs(mean[splits] - mean[splits - side]) / np.sqrt(((spread[splits] + spread[splits - side]) / 2 + 1e-10) * 2 / side)
            if score.max() > 0:
                best, split = float(score.max()), int(splits[score.argmax()])
        drift = split is not None and best > -np.log(delta)
        yield pd.DataFrame({"stream": [key[0]], "n": [len(e)], "has_drift": [bool(drift)], "change_point_ordinal": pd.array([seen[split] if drift else None], "Int64"), "score": [best if len(e) >= 2 * side else None]})

    return errors.select("stream", "ordinal", "error").groupBy("stream").applyInPandasWithState(step, CHANGED, "seen array<long>, errors array<double>", "update", GroupStateTimeout.NoTimeout)
