"""Column functions that the operators share."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, whose size the planner knows: no task makes it, and joins with it need no shuffle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds))


def number(column: Column) -> Column:
    """A double, or null where the text is no number; NaN counts as missing."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def moment(column: Column) -> Column:
    """A UTC timestamp from a timestamp or an ISO 8601 text, null where it is neither."""
    return column.try_cast("timestamp")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def severity_of_ratio(ratio: Column) -> Column:
    """Alarm level of error / threshold: 1 up to 1, 2 up to 1.5, 3 up to 2, 4 above."""
    return F.when(ratio > 2, 4).when(ratio > 1.5, 3).when(ratio > 1, 2).otherwise(1)


def severity_of_violation(score: Column) -> Column:
    """Band of a normalised interval violation; no violation is low too."""
    return F.when(score >= 2, "critical").when(score >= 1, "high").when(score >= 0.5, "medium").otherwise("low")


def last_or_padded(values: Column, n: int) -> Column:
    """The last n values of an array, zeros in front where it has fewer."""
    kept = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.least(F.size(values), F.lit(n)))
    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(values), F.lit(0))), kept)


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_time(text: str, now: datetime) -> datetime:
    """`now`, an age such as 7d or 90m, or an ISO 8601 time with an offset."""
    if text == "now":
        return now
    if m := re.fullmatch(r"(\d+)([smhdw])", text):
        return now - timedelta(seconds=int(m[1]) * UNITS[m[2]])
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
