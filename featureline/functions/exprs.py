"""Column expressions shared by the jobs. No Python UDF."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, TimestampNTZType

ISO_SECONDS = "yyyyMMdd'T'HHmmss'Z'"
DAY = "yyyy-MM-dd"


def non_empty_items(text: Column) -> Column:
    """Split on commas, strip blanks, drop empty items."""
    stripped = F.transform(F.split(text, ","), lambda item: F.trim(item))
    return F.filter(stripped, lambda item: item != "")


def join_items(items: Column) -> Column:
    return F.array_join(items, ",")


def padded_key(prefix: str, number: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def utc_timestamp(ts: Column) -> Column:
    """Zone-less time taken as UTC, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp")


def wall_clock(ts: Column) -> Column:
    """The zone-less UTC reading of a timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def ts_literal(ts: datetime | str | int, like: DataType) -> Column:
    """A constant of the column's own timestamp type, so that filters on it reach the scan.

    A whole number stands for microseconds since 1970 in UTC.
    """
    zoneless = isinstance(like, TimestampNTZType)
    if isinstance(ts, int):
        return wall_clock(F.timestamp_micros(F.lit(ts))) if zoneless else F.timestamp_micros(F.lit(ts))
    return F.lit(utc_text(ts, like)).cast("timestamp_ntz" if zoneless else "timestamp")


def utc_text(ts: datetime | str, like: DataType) -> str:
    """A time as text: in UTC and with its zone, or without one for zone-less columns. Times without a zone are UTC."""
    if isinstance(ts, str):
        try:
            ts = datetime.fromisoformat(ts.strip())
        except ValueError:
            return ts  # a form only Spark knows
    ts = ts.replace(tzinfo=timezone.utc) if ts.tzinfo is None else ts.astimezone(timezone.utc)
    return (ts.replace(tzinfo=None) if isinstance(like, TimestampNTZType) else ts).isoformat(sep=" ")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC, text that is not a time becomes null."""
    zoned = F.regexp_like(F.trim(text), F.lit(r"(?i)[0-9:](z|[+-][0-9]{1,2}(:?[0-9]{2}){0,2}|[ ]?(utc|gmt|[a-z]+/[a-z_]+).*)$")) \
        & F.regexp_like(F.trim(text), F.lit("^[^T ]+[T ]"))
    return F.when(zoned, text.try_cast("timestamp")).otherwise(utc_timestamp(text.try_cast("timestamp_ntz")))


def partition_date(ts: Column, dtype: DataType, grain: str = "day") -> Column:
    """The first day of the time's day, week, month ... in UTC, whatever the session zone is."""
    utc = ts if isinstance(dtype, TimestampNTZType) else wall_clock(ts)
    return F.to_date(F.date_trunc(grain, utc.cast("timestamp_ntz")))


def exact_time(ts: Column, dtype: DataType) -> Column:
    """A time in the form ``ts_literal`` takes without loss: text without a zone, or microseconds in UTC."""
    return ts.cast("string") if isinstance(dtype, TimestampNTZType) else F.unix_micros(ts)


def minus(ts: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    days, hours = (x if isinstance(x, Column) else F.lit(x) for x in (days, hours))
    return ts - F.make_dt_interval(days.cast("int"), hours.cast("int"))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` between low and high; null and NaN stay what they are."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), x))
    return F.when(x.isNull() | F.isnan(x.cast("double")), x).otherwise(inside)


def is_missing(column: str, dtype: DataType) -> Column:
    """Null, or NaN where the type has it."""
    col = F.col(column)
    return col.isNull() | F.isnan(col) if isinstance(dtype, (DoubleType, FloatType)) else col.isNull()


def as_float(x: Column) -> Column:
    return x.cast("double")


def strip_trailing_slashes(uri: Column) -> Column:
    return F.rtrim(uri, F.lit("/"))


def uri_bucket(uri: Column, scheme: str = "s3://") -> Column:
    """The part between scheme and first slash; null when the scheme differs."""
    rest = F.substring(uri, F.lit(len(scheme) + 1), F.length(uri))
    return F.when(F.startswith(uri, F.lit(scheme)), F.substring_index(rest, "/", 1))


def uri_key(uri: Column, scheme: str = "s3://") -> Column:
    """Everything after the first slash behind the bucket, empty text when there is none."""
    rest = F.substring(uri, F.lit(len(scheme) + 1), F.length(uri))
    bucket = F.substring_index(rest, "/", 1)
    return F.when(F.startswith(uri, F.lit(scheme)),
                  F.substring(rest, F.length(bucket) + 2, F.length(rest)))


def champion_uri(name: Column, alias: Column | str = "champion") -> Column:
    alias = alias if isinstance(alias, Column) else F.lit(alias)
    return F.format_string("models:/%s@%s", name, alias)


def uniform(seed: int, row_key: Column, name: str) -> Column:
    """A number in [0, 1) that depends only on seed, row key and name, not on partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_key.cast("string"), F.lit(name)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def uniform_int(seed: int, row_key: Column, name: str, low: int, high: int) -> Column:
    """An integer in [low, high)."""
    return F.floor(uniform(seed, row_key, name) * (high - low)).cast("long") + low


def churn_probability(balance: Column, inactive_days: Column) -> Column:
    """Fixed weights: base 0.2, inactivity 0.5 over 365 days, balance -0.3 over 50000; clipped to [0.05, 0.95]."""
    return clip(F.lit(0.2) + F.lit(0.5) * (inactive_days / F.lit(365.0)) - F.lit(0.3) * (balance / F.lit(50000.0)),
                0.05, 0.95)
