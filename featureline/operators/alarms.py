"""Metric series per interval and M-of-N alarms over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampNTZType


@dataclass(frozen=True)
class AlarmRule:
    """Alarm when at least ``m`` of the last ``n`` points lie above ``threshold``."""

    statistic: str  # "avg" or "sum"
    threshold: float
    n: int = 5
    m: int = 5
    missing_breaches: bool = True


# Fixed rules: utilisation above 80 % in 5 of 5 minutes, missing points count as breaches;
# any throttle or error in a minute, missing points do not.
UTILISATION = AlarmRule("avg", 80.0, 5, 5, True)
THROTTLES = AlarmRule("sum", 0.0, 1, 1, False)


def metric_points(df: DataFrame, series: Sequence[str], ts_col: str, value: Column, statistic: str,
                  unit: str = "minute") -> DataFrame:
    """One point per series and interval that has data."""
    start = F.date_trunc(unit, F.col(ts_col))
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        start = start.cast("timestamp_ntz")
    total = {"avg": F.avg, "sum": F.sum}[statistic](value.cast("double"))
    return df.groupBy(*series, start.alias("minute")).agg(total.alias("value"))


def dense_points(points: DataFrame, series: Sequence[str], unit: str = "minute", until: Column | None = None) -> DataFrame:
    """Every interval from a series' first to its last point, or on to ``until``; ``value`` is null where there was none.

    The gaps are filled behind each point from the point before it, so the work is spread like
    the points are and no time table is joined.
    """
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    order = Window.partitionBy(*series).orderBy("minute")
    gap_start = F.coalesce(F.lag("minute").over(order) + step, F.col("minute"))
    filled = points.withColumn("_from", gap_start).withColumn(
        "_at", F.explode(F.sequence(F.col("_from"), F.col("minute"), step)))
    value = F.when(F.col("_at") == F.col("minute"), F.col("value"))
    if until is not None:  # a series that went silent has no point that its gap could be filled from
        end = F.date_trunc(unit, until).cast(points.schema["minute"].dataType)
        last = points.groupBy(*series).agg(F.max("minute").alias("_last")).filter(F.col("_last") < end)
        silent = last.select(*series, F.explode(F.sequence(F.col("_last") + step, end, step)).alias("minute"))
        return filled.select(*series, F.col("_at").alias("minute"), value.alias("value")).unionByName(
            silent.withColumn("value", F.lit(None).cast(points.schema["value"].dataType)))
    return filled.select(*series, F.col("_at").alias("minute"), value.alias("value"))


def alarm_states(points: DataFrame, series: Sequence[str], rule: AlarmRule, unit: str = "minute",
                 until: Column | None = None) -> DataFrame:
    """Dense points with ``breaching``, the number of breaches in the last ``n`` and ``in_alarm``.

    ``until`` is the time up to which a series should have points (the time of the check): without it, a series that has stopped is
    judged up to its own last point only.

    A series holds one row per interval whatever the raw volume; before ``n`` points there is no alarm.
    """
    dense = dense_points(points, series, unit, until)
    breach = F.coalesce(F.col("value") > rule.threshold, F.lit(rule.missing_breaches))
    frame = Window.partitionBy(*series).orderBy("minute").rowsBetween(-(rule.n - 1), 0)
    return dense.withColumn("breaching", breach).withColumns({
        "breaches": F.sum(F.col("breaching").cast("int")).over(frame),
        "_seen": F.count(F.lit(1)).over(frame),
    }).withColumn("in_alarm", (F.col("_seen") >= rule.n) & (F.col("breaches") >= rule.m)).drop("_seen")


def dashboard(df: DataFrame, ts_col: str, widgets: dict[str, tuple[Column, Column, str]],
              unit: str = "minute") -> DataFrame:
    """Tidy series for a dashboard: ``name -> (filter, value, statistic)``, one pass over the input."""
    start = F.date_trunc(unit, F.col(ts_col))
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        start = start.cast("timestamp_ntz")
    matching = F.array_compact(F.array(*[
        F.when(keep, F.struct(F.lit(name).alias("series"), F.lit(stat).alias("statistic"),
                              value.cast("double").alias("value")))
        for name, (keep, value, stat) in widgets.items()
    ]))
    tidy = df.select(start.alias("minute"), F.inline(matching))
    return tidy.groupBy("series", "statistic", "minute").agg(
        F.avg("value").alias("_avg"), F.sum("value").alias("_sum")
    ).select("series", "minute", F.when(F.col("statistic") == "avg", F.col("_avg"))
             .otherwise(F.col("_sum")).alias("value"))
