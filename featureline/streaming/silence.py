"""Alarms on a stream that also hear silence: event-time timers judge a series' missing minutes as the watermark passes them.

A minute is final when the watermark has passed its end. A series is judged up to there in every micro-batch, with or without new
rows of its own: a timer stands at the end of its next minute. After ``forget`` without a point a series ends and its state
goes. Missing minutes leave in frames of bounded size. Rows behind the watermark are counted per micro-batch in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampNTZType

from featureline.functions.exprs import utc_timestamp
from featureline.operators.alarms import AlarmRule
from featureline.streaming.alarm import OUTPUT, start_alarm_stream

MINUTE = 60_000
#: Minutes in one frame.
FRAME = 10_000
LATE = "batch_id long, watermark string, n_late long"


class _Silence(StatefulProcessor):
    """Per series: the last judged minute, the last one with a point, and the breaches of the last ``n`` minutes as text of 0 and 1."""

    def __init__(self, rule: AlarmRule, forget: int | None):
        self.rule, self.forget = rule, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recent", "judged long, heard long, recent string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(list(rows))
        yield from self._judge(key, dict(zip(points["minute_no"].tolist(), points["value"].tolist())), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._judge(key, {}, timerValues)

    def _judge(self, key, points: dict, timerValues) -> Iterator[pd.DataFrame]:
        judged, heard, recent = self.state.get() if self.state.exists() else (None, None, "")
        first = min(points) if judged is None else judged + 1
        heard = max([x for x in (heard, *points) if x is not None])
        final = timerValues.getCurrentWatermarkInMs() // MINUTE - 1  # the last minute that has ended
        last = max([final, *points])
        forgotten = self.forget is not None and last > heard + self.forget
        if forgotten:
            last = max(heard + self.forget, first - 1)
        flags = np.array([c == "1" for c in recent], bool)
        for a in range(first, last + 1, FRAME):
            minutes = np.arange(a, min(a + FRAME, last + 1))
            value = np.array([points.get(m, np.nan) for m in minutes.tolist()], float) if points else np.full(len(minutes), np.nan)
            with np.errstate(invalid="ignore"):
                breaching = np.where(np.isnan(value), self.rule.missing_breaches, value > self.rule.threshold)
            flags = np.concatenate([flags, breaching])
            total = np.concatenate([[0], np.cumsum(flags)])
            at = np.arange(len(flags) - len(minutes), len(flags)) + 1
            breaches = total[at] - total[np.maximum(at - self.rule.n, 0)]
            yield pd.DataFrame({"series": key[0], "minute_no": minutes, "value": value, "breaching": breaching, "breaches": breaches,
                                "in_alarm": (at >= self.rule.n) & (breaches >= self.rule.m)})
            flags = flags[-self.rule.n:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if forgotten:
            self.state.clear()
            return
        judged = max(last, first - 1)
        self.state.update((int(judged), int(heard), "".join("1" if f else "0" for f in flags[-self.rule.n:])))
        self.handle.registerTimer(int(judged + 2) * MINUTE)  # the end of the next minute

    def close(self) -> None:
        pass


def silence_alarms(stream: DataFrame, series: Column, ts: Column, value: Column, rule: AlarmRule, late: str,
                   forget: timedelta | None = None) -> DataFrame:
    """Dense minutes of every series with alarm state, up to the watermark. The state holds ``n`` flags per series."""
    total = {"avg": F.avg, "sum": F.sum}[rule.statistic](F.col("_value"))
    rows = stream.select(series.cast("string").alias("series"), ts.alias("_ts"), value.cast("double").alias("_value"))
    if isinstance(rows.schema["_ts"].dataType, TimestampNTZType):
        rows = rows.withColumn("_ts", utc_timestamp(F.col("_ts")))
    points = rows.withWatermark("_ts", late).groupBy("series", F.window("_ts", "1 minute")).agg(total.alias("value")) \
        .select("series", F.window_time("window").alias("event_time"), (F.unix_seconds("window.start") / 60).cast("long").alias("minute_no"), "value")
    states = points.groupBy("series").transformWithStateInPandas(
        _Silence(rule, forget and int(forget / timedelta(minutes=1))), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
    return states.select("series", F.timestamp_seconds(F.col("minute_no") * 60).alias("minute"), "value", "breaching", "breaches", "in_alarm")


def run_silence_alarms(alarms: DataFrame, path: str, checkpoint: str, late_path: str | None = None) -> StreamingQuery:
    """Takes in all that is there and stops; then the counts of late rows, if ``late_path`` is given, are written."""
    spark = alarms.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10000")
    query = start_alarm_stream(alarms, path, checkpoint)
    query.awaitTermination()
    if late_path:
        write_late_counts(spark, query, late_path)
    return query


def write_late_counts(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """One folder per micro-batch that dropped rows behind the watermark (rows summed up by series and minute in a task count as one);
    a batch that comes again replaces its folder."""
    for report in query.recentProgress:
        n = sum(op["numRowsDroppedByWatermark"] for op in report["stateOperators"])
        if n:
            row = [(report["batchId"], report["eventTime"].get("watermark"), n)]
            spark.createDataFrame(row, LATE).write.mode("overwrite").parquet(f"{path}/batch={report['batchId']}")
