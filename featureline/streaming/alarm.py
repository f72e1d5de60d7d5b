"""Minute metrics and M-of-N alarms on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampNTZType

from featureline.functions.exprs import utc_timestamp
from featureline.operators.alarms import AlarmRule

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "series string, minute_no long, value double, breaching boolean, breaches long, in_alarm boolean"


def minute_metrics(stream: DataFrame, series: Column, ts: Column, value: Column, statistic: str,
                   late: str) -> DataFrame:
    """One row per series and minute, sent when the watermark has passed the minute.

    Rows later than ``late`` are dropped; Spark counts them in the query progress.
    """
    total = {"avg": F.avg, "sum": F.sum}[statistic](F.col("_value"))
    rows = stream.select(series.cast("string").alias("series"), ts.alias("_ts"), value.cast("double").alias("_value"))
    if isinstance(rows.schema["_ts"].dataType, TimestampNTZType):
        rows = rows.withColumn("_ts", utc_timestamp(F.col("_ts")))
    return (rows.withWatermark("_ts", late).groupBy("series", F.window("_ts", "1 minute"))
            .agg(total.alias("value")).select("series", F.col("window.start").alias("minute"), "value"))


class _Alarm(StatefulProcessor):
    """Per series: the number of the last minute seen and the breaches of the last ``n`` minutes, as text of 0 and 1."""

    def __init__(self, rule: AlarmRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "last long, recent string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(rows)).set_index("minute_no")["value"].sort_index()
        last, recent = self.state.get() if self.state.exists() else (None, "")
        # Minutes without a point are filled from the minute after the last one seen.
        first = values.index[0] if last is None else last + 1
        dense = values.reindex(range(first, values.index[-1] + 1))
        breaching = (dense > self.rule.threshold) | (dense.isna() & self.rule.missing_breaches)
        flags = [c == "1" for c in recent] + breaching.tolist()
        history = pd.Series(flags, dtype="int64")
        breaches = history.rolling(self.rule.n, min_periods=1).sum().iloc[len(recent):]
        seen = pd.Series(range(1, len(history) + 1)).iloc[len(recent):]
        yield pd.DataFrame({
            "series": key[0], "minute_no": dense.index, "value": dense.to_numpy(), "breaching": breaching.to_numpy(),
            "breaches": breaches.astype("int64").to_numpy(),
            "in_alarm": ((seen >= self.rule.n) & (breaches >= self.rule.m)).to_numpy(),
        })
        self.state.update((int(dense.index[-1]), "".join("1" if f else "0" for f in flags[-self.rule.n:])))

    def close(self) -> None:
        pass


def alarm_stream(points: DataFrame, rule: AlarmRule) -> DataFrame:
    """Dense minutes with alarm state; the state holds ``n`` flags per series."""
    # Whole minutes since 1970: no time zone reaches the Python side.
    numbered = points.select("series", (F.unix_seconds("minute") / 60).cast("long").alias("minute_no"), "value")
    states = numbered.groupBy("series").transformWithStateInPandas(
        _Alarm(rule), outputStructType=OUTPUT, outputMode="append", timeMode="none")
    return states.select("series", F.timestamp_seconds(F.col("minute_no") * 60).alias("minute"), "value", "breaching",
                         "breaches", "in_alarm")


def start_alarm_stream(alarms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes alarm rows as Parquet, takes in all that is there and stops."""
    conf = alarms.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        return (alarms.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(STATE_STORE, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows (pre-aggregated per task) that came after the watermark and were dropped, over the kept progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])
