import random
from datetime import datetime, timedelta

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F, types as T

from featureline.operators.alarms import THROTTLES, UTILISATION, AlarmRule, alarm_states, dashboard, dense_points, metric_points
from featureline.operators.logs import count_by, parse_lines
from featureline.schema import CUSTOMER, FeatureView
from featureline.sources.online import OnlineTable
from featureline.streaming.alarm import alarm_stream, late_rows, minute_metrics, start_alarm_stream
from featureline.streaming.materialize import feature_stream, materialize_stream

VIEW = FeatureView("v", (CUSTOMER,), T.StructType([T.StructField("a", T.LongType())]), ts_type=T.TimestampNTZType())
START = datetime(2024, 1, 1)


def feature_table(spark):
    rng = random.Random(4)
    data = [(f"k{rng.randrange(30)}", START + timedelta(minutes=rng.randrange(5000)), i) for i in range(400)]
    return spark.createDataFrame(data, "entity_id string, event_timestamp timestamp_ntz, a long")


@pytest.mark.parametrize("order", ["event_timestamp", "a"])
def test_stream_equals_batch_for_any_file_order(spark, folder, order):
    table = feature_table(spark)
    table.repartitionByRange(6, order).write.parquet(f"{folder}/in")
    batch = OnlineTable(spark, f"{folder}/batch", VIEW).materialize_incremental(table, "2030-01-01 00:00:00")
    online = OnlineTable(spark, f"{folder}/stream", VIEW)
    query = materialize_stream(feature_stream(spark, VIEW, f"{folder}/in", 2), online, f"{folder}/cp")
    query.awaitTermination()
    assert rows(online.read()) == rows(batch)


def test_stream_goes_on_where_it_ended(spark, folder):
    online = OnlineTable(spark, f"{folder}/online", VIEW)
    for batch in ([("a", ts("2024-01-02"), 2)], [("a", ts("2024-01-01"), 1), ("b", ts("2024-01-03"), 3)]):
        spark.createDataFrame(batch, "entity_id string, event_timestamp timestamp_ntz, a long") \
            .write.mode("append").parquet(f"{folder}/in")
        materialize_stream(feature_stream(spark, VIEW, f"{folder}/in"), online, f"{folder}/cp").awaitTermination()
    assert rows(online.read(), "entity_id", "a") == [("a", 2), ("b", 3)]


def points(spark, data):
    return spark.createDataFrame([(s, START + timedelta(minutes=m), v) for s, m, v in data],
                                 "series string, minute timestamp_ntz, value double")


def states(df):
    return {(r["series"], (r["minute"] - START) // timedelta(minutes=1)): (r["breaching"], r["breaches"], r["in_alarm"])
            for r in df.collect()}


def test_five_of_five(spark):
    out = states(alarm_states(points(spark, [("c", m, 81.0 if m < 6 else 80.0) for m in range(8)]), ["series"], UTILISATION))
    assert [out["c", m][2] for m in range(8)] == [False, False, False, False, True, True, False, False]


def test_missing_minutes_follow_the_rule(spark):
    data = [("c", 0, 90.0), ("c", 4, 90.0), ("c", 5, 10.0)]
    out = states(alarm_states(points(spark, data), ["series"], UTILISATION))
    assert out["c", 4] == (True, 5, True) and out["c", 5][2] is False
    out = states(alarm_states(points(spark, data), ["series"], AlarmRule("avg", 80.0, 5, 5, False)))
    assert out["c", 4] == (True, 2, False)


def test_throttles_alarm_at_once(spark):
    out = states(alarm_states(points(spark, [("t", 0, 0.0), ("t", 2, 1.0)]), ["series"], THROTTLES))
    assert [out["t", m][2] for m in range(3)] == [False, False, True]


def test_dense_points_fill_only_inside_a_series(spark):
    out = dense_points(points(spark, [("a", 0, 1.0), ("a", 3, 2.0), ("b", 7, 3.0)]), ["series"])
    got = {(r["series"], (r["minute"] - START).seconds // 60): r["value"] for r in out.collect()}
    assert got == {("a", 0): 1.0, ("a", 1): None, ("a", 2): None, ("a", 3): 2.0, ("b", 7): 3.0}
    assert out.count() == 5


def test_dashboard_widgets(spark):
    df = spark.createDataFrame([("cpu", START, 10.0), ("cpu", START, 20.0), ("err", START, 1.0)],
                               "kind string, t timestamp_ntz, v double")
    out = dashboard(df, "t", {"cpu": (F.col("kind") == "cpu", F.col("v"), "avg"),
                              "all": (F.lit(True), F.lit(1), "sum")})
    assert rows(out, "series", "value") == [("all", 3.0), ("cpu", 15.0)]


@pytest.mark.parametrize("missing", [True, False])
def test_stream_alarm_equals_batch_for_shuffled_input(spark, folder, missing):
    """Rows of a minute and neighbouring minutes come in different files, all inside the watermark."""
    rng = random.Random(8)
    data = [(f"s{rng.randrange(3)}", START + timedelta(seconds=rng.randrange(7200)), float(rng.randrange(100)))
            for _ in range(300)]
    data.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(900)))
    rule = AlarmRule("avg", 50.0, 4, 3, missing)
    schema = "series string, t timestamp_ntz, v double"
    for i in range(3):
        spark.createDataFrame(data[i * 100:(i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    # A last file far ahead closes all minutes.
    end = spark.createDataFrame([("end", START + timedelta(days=1), 0.0)], schema)
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end_more = spark.createDataFrame([("end", START + timedelta(days=2), 0.0)], schema)
    end_more.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    stream = (spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{folder}/in"))
    metrics = minute_metrics(stream, F.col("series"), F.col("t"), F.col("v"), rule.statistic, "30 minutes")
    query = start_alarm_stream(alarm_stream(metrics, rule), f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    assert late_rows(query) == 0
    got = states(spark.read.parquet(f"{folder}/out").filter("series != 'end'"))
    batch = metric_points(spark.createDataFrame(data, schema), ["series"], "t", F.col("v"), "avg")
    assert got == states(alarm_states(batch, ["series"], rule))


def test_log_lines(spark):
    lines = ['{"timestamp": "2026-01-15T12:00:00+00:00", "level": "ERROR", "logger": "job", "message": "failed", '
             '"module": "run", "line": 7, "run_id": "r1", "n": 3, "exception": ["a", "b"]}',
             '{"timestamp": "2026-01-15T12:00:01Z", "level": "INFO", "message": "ok", "run_id": "r1"}',
             "plain text", '{"level": "INFO", "message": "cut', ""]
    logs = parse_lines(spark.createDataFrame([(x,) for x in lines], "raw string")).cache()
    assert [r["malformed"] for r in logs.collect()] == [False, False, True, True, True]
    first = logs.first()
    assert first["timestamp"] == datetime(2026, 1, 15, 12) and first["line"] == 7 and first["level"] == "ERROR"
    assert first["extra"] == {"run_id": "r1", "n": "3", "exception": '["a","b"]'}
    assert rows(count_by(logs, "level", "run_id")) == [("ERROR", "r1", 1), ("INFO", "r1", 1), (None, None, 3)]


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, folder):
    schema = "series string, t timestamp_ntz, v double"
    for i, (minute, value) in enumerate([(0, 1.0), (600, 2.0), (601, 2.0), (1, 99.0), (1200, 3.0), (1800, 4.0)]):
        spark.createDataFrame([("a", START + timedelta(minutes=minute), value)], schema).coalesce(1) \
            .write.parquet(f"{folder}/in/part={i}")
    stream = (spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    metrics = minute_metrics(stream, F.col("series"), F.col("t"), F.col("v"), "sum", "10 minutes")
    query = start_alarm_stream(alarm_stream(metrics, THROTTLES), f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    assert late_rows(query) == 1
    got = {(r["minute"] - START) // timedelta(minutes=1): r["value"] for r in
           spark.read.parquet(f"{folder}/out").filter("value is not null").collect()}
    assert got == {0: 1.0, 600: 2.0, 601: 2.0, 1200: 3.0}
