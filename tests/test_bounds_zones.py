"""Results that must not follow a setting, a partitioning, a session zone or a table's size."""

from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F, types as T

from featureline.functions.exprs import churn_probability, clip, parse_iso
from featureline.operators.alarms import AlarmRule, alarm_states
from featureline.operators.asof import historical_features
from featureline.operators.metrics import roc_auc
from featureline.operators.model import ForestConfig, fit_forest, predict
from featureline.operators.quality import apply_missing_policy, completeness
from featureline.operators.split import stratified_split
from featureline.schema import CUSTOMER, FeatureView
from featureline.sources.online import OnlineTable
from featureline.sources.tables import read_view, write_features

VIEW = FeatureView("v", (CUSTOMER,), T.StructType([T.StructField("a", T.LongType())]), ttl=timedelta(days=10), date_column="event_date")
ROWS = "entity_id string, event_timestamp timestamp, a long"


@pytest.fixture(params=["America/Los_Angeles", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.mark.parametrize("later", [1, 4, 64])
def test_online_table_reopened_with_another_bound(spark, folder, later):
    view = replace(VIEW, date_column=None)
    first = OnlineTable(spark, folder, view, full_every=16)
    for k in range(6):
        first.merge(spark.createDataFrame([(f"k{k}", utc("2024-01-01"), k)], ROWS), f"r{k}")
    again = OnlineTable(spark, folder, view, full_every=later)
    assert again.read().count() == 6
    again.merge(spark.createDataFrame([("k0", utc("2024-01-02"), 10)], ROWS), "r9")
    assert sorted(r.a for r in first.read().collect()) == [1, 2, 3, 4, 5, 10]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_date_folders_under_any_zone(spark, folder, zone, grain):
    features = spark.createDataFrame([("x", utc("2024-01-20 02:00"), 1), ("y", utc("2024-01-31 23:30"), 2)], ROWS)
    write_features(features, f"{folder}/f", grain=grain)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    view = replace(VIEW, date_grain=grain)
    table = read_view(spark, view, f"{folder}/f")
    spine = spark.createDataFrame([("x", utc("2024-01-25")), ("y", utc("2024-02-01"))], "entity_id string, event_timestamp timestamp")
    out = historical_features(spine, "v:a", (view,), {"v": table})
    assert rows(out, "entity_id", "a") == [("x", 1), ("y", 2)]


def test_online_end_keeps_its_offset(spark, folder, zone):
    view = replace(VIEW, date_column=None)
    table = spark.createDataFrame([("x", utc("2024-01-01 08:00"), 1), ("y", utc("2024-01-01 13:00"), 2)], ROWS)
    end = datetime(2024, 1, 1, 14, tzinfo=timezone(timedelta(hours=5)))  # 09:00 in UTC
    out = OnlineTable(spark, folder, view).materialize_incremental(table, end)
    assert [r.entity_id for r in out.collect()] == ["x"]


@pytest.mark.parametrize("text, want", [
    ("2026-01-15T00:00:00", "2026-01-15T00:00:00"), ("2026-01-15", "2026-01-15T00:00:00"), ("2026-01-15 06:30:00", "2026-01-15T06:30:00"),
    ("2026-01-15T12:00:00Z", "2026-01-15T12:00:00"), ("2026-01-15T12:00:00+02:00", "2026-01-15T10:00:00"),
    ("2026-01-15T12:00:00-0130", "2026-01-15T13:30:00"), ("not-a-date", None), ("", None)])
def test_iso_text_without_a_zone_is_utc(spark, zone, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.unix_seconds(parse_iso(F.col("t")))).first()[0]
    assert got == (int(utc(want).timestamp()) if want else None)


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (400.0, None), (0.0, 0.0)], "x double, y double")
    out = [tuple(r) for r in df.select(clip(F.col("x"), 0.0, 1.0), churn_probability(F.col("y"), F.col("x"))).collect()]
    assert out[0] == (None, None) and out[2] == (1.0, None) and out[3] == (0.0, 0.2)
    assert out[1][0] != out[1][0] and out[1][1] != out[1][1]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, y int")
    one = completeness(df, ["x", "y"]).first()
    assert (one["x_nulls"], one["y_nulls"], one["complete"]) == (2, 0, False)
    assert apply_missing_policy(df, ["x", "y"], "drop").count() == 1


def test_auc_with_infinite_and_nan_scores(spark):
    inf, nan = float("inf"), float("nan")
    data = [(True, inf), (True, 0.5), (False, -inf), (False, 0.5), (True, nan), (None, 0.1), (False, None)]
    df = spark.createDataFrame(data, "t boolean, s double")
    for range_scores in (1, 100):
        out = roc_auc(df, "t", "s", range_scores=range_scores).first()
        assert (out["n_positive"], out["n_negative"], out["n_unscored"], out["roc_auc"]) == (2, 2, 3, 0.875)


@pytest.mark.parametrize("max_tied", [1, 30, 1_000_000])
def test_split_follows_the_rows_only(spark, max_tied):
    data = [("a" if k % 3 else "b", k % 5, k) for k in range(300)] + [("a", 1, 7)] * 40
    df = spark.createDataFrame(data, "label string, key int, x int")
    want = None
    for parts in (1, 7, 64):
        out = stratified_split(df.repartition(parts), "label", "key", max_tied=max_tied)
        got = sorted(tuple(r) for r in out.collect())
        assert sum(r[-1] for r in got) == 68
        want = want or got
        assert got == want
    assert want == sorted(tuple(r) for r in stratified_split(df, "label", "key").collect())


def test_model_follows_rows_and_seed_only(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"),
                                 (F.col("id") % 5).cast("double").alias("z"), ((F.col("id") % 17) > 8).cast("int").alias("y"))
    cfg = ForestConfig(("x", "z"), "y", num_trees=5, max_depth=3, partitions=4)
    answers = []
    for parts in (1, 9):
        model = fit_forest(df.repartition(parts), cfg)
        answers.append(sorted((r.k, r.probability) for r in predict(model, df).collect()))
    assert answers[0] == answers[1]


def test_a_silent_series_breaches_until_the_end(spark):
    start = ts("2024-01-01")
    points = [("a", start + timedelta(minutes=k), 1.0) for k in range(10)] + [("b", start + timedelta(minutes=k), 1.0) for k in range(3)]
    df = spark.createDataFrame(points, "series string, minute timestamp_ntz, value double")
    rule = AlarmRule("avg", 80.0, 5, 5, True)
    alone = alarm_states(df, ["series"], rule).where("series = 'b'")
    assert alone.count() == 3 and alone.where("in_alarm").count() == 0
    out = alarm_states(df, ["series"], rule, until=F.lit(start + timedelta(minutes=9, seconds=30)).cast("timestamp_ntz"))
    assert out.where("series = 'b'").count() == 10 and out.where("series = 'a'").count() == 10
    assert [r.minute.minute for r in out.where("in_alarm").orderBy("minute").collect()] == [7, 8, 9]


def test_a_forest_makes_its_training_rows_once(spark):
    """Besides the count of nulls; the stages of the pipeline share rows that are dealt and sorted once."""
    made, kept = spark.sparkContext.accumulator(0), spark.sparkContext._jsc.getPersistentRDDs().size()

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    df = spark.range(400).selectExpr("id % 7 AS x", "id % 5 AS y", "id % 3 = 0 AS churned")
    model = fit_forest(df.mapInPandas(count, df.schema), ForestConfig(("x", "y"), "churned", num_trees=3, max_depth=3))
    assert made.value == 2 * 400
    assert model.stages[-1].getCacheNodeIds()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
