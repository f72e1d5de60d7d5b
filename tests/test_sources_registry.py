from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows, ts
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from featureline.errors import ChampionMissing, FeaturelineError, ModelConflict, ModelNotFound, SchemaMismatch
from featureline.functions import exprs as e
from featureline.operators.registry import Registry, current_aliases, next_versions, resolve
from featureline.schema import (CUSTOMER, CUSTOMER_FEATURE_REFS, CUSTOMER_FEATURES, FeatureView, explode_refs,
                                parse_refs, unknown_refs)
from featureline.sources.catalog import Catalog
from featureline.sources.online import OnlineTable
from featureline.sources.tables import (latest_predictions, prediction_rows, read_predictions, read_view, run_folder,
                                        score_spine, write_features, write_predictions, write_table)

NOW = datetime(2026, 1, 15, 12, tzinfo=timezone.utc)
VIEW = FeatureView("v", (CUSTOMER,), T.StructType([T.StructField("a", T.LongType())]),
                   ts_type=T.TimestampNTZType())
FEATURES = "entity_id string, event_timestamp timestamp_ntz, a long"


def predictions(spark, score=0.42, at=NOW):
    df = spark.createDataFrame([("cust-004", score), ("cust-005", 1.0)], "entity_id string, score double")
    return prediction_rows(df, "models:/m@champion", e.ts_literal(at, T.TimestampType()), F.lit(2))


def test_prediction_round_trip_keeps_microseconds(spark, folder):
    at = NOW + timedelta(microseconds=123456)
    out = write_predictions(predictions(spark, at=at), folder, "m", NOW)
    back = read_predictions(spark, out)
    row = back.filter("entity_id = 'cust-004'").first()
    assert row["score"] == 0.42 and row["model_version"] == 2
    assert back.select(F.unix_micros("predicted_at")).first()[0] == int(at.timestamp()) * 10**6 + 123456


def test_every_run_gets_its_own_folder(spark, folder):
    first = write_predictions(predictions(spark), folder, "m", NOW)
    second = write_predictions(predictions(spark, 0.5, NOW + timedelta(days=1)), folder + "/", "m", NOW)
    assert first != second and "/m/run=20260115T120000Z-" in first
    with pytest.raises(AnalysisException):
        write_predictions(predictions(spark), folder, "m", NOW, run_id=first.rsplit("-", 1)[1])
    everything = read_predictions(spark, f"{folder}/m")
    assert everything.count() == 4
    assert latest_predictions(everything).filter("entity_id = 'cust-004'").first()["score"] == 0.5


def test_run_folder_is_stamped_in_utc():
    at = datetime(2026, 1, 15, 14, tzinfo=timezone(timedelta(hours=2)))
    assert run_folder("s3://b/p//", "m", at, "id") == "s3://b/p/m/run=20260115T120000Z-id"


def test_score_spine_stamps_one_time_and_casts_the_key(spark):
    out = score_spine(spark.createDataFrame([(1,), (2,)], "entity_id long"), NOW)
    assert out.dtypes == [("entity_id", "string"), ("event_timestamp", "timestamp")]
    assert out.select("event_timestamp").distinct().count() == 1
    assert out.select(F.unix_seconds("event_timestamp")).first()[0] == int(NOW.timestamp())


def test_parquet_sink_never_overwrites(spark, folder):
    df = spark.createDataFrame([("a", ts("2024-01-01 05:00:00"), 1), ("a", ts("2024-02-01"), 2)], FEATURES)
    write_features(df, f"{folder}/f")
    assert rows(spark.read.parquet(f"{folder}/f").select("event_date").distinct().select(
        F.col("event_date").cast("string"))) == [("2024-01-01",), ("2024-02-01",)]
    with pytest.raises(AnalysisException):
        write_features(df, f"{folder}/f")
    assert rows(read_view(spark, VIEW, f"{folder}/f")) == rows(df)


def test_view_with_wrong_types_is_refused(spark, folder):
    write_table(spark.createDataFrame([("a", ts("2024-01-01"), "1")],
                                      "entity_id string, event_timestamp timestamp_ntz, a string"), f"{folder}/f")
    with pytest.raises(SchemaMismatch, match="column a is string, declared bigint"):
        read_view(spark, VIEW, f"{folder}/f")


def test_refs():
    parsed = parse_refs(" customer_features:age , ,customer_features:account_balance,", [CUSTOMER_FEATURES])
    assert [(v.name, f) for v, f in parsed] == [("customer_features", "age"), ("customer_features", "account_balance")]
    assert parse_refs(CUSTOMER_FEATURE_REFS, [CUSTOMER_FEATURES])[3][1] == "days_since_last_txn"
    for bad in ("age", "customer_features:nothing", "other:age", " , "):
        with pytest.raises(FeaturelineError):
            parse_refs(bad, [CUSTOMER_FEATURES])


def test_refs_of_a_table(spark):
    df = spark.createDataFrame([("m", "customer_features:age, ,x:y")], "model_name string, feature_refs string")
    refs = explode_refs(df)
    assert rows(refs) == [("m", 0, "customer_features", "age"), ("m", 1, "x", "y")]
    assert rows(unknown_refs(refs, [CUSTOMER_FEATURES]), "view") == [("x",)]


# --- online table ----------------------------------------------------------------------------

def feature_rows(spark, data):
    return spark.createDataFrame(data, FEATURES)


def test_online_takes_each_interval_once_and_newer_wins(spark, folder):
    online = OnlineTable(spark, folder, VIEW)
    assert online.read().count() == 0
    table = feature_rows(spark, [("a", ts("2024-01-01"), 1), ("a", ts("2024-01-03"), 3), ("b", ts("2024-01-02"), 2),
                                 (None, ts("2024-01-02"), 9), ("c", ts("2024-01-05"), 5)])
    first = online.materialize_incremental(table, "2024-01-02 00:00:00")
    assert rows(first, "entity_id", "a") == [("a", 1), ("b", 2)]
    second = online.materialize_incremental(table, datetime(2024, 1, 5))
    assert rows(second, "entity_id", "a") == [("a", 3), ("b", 2), ("c", 5)]
    # Nothing new in the interval: the table stays.
    assert rows(online.materialize_incremental(table, "2024-01-06 00:00:00")) == rows(second)


def test_online_ignores_late_rows_and_repeated_batches(spark, folder):
    online = OnlineTable(spark, folder, VIEW)
    late = feature_rows(spark, [("a", ts("2024-01-01"), 1), ("b", ts("2024-01-01"), 7)])
    online.merge(feature_rows(spark, [("a", ts("2024-01-03"), 3)]), "one")
    online.merge(late, "two")
    online.merge(late, "two")
    assert rows(online.read(), "entity_id", "a") == [("a", 3), ("b", 7)]


def test_online_folders_are_merged_now_and_then(spark, folder):
    online = OnlineTable(spark, folder, VIEW, full_every=3)
    for i in range(8):
        online.merge(feature_rows(spark, [("a", ts("2024-01-01") + timedelta(days=i), i), (f"k{i}", ts("2024-01-01"), i)]),
                     f"run{i}")
        assert online.read().filter("entity_id = 'a'").first()["a"] == i
        assert online.read().count() == i + 2
    state = spark.read.parquet(online.state_path)
    assert [r["sequence"] for r in state.filter("is_full").orderBy("sequence").collect()] == [1, 4, 7]


# --- registry --------------------------------------------------------------------------------

def test_versions_count_on_and_alias_moves(spark, folder):
    registry = Registry(spark, folder)
    assert registry.register("m", "r1", "p1", 0.51239, 0.6, NOW) == 1
    registry.set_alias("m", "champion", 1, NOW)
    assert registry.register("m", "r2", "p2", None, None, NOW + timedelta(hours=1)) == 2
    assert registry.register("other", "r3", "p3", 0.1, 0.2, NOW) == 1
    assert registry.champion("m")["source"] == "p1"
    registry.set_alias("m", "champion", 2, NOW + timedelta(hours=1))
    champion = registry.champion("m")
    assert (champion["model_uri"], champion["version"], champion["source"]) == ("models:/m@champion", 2, "p2")
    # The alias follows the last setting, also back to an older version.
    registry.set_alias("m", "champion", 1, NOW + timedelta(hours=2))
    assert registry.champion("m")["version"] == 1
    tags = registry.read("model_versions").filter("name = 'm' and version = 1").first()["tags"]
    assert tags == {"run_id": "r1", "f1_score": "0.5124", "roc_auc": "0.6"}
    with pytest.raises(ChampionMissing):
        registry.champion("other")


def test_versions_of_a_batch(spark):
    existing = spark.createDataFrame([("a", 1), ("a", 2)], "name string, version long")
    requests = spark.createDataFrame([("a", 5), ("b", 2), ("a", 3), ("b", 1)], "name string, at int")
    assert rows(next_versions(existing, requests, ["at"])) == [("a", 3, 3), ("a", 5, 4), ("b", 1, 1), ("b", 2, 2)]


def test_resolve_only_the_asked_alias(spark):
    aliases = spark.createDataFrame([("m", "champion", 1, NOW), ("m", "shadow", 2, NOW)],
                                    "name string, alias string, version long, set_at timestamp")
    versions = spark.createDataFrame([("m", 1, "r1", "p1"), ("m", 2, "r2", "p2")],
                                     "name string, version long, run_id string, source string")
    assert rows(resolve(aliases, versions)) == [("m", "models:/m@champion", 1, "r1", "p1")]
    assert current_aliases(aliases).count() == 2


# --- catalog ---------------------------------------------------------------------------------

REQUEST = "model_name string, feature_view string, feature_refs string, label_column string, experiment string, owner string"


def request(spark, *names):
    return spark.createDataFrame([(n, "customer_features", "customer_features:age", "churned", "churn_prediction",
                                   "data_science_team") for n in names], REQUEST)


def champions(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_catalog_life(spark, folder):
    catalog = Catalog(spark, f"{folder}/catalog")
    catalog.create(request(spark, "churn_model", "other"), ["owner"], NOW)
    row = catalog.get("churn_model").first()
    assert row["is_active"] and row["cron_schedule"] is None and len(row["id"]) == 36
    assert catalog.models().count() == 2
    with pytest.raises(ModelConflict):
        catalog.create(request(spark, "churn_model"), ["owner"], NOW)
    with pytest.raises(ModelNotFound):
        catalog.get("nothing")
    # Without strict the good part of a batch goes in and the conflicts come back.
    conflicts = catalog.create(request(spark, "churn_model", "third"), ["owner"], NOW, strict=False)
    assert rows(conflicts, "model_name") == [("churn_model",)] and catalog.models().count() == 3

    later = NOW + timedelta(hours=1)
    update = "model_name string, cron_schedule string"
    catalog.set_schedules(spark.createDataFrame([("churn_model", "rate(1 day)")], update),
                          champions(spark, "churn_model"), later)
    row = catalog.get("churn_model").first()
    assert row["cron_schedule"] == "rate(1 day)" and row["updated_at"] > row["created_at"]
    with pytest.raises(ChampionMissing):
        catalog.set_schedules(spark.createDataFrame([("other", "rate(1 day)")], update),
                              champions(spark, "churn_model"), later)
    with pytest.raises(ModelNotFound):
        catalog.set_schedules(spark.createDataFrame([("nothing", None)], update), champions(spark), later)
    # A second update at the very same time still counts as the later one.
    catalog.set_schedules(spark.createDataFrame([("churn_model", None)], update), champions(spark), later)
    assert catalog.get("churn_model").first()["cron_schedule"] is None
    assert catalog.models().count() == 3


# --- expressions -----------------------------------------------------------------------------

def test_uri_parts(spark):
    df = spark.createDataFrame([("s3://b/k/x",), ("s3://b",), ("http://b/k",)], "u string")
    out = df.select(e.uri_bucket(F.col("u")), e.uri_key(F.col("u"))).collect()
    assert [tuple(r) for r in out] == [("b", "k/x"), ("b", ""), (None, None)]


def test_padded_key_and_uniform_bounds(spark):
    df = spark.range(2000).select(e.padded_key("cust-", F.col("id")).alias("k"),
                                  e.uniform(42, F.col("id"), "x").alias("u"),
                                  e.uniform_int(42, F.col("id"), "y", 7, 91).alias("n"))
    assert df.first()["k"] == "cust-0000"
    low, high, least, most = df.agg(F.min("u"), F.max("u"), F.min("n"), F.max("n")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and (least, most) == (7, 90)


def test_utc_time_does_not_follow_the_session_zone(spark):
    df = spark.createDataFrame([(ts("2024-07-01 12:00:00"),)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        seconds, back = df.select(F.unix_seconds(e.utc_timestamp(F.col("t"))),
                                  e.wall_clock(e.utc_timestamp(F.col("t")))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seconds == 1719835200 and back == datetime(2024, 7, 1, 12)
