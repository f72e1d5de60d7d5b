import random
from datetime import datetime, timedelta

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from featureline.errors import EmptyDataset, InvalidRows, MissingFeatures, SchemaMismatch
from featureline.operators.keyed import (first_per_key, inner_join, keyed_insert, keyed_update, latest_per_key,
                                         suffix_join, unknown_keys, unmatched_report, unmatched_rows)
from featureline.operators.profile import dataset_profile, drop_keys
from featureline.operators.quality import (ERRORS, PREDICTION_RULES, SPINE_RULES, apply_missing_policy, completeness,
                                           leakage_report, not_empty, split_valid, validate, with_errors)
from featureline.schema import CUSTOMER_FEATURES, conform
from featureline.sources.tables import training_spine

TEXT_SPINE = "entity_id string, event_timestamp string"


def errors(spark, data, schema, rules):
    return [list(r[ERRORS]) for r in with_errors(spark.createDataFrame(data, schema), rules).collect()]


def test_spine_row_cases(spark):
    good = [("cust-001", "2026-01-15 12:00:00"), ("cust-003", "2026-01-15T12:00:00Z"), ("", "2026-01-15")]
    assert errors(spark, good, TEXT_SPINE, SPINE_RULES) == [[], [], []]
    bad = [(None, "2026-01-15T12:00:00Z"), ("cust-004", None), ("cust-005", "not-a-date"), (None, "x")]
    assert errors(spark, bad, TEXT_SPINE, SPINE_RULES) == [
        ["entity_id: missing"], ["event_timestamp: missing"], ["event_timestamp: not a time"],
        ["entity_id: missing", "event_timestamp: not a time"]]


def test_spine_with_absent_or_mistyped_columns(spark):
    assert errors(spark, [("a",)], "entity_id string", SPINE_RULES) == [["event_timestamp: missing"]]
    assert errors(spark, [(1, ts("2024-01-01"))], "entity_id long, event_timestamp timestamp", SPINE_RULES) == [
        ["entity_id: not text"]]


def test_fail_mode_stops_and_shows_samples(spark):
    df = spark.createDataFrame([("a", "2026-01-15"), ("b", "never")], TEXT_SPINE)
    with pytest.raises(InvalidRows, match="1 invalid rows.*never"):
        validate(df, SPINE_RULES)


def test_split_mode_converts_the_valid_rows(spark):
    df = spark.createDataFrame([("a", "2026-01-15T12:00:00Z"), ("b", "never")], TEXT_SPINE)
    valid, rejected = split_valid(df, SPINE_RULES)
    assert rows(valid) == [("a", datetime(2026, 1, 15, 12))]
    assert rows(rejected, "entity_id") == [("b",)]


def test_inline_mode_stops_when_the_row_is_reached(spark):
    df = spark.createDataFrame([("a", "2026-01-15"), ("b", "never")], TEXT_SPINE)
    checked = validate(df, SPINE_RULES, mode="inline")
    with pytest.raises(Exception, match="invalid row: event_timestamp: not a time"):
        checked.collect()
    assert validate(df.filter("entity_id = 'a'"), SPINE_RULES, mode="inline").count() == 1


def test_training_spine_is_utc_and_projected(spark):
    df = spark.createDataFrame([("a", ts("2026-01-15 12:00:00"), 1)],
                               "entity_id string, event_timestamp timestamp_ntz, extra int")
    out = training_spine(df)
    assert out.columns == ["entity_id", "event_timestamp"]
    assert out.schema["event_timestamp"].dataType.simpleString() == "timestamp"
    assert out.select(F.unix_seconds("event_timestamp")).first()[0] == 1768478400


def test_prediction_row_cases(spark):
    schema = "entity_id string, score int, model_uri string, predicted_at timestamp"
    valid, _ = split_valid(spark.createDataFrame([("c", 1, "models:/m@champion", ts("2026-01-01"))], schema),
                           PREDICTION_RULES)
    assert valid.first()["score"] == 1.0 and dict(valid.dtypes)["score"] == "double"
    missing = spark.createDataFrame([("c", None, "models:/m@champion", ts("2026-01-01"))], schema)
    assert rows(with_errors(missing, PREDICTION_RULES), ERRORS) == [(["score: missing"],)]
    absent = missing.drop("score")
    assert rows(with_errors(absent, PREDICTION_RULES), ERRORS) == [(["score: missing"],)]


def test_schema_mismatch_names_every_problem(spark):
    df = spark.createDataFrame([("a", 1)], "entity_id string, age int")
    with pytest.raises(SchemaMismatch) as caught:
        conform(df, CUSTOMER_FEATURES.table_schema)
    text = str(caught.value)
    assert "column age is int, declared bigint" in text and "missing column account_balance double" in text


def test_empty_guard(spark):
    with pytest.raises(EmptyDataset) as caught:
        not_empty(spark.createDataFrame([], "a int"))
    assert caught.value.error_id == "2001"


@pytest.mark.parametrize("bucket", [None, timedelta(days=30), timedelta(hours=9)])
def test_leakage_counts_equal_all_pairs(spark, bucket):
    rng = random.Random(5)

    def table(n):
        return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}",
                 datetime(2024, 1, 1) + timedelta(hours=rng.randrange(100))) for _ in range(n)]

    f, l = table(300), table(200)
    schema = "entity_id string, event_timestamp timestamp_ntz"
    out = leakage_report(spark.createDataFrame(f, schema), spark.createDataFrame(l, schema), bucket=bucket).first()
    pairs = [(a, b) for k, a in f for j, b in l if k == j]
    assert int(out["n_pairs"]) == len(pairs)
    assert int(out["n_leaking"]) == sum(a >= b for a, b in pairs)
    assert not out["passed"]


def test_leakage_passes_when_features_are_older(spark):
    schema = "entity_id string, event_timestamp timestamp_ntz"
    out = leakage_report(spark.createDataFrame([("a", ts("2024-01-01"))], schema),
                         spark.createDataFrame([("a", ts("2024-01-02"))], schema)).first()
    assert (int(out["n_pairs"]), int(out["n_leaking"]), out["passed"]) == (1, 0, True)


def test_completeness_and_missing_policy(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    out = completeness(df, ["a", "b"]).first()
    assert (out["n_rows"], out["n_columns"], out["a_nulls"], out["b_nulls"], out["complete"]) == (2, 2, 0, 1, False)
    assert apply_missing_policy(df, ["a", "b"], "drop").count() == 1
    assert apply_missing_policy(df, ["a", "b"], "impute").count() == 2
    with pytest.raises(MissingFeatures, match="b_nulls"):
        apply_missing_policy(df, ["a", "b"], "fail")


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 2, None), ("b", 1, 1, "z")],
                               "k string, t int, n int, v string")
    assert rows(latest_per_key(df, ["k"], "t", ["n"])) == [("a", 2, 2, None), ("b", 1, 1, "z")]
    assert rows(first_per_key(df, ["k"], ["t", "n"])) == [("a", 1, 5, "x"), ("b", 1, 1, "z")]


@pytest.mark.parametrize("salts", [1, 5])
def test_insert_accepts_the_first_of_new_names(spark, salts):
    existing = spark.createDataFrame([("old",)], "name string")
    requests = [("new", i) for i in range(10)] + [("old", 20), ("other", 30)]
    out = keyed_insert(existing, spark.createDataFrame(requests, "name string, n int"), "name", ["n"], salts)
    got = {(r["name"], r["n"]): r["status"] for r in out.collect()}
    assert len(got) == 12
    assert [k for k, s in sorted(got.items()) if s == "accepted"] == [("new", 0), ("other", 30)]


def test_update_null_clears_and_unknown_is_reported(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], "k string, v string, at int")
    updates = spark.createDataFrame([("a", None), ("b", "n"), ("q", "n")], "k string, v string")
    out = keyed_update(table, updates, "k", ["v"], {"at": F.lit(2)})
    assert rows(out) == [("a", None, 2), ("b", "n", 2), ("c", "z", 1)]
    assert rows(unknown_keys(table, updates, "k")) == [("q", "n")]


@pytest.mark.parametrize("salts", [1, 4])
def test_joins_with_hot_keys_on_either_side(spark, salts):
    left = [("h", i) for i in range(20)] + [("r", 100), ("x", 101), (None, 102)]
    right = [("r", i) for i in range(15)] + [("h", 200), ("y", 201), (None, 202)]
    l, r = spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b int")
    expected = sorted([(k, a, b) for k, a in left for j, b in right if k is not None and k == j], key=str)
    assert rows(inner_join(l, r, ["k"], salts)) == expected
    both = suffix_join(l.withColumnRenamed("a", "t"), r.withColumnRenamed("b", "t"), ["k"], ("_l", "_r"), salts)
    assert both.columns == ["k", "t_l", "t_r"] and rows(both) == expected


def test_hot_rows_of_one_partition_are_spread(spark):
    from featureline.operators.skew import spread

    df = spark.range(0, 2000, 1, 1).select(F.lit("h").alias("k"), "id")
    copies = df.select(spread(df, F.lit(64)).alias("c")).groupBy("c").count().collect()
    assert len(copies) == 64 and max(r["count"] for r in copies) < 100
    equal = spark.range(0, 2000, 1, 50).select(F.lit("h").alias("k"))
    assert equal.select(spread(equal, F.lit(64)).alias("c")).distinct().count() > 20


def test_unmatched(spark):
    l = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    r = spark.createDataFrame([("a", 1), ("a", 5), ("c", 6)], "k string, y int")
    assert tuple(unmatched_report(l, r, ["k"]).first()) == (3, 3, 4, 1, 1)
    only_l, only_r = unmatched_rows(l, r, ["k"])
    assert rows(only_l) == [("b", 3)] and rows(only_r) == [("c", 6)]


def test_profile_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    one = dataset_profile(df, "d", "s", "y").collect()
    two = dataset_profile(df.repartition(3).orderBy(F.col("x").desc()), "d", "s", "y").collect()
    assert one == two and one[1]["nulls"] == 2 and one[0]["n_rows"] == 3
    changed = dataset_profile(df.union(df), "d", "s", "y").first()
    assert changed["digest"] != one[0]["digest"]


def test_drop_keys_ignores_absent_names(spark):
    df = spark.createDataFrame([("a", 1)], "entity_id string, x int")
    assert drop_keys(df).columns == ["x"]
