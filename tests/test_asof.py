"""Rules of the point-in-time join, one test each, and agreement with brute force."""

import contextlib
import io
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F, types as T

from featureline.errors import FeaturelineError, SchemaMismatch
from featureline.operators.asof import historical_features
from featureline.schema import CUSTOMER, Entity, FeatureView

NTZ = T.TimestampNTZType()
VIEW = FeatureView("v", (CUSTOMER,), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]),
                   ttl=timedelta(days=10), ts_type=NTZ)
SPINE = "entity_id string, event_timestamp timestamp_ntz, note string"
FEATURES = "entity_id string, event_timestamp timestamp_ntz, a long, b long"


def explained(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()[text.getvalue().index("\n\n"):]


def join(spark, spine, features, view=VIEW, refs="v:a,v:b", **kw):
    s = spark.createDataFrame(spine, SPINE)
    f = spark.createDataFrame(features, FEATURES)
    return historical_features(s, refs, (view,), {"v": f}, **kw)


def test_newest_row_not_after(spark):
    out = join(spark, [("x", ts("2024-01-10"), "s")],
               [("x", ts("2024-01-05"), 1, 1), ("x", ts("2024-01-08"), 2, 2), ("x", ts("2024-01-11"), 3, 3),
                ("y", ts("2024-01-09"), 4, 4)])
    assert rows(out, "note", "a") == [("s", 2)]


@pytest.mark.parametrize("exact, expected", [(False, 1), (True, 2)])
def test_equal_time_counts_only_when_allowed(spark, exact, expected):
    out = join(spark, [("x", ts("2024-01-10"), "s")],
               [("x", ts("2024-01-05"), 1, 1), ("x", ts("2024-01-10"), 2, 2)], allow_exact=exact)
    assert out.first()["a"] == expected


def test_ttl_edge_is_inclusive_and_older_is_null(spark):
    spine = [("x", ts("2024-01-11"), "edge"), ("x", ts("2024-01-11 00:00:00.000001"), "past")]
    out = join(spark, spine, [("x", ts("2024-01-01"), 1, 1)])
    assert rows(out, "note", "a") == [("edge", 1), ("past", None)]


@pytest.mark.parametrize("ttl", [None, timedelta(0)])
def test_no_ttl_means_no_limit(spark, ttl):
    view = FeatureView("v", (CUSTOMER,), VIEW.schema, ttl=ttl, ts_type=NTZ)
    out = join(spark, [("x", ts("2024-01-11"), "s")], [("x", ts("1999-01-01"), 1, 1)], view=view)
    assert out.first()["a"] == 1


def test_every_spine_row_survives_with_duplicates(spark):
    spine = [("x", ts("2024-01-10"), "s"), ("x", ts("2024-01-10"), "s"), ("z", ts("2024-01-10"), "t")]
    out = join(spark, spine, [("x", ts("2024-01-09"), 1, 2)])
    assert rows(out, "note", "a", "b") == [("s", 1, 2), ("s", 1, 2), ("t", None, None)]


def test_null_inside_the_matched_row_stays_null(spark):
    out = join(spark, [("x", ts("2024-01-10"), "s")],
               [("x", ts("2024-01-05"), 1, 7), ("x", ts("2024-01-08"), None, 8)])
    assert rows(out, "a", "b") == [(None, 8)]


def test_null_key_and_null_time_match_nothing(spark):
    spine = [(None, ts("2024-01-10"), "key"), ("x", None, "time")]
    features = [(None, ts("2024-01-09"), 1, 1), ("x", None, 2, 2), ("x", ts("2024-01-09"), 3, 3)]
    assert rows(join(spark, spine, features), "note", "a") == [("key", None), ("time", None)]


def test_ties_take_the_greatest_features_or_the_tiebreak(spark):
    features = [("x", ts("2024-01-09"), 1, 5), ("x", ts("2024-01-09"), 2, 1)]
    assert rows(join(spark, [("x", ts("2024-01-10"), "s")], features), "a", "b") == [(2, 1)]
    # All declared features decide, whether they were asked for or not.
    assert join(spark, [("x", ts("2024-01-10"), "s")], features, refs="v:b").first()["b"] == 1
    by_b = FeatureView("v", (CUSTOMER,), VIEW.schema, ttl=VIEW.ttl, ts_type=NTZ, tiebreak=("b",))
    assert rows(join(spark, [("x", ts("2024-01-10"), "s")], features, view=by_b), "a", "b") == [(1, 5)]


def test_output_order_and_name_clash(spark):
    out = join(spark, [("x", ts("2024-01-10"), "s")], [], refs="v:b, v:a,")
    assert out.columns == ["entity_id", "event_timestamp", "note", "b", "a"]
    with pytest.raises(FeaturelineError):
        join(spark, [("x", ts("2024-01-10"), "s")], [], refs="v:a,v:a")
    with pytest.raises(FeaturelineError):
        join(spark, [("x", ts("2024-01-10"), "s")], [], refs="v:nothing")
    with pytest.raises(FeaturelineError):
        join(spark, [("x", ts("2024-01-10"), "s")], [], refs="w:a")


def test_same_feature_name_in_two_views_needs_full_names(spark):
    other = FeatureView("w", (CUSTOMER,), VIEW.schema, ts_type=NTZ)
    s = spark.createDataFrame([("x", ts("2024-01-10"), "s")], SPINE)
    f = spark.createDataFrame([("x", ts("2024-01-09"), 1, 2)], FEATURES)
    g = spark.createDataFrame([("x", ts("2023-01-09"), 3, 4)], FEATURES)
    with pytest.raises(FeaturelineError):
        historical_features(s, "v:a,w:a", (VIEW, other), {"v": f, "w": g})
    out = historical_features(s, "w:a,v:a", (VIEW, other), {"v": f, "w": g}, full_names=True)
    assert out.columns[3:] == ["w__a", "v__a"] and rows(out, "w__a", "v__a") == [(3, 1)]


def test_empty_spine_and_empty_features(spark):
    assert join(spark, [], [("x", ts("2024-01-09"), 1, 2)]).count() == 0
    assert rows(join(spark, [("x", ts("2024-01-09"), "s")], []), "a") == [(None,)]


def brute(spine, features, ttl, exact):
    out = []
    for key, at, note in spine:
        fits = [f for f in features if key is not None and f[0] == key and f[1] is not None and at is not None
                and (f[1] < at or (exact and f[1] == at))]
        best = max(fits, key=lambda f: (f[1], f[2] is not None, f[2] or 0, f[3])) if fits else None
        alive = best is not None and (ttl is None or best[1] >= at - ttl)
        out.append((note, best[2] if alive else None, best[3] if alive else None))
    return sorted(out, key=str)


def sample(seed, n):
    """Half of all rows on one key, a crowd of them at one time, ties and nulls."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)

    def at():
        if rng.random() < 0.3:
            return start + timedelta(days=20)
        return start + timedelta(minutes=rng.randrange(0, 60 * 24 * 40, 97))

    def key():
        return None if rng.random() < 0.03 else "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"

    spine = [(key(), at(), f"s{i:05d}") for i in range(n)]
    features = [(key(), at(), rng.choice([None, 1, 2, 3]), rng.randrange(1000)) for _ in range(n)]
    return spine, features


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("exact", [False, True])
def test_plain_and_cut_forms_equal_brute_force(spark, seed, exact):
    spine, features = sample(seed, 600)
    expected = brute(spine, features, VIEW.ttl, exact)
    for bucket in (None, timedelta(days=400), timedelta(days=30), timedelta(hours=7)):
        out = join(spark, spine, features, allow_exact=exact, bucket=bucket)
        assert rows(out, "note", "a", "b") == expected, bucket


def test_identical_spine_rows_of_a_hot_key_are_all_kept(spark):
    spine = [("hot", ts("2024-02-01"), "same")] * 500 + [("k", ts("2024-02-01"), "one")]
    features = [("hot", ts("2024-01-25") + timedelta(hours=i % 100), 1, i) for i in range(300)]
    out = join(spark, spine, features, bucket=timedelta(hours=5))
    assert out.groupBy("note", "b").count().orderBy("note").collect()[1]["count"] == 500
    assert out.count() == 501


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_result_does_not_depend_on_partitioning(spark, parts):
    spine, features = sample(3, 200)
    s = spark.createDataFrame(spine, SPINE).repartition(parts)
    f = spark.createDataFrame(features, FEATURES).repartition(parts)
    out = historical_features(s, "v:a,v:b", (VIEW,), {"v": f}, bucket=timedelta(days=1))
    assert rows(out, "note", "a", "b") == brute(spine, features, VIEW.ttl, False)


def test_views_with_equal_keys_share_one_shuffle(spark):
    other = FeatureView("w", (CUSTOMER,), T.StructType([T.StructField("c", T.LongType())]), ts_type=NTZ)
    s = spark.createDataFrame([("x", ts("2024-01-10"), "s")], SPINE)
    f = spark.createDataFrame([("x", ts("2024-01-09"), 1, 2)], FEATURES)
    g = f.select("entity_id", "event_timestamp", F.col("a").alias("c"))
    out = historical_features(s, "v:a,w:c", (VIEW, other), {"v": f, "w": g}, bucket=None)
    plan = explained(out)
    assert plan.count(") Exchange") == 1 and plan.count(") Window") == 1
    assert rows(out, "a", "c") == [(1, 1)]


def test_hot_keys_of_two_views_and_two_key_columns(spark):
    entity = Entity("pair", ("k1", "k2"))
    left = FeatureView("l", (entity,), T.StructType([T.StructField("a", T.LongType())]), ts_type=NTZ)
    right = FeatureView("r", (entity,), T.StructType([T.StructField("c", T.LongType())]), ts_type=NTZ,
                        ttl=timedelta(days=2))
    rng = random.Random(9)

    def table(n, name):
        data = [(rng.choice([1, 1, 2]), rng.choice(["p", "p", "q"]),
                 datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(20_000)), i) for i in range(n)]
        return spark.createDataFrame(data, f"k1 long, k2 string, event_timestamp timestamp_ntz, {name} long").cache()

    spine, lt, rt = table(300, "n"), table(300, "a"), table(300, "c")
    args = (spine, "l:a,r:c", (left, right), {"l": lt, "r": rt})
    plain = historical_features(*args, bucket=None)
    cut = historical_features(*args, bucket=timedelta(days=2))
    assert rows(plain) == rows(cut)


def test_scan_is_cut_to_the_spine_times(spark, folder):
    spark.createDataFrame([("x", ts("2024-01-09"), 1, 2)], FEATURES).write.parquet(f"{folder}/f")
    s = spark.createDataFrame([("x", ts("2024-01-10"), "s")], SPINE)
    out = historical_features(s, "v:a", (VIEW,), {"v": spark.read.parquet(f"{folder}/f")}, bucket=None)
    plan = explained(out)
    assert "GreaterThanOrEqual(event_timestamp,2023-12-31T00:00)" in plan
    assert "LessThanOrEqual(event_timestamp,2024-01-10T00:00)" in plan


def test_date_partitions_are_skipped(spark, folder):
    from featureline.sources.tables import read_view, write_features

    features = [("x", ts("2024-01-01") + timedelta(days=i), i, i) for i in range(60)]
    write_features(spark.createDataFrame(features, FEATURES), f"{folder}/f")
    view = FeatureView("v", (CUSTOMER,), VIEW.schema, ttl=timedelta(days=5), ts_type=NTZ, date_column="event_date")
    table = read_view(spark, view, f"{folder}/f")
    s = spark.createDataFrame([("x", ts("2024-02-01"), "s")], SPINE)
    out = historical_features(s, "v:a", (view,), {"v": table}, bucket=None)
    plan = explained(out)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert out.first()["a"] == 30


def test_times_of_different_types_are_refused(spark):
    s = spark.createDataFrame([("x", ts("2024-01-10"), "s")], "entity_id string, event_timestamp timestamp, note string")
    f = spark.createDataFrame([("x", ts("2024-01-09"), 1, 2)], FEATURES)
    with pytest.raises(SchemaMismatch):
        historical_features(s, "v:a", (VIEW,), {"v": f})


def test_zoned_times_are_cut_exactly(spark, folder):
    """In the hour that a clock runs through twice, nothing is lost."""
    schema = "entity_id string, event_timestamp timestamp, a long, b long"
    micros = 1730611800 * 10**6  # 2024-11-03 05:30 UTC, 01:30 in New York, again at 06:30 UTC
    f = spark.createDataFrame([(micros - 60 * 10**6, 1), (micros + 3540 * 10**6, 2)], "t long, a long").select(
        F.lit("x").alias("entity_id"), F.timestamp_micros("t").alias("event_timestamp"), "a", F.col("a").alias("b"))
    f.write.parquet(f"{folder}/f")
    view = FeatureView("v", (CUSTOMER,), VIEW.schema, ttl=timedelta(minutes=30))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        spine = spark.range(1).select(F.lit("x").alias("entity_id"),
                                      F.timestamp_micros(F.lit(micros + 3600 * 10**6)).alias("event_timestamp"))
        table = spark.read.schema(schema).parquet(f"{folder}/f")
        assert historical_features(spine, "v:a", (view,), {"v": table}).first()["a"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
