import os
import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from featureline.plans.publish import generate, lookup, materialize
from featureline.session import folders_in
from featureline.sources.buckets import BucketedOnlineTable
from featureline.streaming.materialize import feature_stream, materialize_stream
from conftest import rows, ts
from test_sources_registry import FEATURES, VIEW

LIVE_FOR = replace(VIEW, ttl=timedelta(days=10))


def frame(spark, data):
    return spark.createDataFrame(data, FEATURES)


def files(online, run):
    """Bucket and size of every file a run has written."""
    out = {}
    for name in folders_in(online.spark, f"{online.base}/rows"):
        if name.startswith(f"{run}-"):
            for bucket in os.listdir(f"{online.base}/rows/{name}"):
                if bucket.startswith("bucket="):
                    folder = f"{online.base}/rows/{name}/{bucket}"
                    out[name, int(bucket[7:])] = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
    return out


@pytest.mark.parametrize("fanout,buckets", [(2, 4), (3, 1), (4, 7)])
def test_any_order_of_runs_gives_the_newest_rows(spark, folder, fanout, buckets):
    rng = random.Random(fanout)
    online = BucketedOnlineTable(spark, folder, VIEW, buckets, fanout)
    assert online.read().count() == 0 and online.segments() == []
    newest: dict = {}
    for run in range(7):
        batch = [(f"k{rng.randrange(12)}", ts("2024-01-01") + timedelta(hours=rng.randrange(500)), rng.randrange(9)) for _ in range(6)]
        online.merge(frame(spark, batch), f"r{run}")
        for k, t, a in batch:
            newest[k] = max(newest.get(k, (t, a)), (t, a))
        assert rows(online.read(), "entity_id", "a") == sorted(((k, a) for k, (_, a) in newest.items()), key=str)
    per_bucket = [sum(s["bucket"] == b and s["level"] == level for s in online.segments()) for b in range(buckets) for level in range(4)]
    assert max(per_bucket) < fanout
    assert BucketedOnlineTable(spark, folder, VIEW, 99, fanout).buckets == buckets
    removed = online.clean()
    assert removed > 0 and online.clean() == 0
    assert rows(online.read(), "entity_id", "a") == sorted(((k, a) for k, (_, a) in newest.items()), key=str)


def test_a_run_writes_touched_buckets_only(spark, folder):
    online = BucketedOnlineTable(spark, folder, VIEW, buckets=8, fanout=2)
    online.merge(frame(spark, [(f"k{k}", ts("2024-01-01"), k) for k in range(400)]), "whole")
    assert {b for _, b in files(online, "whole")} == set(range(8))
    one = frame(spark, [("k5", ts("2024-02-01"), -5)])
    bucket = one.select(online.bucket()).first()[0]
    online.merge(one, "one")
    # The new segment, and the merge of this bucket's two; all others stay as they were written.
    assert {b for _, b in files(online, "one")} == {bucket}
    assert sum(files(online, "one").values()) < sum(files(online, "whole").values()) / 3
    assert {s["bucket"]: s["level"] for s in online.segments()} == {b: int(b == bucket) for b in range(8)}
    online.merge(frame(spark, []), "nothing")
    assert files(online, "nothing") == {} and online.read().count() == 400


def test_lookup_opens_asked_buckets_only_and_applies_the_time_to_live(spark, folder):
    online = BucketedOnlineTable(spark, folder, LIVE_FOR, buckets=8)
    online.merge(frame(spark, [(f"k{k}", ts("2024-01-01") + timedelta(days=k % 30), k) for k in range(300)]), "r")
    asked = spark.createDataFrame([("k3", "x"), ("k3", "y"), ("k25", "x"), ("gone", "x"), (None, "x")], "entity_id string, found string")
    wanted = {r[0] for r in asked.select(online.bucket()).collect()}
    opened = {int(f.split("bucket=")[1].split("/")[0]) for f in online.rows_for(asked).inputFiles()}
    assert opened and opened <= wanted and len(wanted) < 8
    out = online.lookup(asked, "2024-01-14 00:00:00")
    assert out.columns == ["entity_id", "a", "feature_timestamp", "found", "expired"]
    got = rows(out.select("entity_id", "a", "found", "expired"))
    assert got == sorted([("k3", 3, True, False)] * 2 + [("k25", 25, True, False), ("gone", None, False, False), (None, None, False, False)], key=str)
    # A row exactly as old as the time to live still counts.
    assert rows(online.lookup(asked.limit(1), "2024-01-14 00:00:00").select("a")) == [(3,)]
    assert online.lookup(asked.limit(1), "2024-01-14 00:00:01").select("a", "found", "expired").first() == (None, True, True)
    own = asked.withColumn("at", F.when(F.col("found") == "y", F.lit(ts("2024-03-01"))).otherwise(F.lit(ts("2024-01-05"))))
    assert rows(online.lookup(own.where("entity_id = 'k3'"), F.col("at")).select("a", "expired")) == [(3, False), (None, True)]


def test_intervals_and_a_second_writer(spark, folder):
    table = frame(spark, [("a", ts("2024-01-01"), 1), ("a", ts("2024-01-03"), 3), ("b", ts("2024-01-02"), 2), (None, ts("2024-01-02"), 9)])
    online = BucketedOnlineTable(spark, folder, VIEW)
    assert rows(online.materialize_incremental(table, "2024-01-02 00:00:00"), "entity_id", "a") == [("a", 1), ("b", 2)]
    before = online._live()
    assert rows(online.materialize_incremental(table, "2024-01-05 00:00:00"), "entity_id", "a") == [("a", 3), ("b", 2)]
    assert online.segments()[-1]["interval_end"].startswith("2024-01-05")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        online._merge(frame(spark, [("a", ts("2024-01-09"), 7)]), "late", None, before)
    assert rows(online.read(), "entity_id", "a") == [("a", 3), ("b", 2)]


def test_the_stream_feeds_key_buckets_too(spark, folder):
    for k in range(4):
        frame(spark, [("a", ts("2024-01-01") + timedelta(days=(k * 3) % 4), k), (f"b{k}", ts("2024-01-01"), k)]).write.mode("append").parquet(f"{folder}/in")
    online = BucketedOnlineTable(spark, f"{folder}/online", VIEW, buckets=3, fanout=2)
    stream = feature_stream(spark, VIEW, f"{folder}/in", files_per_batch=3)
    materialize_stream(stream, online, f"{folder}/checkpoint").awaitTermination()
    assert rows(online.read(), "entity_id", "a") == [("a", 1), ("b0", 0), ("b1", 1), ("b2", 2), ("b3", 3)]


def test_publish_and_lookup(spark, folder):
    now = datetime(2026, 1, 15, tzinfo=timezone.utc)
    generate(spark, folder, 50, now)
    assert materialize(spark, folder, now, buckets=4).count() == 50
    found = lookup(spark, folder, spark.createDataFrame([("cust-0007",), ("nobody",)], "entity_id string"), now).collect()
    assert {r.entity_id: r.found for r in found} == {"cust-0007": True, "nobody": False}
