import os

import pytest
from datetime import datetime, timezone

from conftest import rows
from pyspark.sql import functions as F

from featureline.operators.registry import Registry
from featureline.plans.publish import generate
from featureline.plans.train import TrainConfig, train_job
from featureline.sources.snapshots import SnapshotBroken, Snapshots
from featureline.sources.tables import FEATURES_DIR

NOW = datetime(2026, 1, 15, tzinfo=timezone.utc)


def days(spark, path, first, last):
    df = spark.range(first * 100, last * 100).select("id", (F.col("id") / 7).alias("a.b"), F.concat(F.lit("d+ %"), (F.col("id") / 100).cast("int")).alias("day"))
    df.repartition(2).write.mode("append").partitionBy("day").parquet(path)


@pytest.fixture()
def kept(spark, folder):
    days(spark, f"{folder}/t", 0, 3)
    return Snapshots(spark, f"{folder}/t", f"{folder}/store")


def opened(monkeypatch, kept):
    """Names of the data files whose rows are digested, call by call."""
    seen, digests = [], Snapshots._digests

    def spy(self, files):
        seen.append(self._names(files))
        return digests(self, files)

    monkeypatch.setattr(Snapshots, "_digests", spy)
    return seen


def test_a_snapshot_is_read_as_it_was(spark, folder, kept):
    before = kept.take()
    was = rows(spark.read.parquet(f"{folder}/t"))
    days(spark, f"{folder}/t", 2, 5)
    after = kept.take(before)
    assert before != after and rows(kept.read(before)) == was
    assert rows(kept.read(after)) == rows(spark.read.parquet(f"{folder}/t"))
    assert kept.take() == after == kept.take(after) == kept.take(before)


def test_only_new_files_are_opened(spark, folder, kept, monkeypatch):
    seen = opened(monkeypatch, kept)
    before = kept.take()
    old = set(seen.pop())
    assert len(old) == kept.files(before).count() > 0
    days(spark, f"{folder}/t", 2, 5)
    after = kept.take(before)
    new = set(seen.pop())
    assert new and not new & old and len(new | old) == kept.files(after).count()
    kept.take(after)
    assert seen == [[]]


def test_a_diff_opens_changed_folders_only(spark, folder, kept, monkeypatch):
    before = kept.take()
    days(spark, f"{folder}/t", 2, 5)
    after = kept.take(before)
    read, stored = [], Snapshots._stored
    monkeypatch.setattr(Snapshots, "_stored", lambda self, digests=None: read.append(digests) or stored(self, digests))
    found = kept.diff(before, after).groupBy("folder", "change").agg(F.sum("n_rows_after").alias("n")).collect()
    assert {(r["folder"][-1], r["change"], r["n"]) for r in found} == {("2", "added", 100), ("3", "added", 100), ("4", "added", 100)}
    assert [len(d) for d in read] == [1, 3]
    assert kept.diff(after, after).count() == 0
    assert {r["change"] for r in kept.diff(after, before).collect()} == {"removed"}


def test_lost_and_changed_files_are_noticed(spark, folder, kept):
    snapshot = kept.take()
    names = kept._names(kept.files(snapshot))
    one = names[0].removeprefix("file:")
    stamp = os.stat(one)
    os.utime(one, (stamp.st_atime, stamp.st_mtime + 100))
    assert kept.broken(snapshot).count() == 0  # touched, with the same rows
    copy = f"{folder}/other"
    spark.range(5).select("id", F.lit(1.0).alias("a.b")).coalesce(1).write.parquet(copy)
    other = next(f"{copy}/{f}" for f in os.listdir(copy) if f.endswith(".parquet"))
    with open(other, "rb") as source, open(one, "wb") as target:
        target.write(source.read())
    for name in os.listdir(os.path.dirname(one)):
        if name == f".{os.path.basename(one)}.crc":
            os.remove(f"{os.path.dirname(one)}/{name}")
    assert kept.broken(snapshot).count() == 1
    with pytest.raises(SnapshotBroken):
        kept.read(snapshot)


def test_nothing_there(spark, folder):
    kept = Snapshots(spark, f"{folder}/none", f"{folder}/store")
    snapshot = kept.take()
    assert kept.take(snapshot) == snapshot and kept.folders(snapshot).count() == 0
    with pytest.raises(SnapshotBroken):
        kept.read(snapshot)


def test_training_repeats_on_its_snapshot(spark, folder):
    generate(spark, folder, 120, NOW)
    cfg = TrainConfig(base=folder, registry=f"{folder}/registry", num_trees=3, max_depth=3, snapshots=f"{folder}/store")
    first = train_job(spark, cfg, NOW)
    more = spark.read.parquet(f"{folder}/{FEATURES_DIR}").withColumn("event_timestamp", F.col("event_timestamp") + F.expr("interval 1 hour")).withColumn(
        "age", F.col("age") + 1)
    more.write.mode("append").partitionBy("event_date").parquet(f"{folder}/{FEATURES_DIR}")
    registry = Registry(spark, f"{folder}/registry")
    used = {r["run_id"]: r["params"]["snapshot"] for r in registry.read("runs").collect()}
    again = train_job(spark, TrainConfig(**{**cfg.__dict__, "snapshot": used[first.run_id]}), NOW)
    fresh = train_job(spark, cfg, NOW)
    digests = {r["run_id"]: r["digest"] for r in registry.read("run_inputs").select("run_id", "digest").distinct().collect()}
    assert digests[again.run_id] == digests[first.run_id] != digests[fresh.run_id]
    assert again.metrics == first.metrics
