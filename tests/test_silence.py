import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureline.functions.exprs import wall_clock
from featureline.operators.alarms import AlarmRule, alarm_states, metric_points
from featureline.streaming import silence
from conftest import rows

START = datetime(2024, 1, 1)
EVENTS = "series string, ts timestamp_ntz, value double"
RULE = AlarmRule("avg", 50.0, 4, 3, True)


def events(minutes=200):
    """One series all along, one with gaps, and one that stops after 30 minutes."""
    rng = random.Random(1)
    made = []
    for m in range(minutes):
        for name in ("steady", "gaps", "stops"):
            if name == "steady" or (name == "gaps" and rng.random() < 0.3) or (name == "stops" and m < 30):
                made += [(name, START + timedelta(minutes=m, seconds=rng.randrange(60)), rng.choice([10.0, 90.0])) for _ in range(2)]
    return made


def run(spark, folder, parts, **options):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    alarms = silence.silence_alarms(stream, F.col("series"), F.col("ts"), F.col("value"), RULE, "10 minutes", **options)
    query = silence.run_silence_alarms(alarms, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/late")
    return query, spark.read.parquet(f"{folder}/out").withColumn("minute", wall_clock(F.col("minute")))


def batch(spark, made):
    """The batch form, up to the last minute that the watermark has passed."""
    mark = max(t for _, t, _ in made) - timedelta(minutes=10)
    end = mark.replace(second=0) - timedelta(minutes=1)
    df = spark.createDataFrame([r for r in made if r[1] < end + timedelta(minutes=1)], EVENTS)
    return alarm_states(metric_points(df, ["series"], "ts", F.col("value"), "avg"), ["series"], RULE, until=F.lit(end))


@pytest.mark.parametrize("frame", [10_000, 7])
def test_stream_equals_the_batch_form_also_for_a_silent_series(spark, folder, frame, monkeypatch):
    monkeypatch.setattr(silence, "FRAME", frame)
    made = events()
    query, out = run(spark, folder, [made[k:k + 150] for k in range(0, len(made), 150)])
    columns = ["series", "minute", "value", "breaching", "breaches", "in_alarm"]
    assert rows(out.select(*columns)) == rows(batch(spark, made).select(*columns))
    stops = out.where("series = 'stops'").agg(F.max("minute"), F.max_by("in_alarm", "minute")).first()
    assert stops[0] > START + timedelta(minutes=180) and stops[1]
    assert len(query.recentProgress) > 3
    assert not any(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def test_a_forgotten_series_ends_and_its_state_goes(spark, folder):
    made = [r for r in events() if r[0] != "gaps"]
    query, out = run(spark, folder, [made[k:k + 100] for k in range(0, len(made), 100)], forget=timedelta(minutes=20))
    last = {r.series: r.m for r in out.groupBy("series").agg(F.max("minute").alias("m")).collect()}
    heard = max(t for s, t, _ in made if s == "stops").replace(second=0)
    assert last["stops"] == heard + timedelta(minutes=20) and last["steady"] > last["stops"]
    assert out.groupBy("series", "minute").count().where("count > 1").count() == 0


def test_late_rows_are_counted_per_batch(spark, folder):
    made = [r for r in events(60) if r[0] == "steady"]
    late = [("steady", START + timedelta(minutes=1), 5.0), ("steady", START + timedelta(minutes=2), 5.0)]
    query, out = run(spark, folder, [made[:100], made[100:], late])
    counted = spark.read.schema(silence.LATE).parquet(f"{folder}/late").collect()
    assert sum(r.n_late for r in counted) == 2 and all(r.watermark for r in counted)
    assert rows(out.select("series", "minute", "value")) == rows(batch(spark, made).select("series", "minute", "value"))
