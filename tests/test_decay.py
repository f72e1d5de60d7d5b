import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureline.streaming.decay import batch_counts, histograms, start_decay_stream, weekly_metrics, with_late_labels
from conftest import rows

START = datetime(2024, 1, 1)
P, L = "id long, predicted_at timestamp_ntz, score double", "id long, labelled_at timestamp_ntz, label boolean"


def run(spark, folder, name, predictions, labels, per_batch):
    """Each list of rows is a file; files come in their order, ``per_batch`` at a time."""
    for kind, schema, parts in (("p", P, predictions), ("l", L, labels)):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}/{kind}")
    stream = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/{name}/{kind}")
    decided = with_late_labels(stream("p", P), stream("l", L), "id", "3 DAYS", "2 days")
    query = start_decay_stream(decided, f"{folder}/{name}/out", f"{folder}/{name}/checkpoint", bins=10)
    query.awaitTermination()
    return query, histograms(spark, f"{folder}/{name}/out")


def data(n=240):
    rng = random.Random(2)
    predictions, labels = [], []
    for k in range(n):
        at = START + timedelta(hours=4 * k)
        predictions.append((k, at, rng.choice([0.05, 0.35, 0.55, 0.95])))
        if rng.random() < 0.7:
            labels.append((k, at + timedelta(hours=rng.choice([0, 30, 72, 73, 200])), rng.random() < 0.4))
    return predictions, sorted(labels, key=lambda r: r[1])


def by_hand(predictions, labels):
    known = {k: (t, v) for k, t, v in labels}
    mark = min(max(t for _, t, _ in predictions), max(t for _, t, _ in labels)) - timedelta(days=2)
    weeks: dict = {}
    for k, at, score in predictions:
        t, v = known.get(k, (None, None))
        if t is None or not at <= t <= at + timedelta(days=3):
            if at + timedelta(days=3) >= mark:
                continue
            v = None
        week = at.replace(hour=0, minute=0) - timedelta(days=at.weekday())
        weeks.setdefault(week, []).append((int(score * 10), v))
    out = []
    for week, found in weeks.items():
        pos, neg = ([b for b, v in found if v is want] for want in (True, False))
        n = len(pos) + len(neg)
        right = sum(b >= 5 for b in pos) + sum(b < 5 for b in neg)
        wide = sum(b >= 5 for b in pos) * 2 + sum(b >= 5 for b in neg) + sum(b < 5 for b in pos)
        area = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
        out.append((week, len(found), n, len(pos), round(right / n, 9), round(2 * sum(b >= 5 for b in pos) / wide, 9) if wide else 0.0,
                    area and round(area, 9)))
    return sorted(out, key=str)


def measured(hist):
    return sorted([(r.week, r.n_predictions, r.n_labelled, r.n_positive, round(r.accuracy, 9), round(r.f1_score, 9),
                    r.roc_auc and round(r.roc_auc, 9)) for r in weekly_metrics(hist, bins=10).collect()], key=str)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_counting_by_hand_for_files_within_the_bound(spark, folder, shuffled):
    predictions, labels = data()
    cut = lambda rows, size: [rows[k:k + size] for k in range(0, len(rows), size)]
    p, l_ = cut(predictions, 30), cut(labels, 25)
    if shuffled:  # neighbours change places: no row is later than two days
        for parts in (p, l_):
            flat = sorted([r for x in parts for r in x], key=lambda r: r[1] + timedelta(hours=random.Random(r[0]).uniform(0, 40)))
            parts[:] = cut(flat, 30)
    query, hist = run(spark, folder, "s", p, l_, per_batch=2)
    assert measured(hist) == by_hand(predictions, labels)
    # Predictions are kept for the wait and the lateness only: five days at six a day, and labels no longer than that.
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] < 2 * 6 * 6 and state["numRowsDroppedByWatermark"] == 0
    assert len(rows(hist)) > 0


def test_no_task_counts_all_partitions(spark, folder):
    """A task keeps the memory of each count that it does until it ends."""
    decided = spark.range(4000).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, id % 50) AS predicted_at",
                                           "id % 100 / 100.0 AS score", "id % 3 = 0 AS label")
    counts = batch_counts(decided)
    assert counts.rdd.getNumPartitions() == 1 and counts.agg(F.sum("n")).first()[0] == 4000
    steps = [x.strip(" +-:") for x in counts._jdf.queryExecution().sparkPlan().toString().splitlines()]
    assert not [x for x in steps if x.startswith("Coalesce")] and steps[0].startswith("Exchange SinglePartition")


def test_nothing_labelled_and_one_class(spark):
    hist = spark.createDataFrame([(START, 1, None, 5), (START + timedelta(days=7), 3, True, 2), (START + timedelta(days=7), 7, True, 1)],
                                 "week timestamp_ntz, bin int, label boolean, n long")
    out = rows(weekly_metrics(hist, bins=10))
    assert out == [(START, 5, 0, 0, None, None, None), (START + timedelta(days=7), 3, 3, 3, 1 / 3, 0.5, None)]
