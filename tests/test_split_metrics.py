import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from featureline.operators.metrics import classification_metrics, roc_auc, scaler_statistics, standardize
from featureline.operators.split import stratified_split, validation_quota


def data(spark, n=1000, classes=3):
    return spark.range(n).select(F.col("id"), (F.col("id") * 7 % classes).alias("c"))


def test_quota_is_exact_and_by_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 11), ("c", 5)], "c string, n long")
    got = dict(rows(validation_quota(counts, "c", 0.2), "c", "n_validation"))
    # ceil(0.2 * 23) = 5; exact shares 1.52, 2.39, 1.09: the one left over goes to a.
    assert got == {"a": 2, "b": 2, "c": 1}


@pytest.mark.parametrize("max_tied", [1_000_000, 3])
def test_split_is_exact_per_class_and_stable(spark, max_tied):
    df = data(spark)
    first = rows(stratified_split(df, "c", "id", max_tied=max_tied))
    for parts in (1, 13):
        assert rows(stratified_split(df.repartition(parts), "c", "id", max_tied=max_tied)) == first
    assert sum(r[2] for r in first) == 200
    quota = dict(rows(validation_quota(df.groupBy("c").agg(F.count("*").alias("n")), "c", 0.2), "c", "n_validation"))
    for c, k in quota.items():
        assert sum(1 for r in first if r[1] == c and r[2]) == k


def test_split_follows_the_seeded_hash(spark):
    import hashlib

    got = {r[0]: r[2] for r in rows(stratified_split(data(spark, 50, 1), "c", "id"))}
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert {i for i, v in got.items() if v} == set(order[:10])


def test_other_seed_other_rows(spark):
    a, b = (rows(stratified_split(data(spark, 200, 2), "c", "id", seed=s)) for s in (1, 2))
    assert a != b


@pytest.mark.parametrize("max_tied", [1_000_000, 5])
def test_copies_of_one_key_are_split_exactly(spark, max_tied):
    """Most rows carry the same key."""
    df = spark.range(300).select(F.when(F.col("id") < 250, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                 (F.col("id") % 2 == 0).alias("label"), "id")
    out = stratified_split(df, "label", "k", max_tied=max_tied).cache()
    assert out.count() == 300 and out.select("id").distinct().count() == 300
    assert rows(out.groupBy("label").agg(F.count_if("is_validation"))) == [(False, 30), (True, 30)]


def test_null_label_is_a_class(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 20, F.lit(1)).alias("c"))
    out = stratified_split(df, "c", "id")
    assert rows(out.groupBy("c").agg(F.count_if("is_validation"))) == [(1, 4), (None, 4)]


def test_empty_split(spark):
    assert stratified_split(data(spark, 0), "c", "id").count() == 0


def brute_auc(pairs):
    pos = [s for t, s in pairs if t]
    neg = [s for t, s in pairs if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_scores", [3, 40, 100_000])
@pytest.mark.parametrize("levels", [3, 10_000])
def test_auc_equals_all_pairs(spark, range_scores, levels):
    rng = random.Random(levels)
    pairs = [(rng.random() < 0.3, rng.randrange(levels) / levels) for _ in range(300)]
    df = spark.createDataFrame(pairs, "t boolean, s double")
    out = roc_auc(df, "t", "s", range_scores=range_scores).first()
    assert math.isclose(out["roc_auc"], brute_auc(pairs), rel_tol=1e-12)
    assert not out["one_class"]


def test_auc_signed_zero_is_one_score(spark):
    df = spark.createDataFrame([(True, 0.0), (False, -0.0)], "t boolean, s double")
    assert roc_auc(df, "t", "s").first()["roc_auc"] == 0.5


@pytest.mark.parametrize("truth", [True, False])
def test_auc_of_one_class_is_null_and_flagged(spark, truth):
    df = spark.createDataFrame([(truth, 0.1), (truth, 0.4)], "t boolean, s double")
    out = roc_auc(df, "t", "s").first()
    assert out["roc_auc"] is None and out["one_class"]


def test_auc_of_nothing(spark):
    out = roc_auc(spark.createDataFrame([], "t boolean, s double"), "t", "s").first()
    assert out["roc_auc"] is None and out["n_positive"] == 0


def test_accuracy_and_binary_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "t int, p int")
    out = classification_metrics(df, "t", "p").first()
    assert (out["tp"], out["fp"], out["fn"], out["tn"]) == (1, 1, 1, 2)
    assert out["accuracy"] == 0.6 and out["f1_score"] == 0.5


def test_f1_without_positives_is_zero(spark):
    out = classification_metrics(spark.createDataFrame([(0, 0)], "t int, p int"), "t", "p").first()
    assert out["f1_score"] == 0.0 and out["accuracy"] == 1.0


def test_scaler_statistics_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "x double, y long")
    pop = {r["feature"]: r for r in scaler_statistics(df, ["x", "y"]).collect()}
    assert math.isclose(pop["x"]["deviation"], math.sqrt(14 / 9)) and pop["y"]["deviation"] == 0
    sample = scaler_statistics(df, ["x"], ddof=1).first()
    assert math.isclose(sample["deviation"], math.sqrt(7 / 3))
    scaled = standardize(df, df, ["x", "y"])
    assert [r["y"] for r in scaled.collect()] == [0.0, 0.0, 0.0]
