"""The linear kind of model, and the gate in the training job."""

import math
import random
from dataclasses import replace
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.errors import PySparkException

from featureline.operators.linear import fit_linear, linear_weights
from featureline.operators.model import load_model, predict, save_model, score_rows
from featureline.operators.profile import dataset_profile
from featureline.operators.registry import Registry
from featureline.plans.publish import generate
from featureline.plans.train import TrainConfig, train_job

NOW = datetime(2026, 1, 15, tzinfo=timezone.utc)
FEATURES = ["a", "b c", "d"]


def data(n=300):
    rng = random.Random(6)
    return [(rng.gauss(1e6, 3), rng.choice([None, float("nan"), rng.random()]), rng.randint(0, 9), rng.random() < 0.4) for _ in range(n)]


def numpy_weights(made):
    x = np.array([[np.nan if v is None else float(v) for v in r[:3]] for r in made])
    means = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), means, x)
    y = np.array([float(r[3]) for r in made])
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    return w, y.mean() - w @ x.mean(0), x, means


def test_weights_equal_least_squares_in_any_partitioning(spark, folder):
    made = data()
    df = spark.createDataFrame(made, "a double, `b c` double, d int, y boolean")
    w, w0, x, means = numpy_weights(made)
    for parts in (1, 7):
        weights, intercept, filled = linear_weights(df.repartition(parts), FEATURES, "y")
        assert all(math.isclose(weights[c], v, rel_tol=1e-6) for c, v in zip(FEATURES, w)) and math.isclose(intercept, w0, rel_tol=1e-6)
        assert math.isclose(filled["b c"], means[1])
    model = fit_linear(df, FEATURES, "y")
    save_model(model, f"{folder}/m")
    out = predict(load_model(f"{folder}/m"), df).collect()
    want = sorted(np.clip(w0 + x @ w, 0, 1))
    assert np.allclose(sorted(r.probability for r in out), want, atol=1e-6)
    assert all(r.prediction == float(r.probability > 0.5) for r in out)


def test_dependent_constant_and_missing_features(spark):
    made = [(float(k), 2.0 * k, 5, k >= 10) for k in range(20)]
    df = spark.createDataFrame(made, "a double, `b c` double, d int, y boolean")
    weights, _, _ = linear_weights(df, FEATURES, "y")
    assert weights["d"] == 0 and all(map(math.isfinite, weights.values()))
    nothing = linear_weights(df.limit(0), FEATURES, "y")
    assert nothing[0] == dict.fromkeys(FEATURES, 0.0)
    strict = fit_linear(df, FEATURES, "y", missing="fail")
    lacking = spark.createDataFrame([(None, 1.0, 5, True)], df.schema)
    assert score_rows(fit_linear(df, FEATURES, "y"), lacking, "probability").first().score is not None
    with pytest.raises(PySparkException):
        score_rows(strict, lacking).collect()


def test_the_same_job_trains_both_kinds_and_the_gate_decides(spark, folder):
    generate(spark, folder, 300, NOW)
    forest = TrainConfig(base=folder, registry=f"{folder}/registry", num_trees=5, max_depth=4, gate=True)
    first = train_job(spark, forest, NOW)
    assert first.promoted  # there was no champion
    # The same rows and seed give the same model, which is no better.
    again = train_job(spark, forest, NOW.replace(hour=1))
    assert not again.promoted and again.version == 2
    linear = train_job(spark, replace(forest, kind="linear", gate=False), NOW.replace(hour=2))
    assert linear.promoted and linear.version == 3
    registry = Registry(spark, f"{folder}/registry")
    assert registry.champion("churn_model")["version"] == 3
    kinds = {r.run_id: r.params["model_class"] for r in registry.read("runs").collect()}
    assert kinds[linear.run_id] == "LeastSquares" and kinds[first.run_id] == "RandomForestClassifier"
    assert 0 <= linear.metrics["roc_auc"] <= 1


def test_digest_tells_values_and_columns_apart(spark):
    digest = lambda rows, schema="x string, y string": dataset_profile(spark.createDataFrame(rows, schema), "d", "s", "t").first().digest
    forms = [[("a", "b")], [("ab", "")], [("", "ab")], [("a", None)], [(None, "a")], [("n", "b")], [("a", "b"), ("a", "b")], [("1:a", "")]]
    assert len({digest(f) for f in forms}) == len(forms)
    assert digest([("a", "b"), ("c", None)]) == digest([("c", None), ("a", "b")])
    assert digest([]) == "0-0"
