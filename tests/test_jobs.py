"""Generate, check, train, score and read back, on 200 synthetic customers."""

from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from featureline.errors import ChampionMissing, EmptyDataset, InvalidRows
from featureline.operators.model import columns_with_nulls, load_model, score_foreign, score_rows
from featureline.operators.registry import Registry
from featureline.plans import score
from featureline.plans.publish import check, generate, materialize
from featureline.plans.score import ScoreConfig, score_catalog, score_job
from featureline.plans.train import TrainConfig, train_job
from featureline.schema import CUSTOMER_FEATURE_REFS, CUSTOMER_FEATURES
from featureline.sources.tables import FEATURES_DIR, read_predictions, score_entities_file, write_table

NOW = datetime(2026, 1, 15, tzinfo=timezone.utc)
REFS = ",".join(CUSTOMER_FEATURE_REFS)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("base"))
    generate(spark, folder, 200, NOW)
    return folder


@pytest.fixture(scope="module")
def trained(spark, base):
    cfg = TrainConfig(base=base, registry=f"{base}/registry", num_trees=20, max_depth=5)
    return train_job(spark, cfg, NOW)


def test_published_features_pass_the_checks(spark, base):
    leakage, complete = check(spark, base)
    one = leakage.first()
    assert (int(one["n_pairs"]), int(one["n_leaking"]), one["passed"]) == (200, 0, True)
    shape = complete.first()
    assert (shape["n_rows"], shape["n_columns"], shape["complete"]) == (200, 6, True)


def test_generated_ranges(spark, base):
    f = spark.read.parquet(f"{base}/{FEATURES_DIR}")
    age = F.unix_seconds(F.lit(NOW)) - F.unix_seconds("event_timestamp")
    low, high = f.select((age / 86400).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert low >= 7 and high < 91
    assert f.filter(~F.col("age").between(18, 74) | ~F.col("account_balance").between(0, 50000)
                    | ~F.col("num_transactions").between(0, 499)
                    | ~F.col("days_since_last_txn").between(0, 364)).count() == 0
    assert f.filter(F.col("entity_id") == "cust-0007").count() == 1


def test_generation_does_not_depend_on_partitioning(spark):
    from featureline.sources import synth

    one = synth.generate_features(spark.range(50).withColumnRenamed("id", "n"), NOW)
    two = synth.generate_features(spark.range(0, 50, 1, 13).withColumnRenamed("id", "n"), NOW)
    assert rows(one) == rows(two)


def test_materialize_publishes_every_customer(spark, base):
    assert materialize(spark, base, NOW).count() == 200


def test_training_registers_a_champion(spark, base, trained):
    assert (trained.n_train, trained.n_validation) == (160, 40)
    assert trained.model_uri == "models:/churn_model@champion"
    assert 0 <= trained.metrics["accuracy"] <= 1 and 0 <= trained.metrics["roc_auc"] <= 1
    registry = Registry(spark, f"{base}/registry")
    assert registry.champion("churn_model")["run_id"] == trained.run_id
    run = registry.read("runs").filter(F.col("run_id") == trained.run_id).first()
    assert run["params"]["n_estimators"] == "20" and run["params"]["features"].startswith("age,account_balance")
    assert abs(run["metrics"]["f1_score"] - trained.metrics["f1_score"]) < 1e-12
    profile = registry.read("run_inputs").filter(F.col("run_id") == trained.run_id)
    assert profile.count() == 7 and profile.first()["n_rows"] == 200


def test_scoring_writes_a_new_folder_per_run(spark, base, trained):
    cfg = ScoreConfig(base, f"{base}/registry", "churn_model", REFS)
    first = score_job(spark, cfg, NOW)
    second = score_job(spark, cfg, NOW + timedelta(days=1))
    assert first != second
    out = read_predictions(spark, first)
    assert out.count() == 200 and out.filter("score not in (0.0, 1.0)").count() == 0
    assert out.select("model_uri", "model_version").distinct().collect() == [("models:/churn_model@champion", trained.version)]
    assert out.select(F.unix_seconds("predicted_at")).distinct().first()[0] == int(NOW.timestamp())


def test_probability_output(spark, base, trained):
    cfg = ScoreConfig(base, f"{base}/registry", "churn_model", REFS, output="probability",
                      predictions=f"{base}/probabilities")
    out = read_predictions(spark, score_job(spark, cfg, NOW))
    low, high, n = out.agg(F.min("score"), F.max("score"), F.countDistinct("score")).first()
    assert 0 <= low < high <= 1 and n > 2


def test_scoring_without_champion_is_refused(spark, base):
    cfg = ScoreConfig(base, f"{base}/no-registry", "churn_model", REFS)
    with pytest.raises(ChampionMissing):
        score_job(spark, cfg, NOW)


def test_catalog_scoring_covers_models_with_a_champion(spark, base, trained):
    registry = Registry(spark, f"{base}/registry")
    version = registry.register("second_model", trained.run_id, trained.artifact, 0.5, 0.5, NOW)
    registry.set_alias("second_model", "champion", version, NOW)
    write_table(spark.createDataFrame([("cust-0001",), ("cust-0002",), ("nobody",)], "entity_id string"),
                f"{base}/{score_entities_file('second_model')}")
    catalog = spark.createDataFrame([("churn_model", REFS), ("second_model", REFS), ("untrained", REFS)],
                                    "model_name string, feature_refs string")
    out = spark.read.json(score_catalog(spark, catalog, base, f"{base}/registry", NOW))
    # An entity without any feature row is scored too, with the medians of the training rows.
    assert rows(out.groupBy("model_name").count()) == [("churn_model", 200), ("second_model", 3)]
    assert out.filter("score is null").count() == 0


def test_no_plan_grows_with_the_catalog(spark, base, trained, monkeypatch):
    names = [f"m{k}" for k in range(5)]
    registry = Registry(spark, f"{base}/registry")
    source = registry.champion("churn_model")["source"]
    for name in names:
        registry.set_alias(name, "champion", registry.register(name, "r", source, None, None, NOW), NOW)
        write_table(spark.createDataFrame([(f"cust-000{k}",) for k in range(1, 4)], "entity_id string"), f"{base}/{score_entities_file(name)}")
    sizes, one = [], score._score_group
    monkeypatch.setattr(score, "_score_group", lambda rows_, *more: sizes.append(len(rows_)) or one(rows_, *more))
    catalog = spark.createDataFrame([(n, REFS) for n in names], "model_name string, feature_refs string")
    apart = spark.read.json(score_catalog(spark, catalog, base, f"{base}/registry", NOW, group=2))
    assert sizes == [2, 2, 1]
    together = spark.read.json(score_catalog(spark, catalog, base, f"{base}/registry", NOW))
    assert rows(apart, "model_name", "entity_id", "score") == rows(together, "model_name", "entity_id", "score") and apart.count() == 15
    none = score_catalog(spark, catalog.limit(0), base, f"{base}/registry", NOW)
    assert read_predictions(spark, none).count() == 0


def test_empty_join_stops_training(spark, base, folder):
    generate(spark, folder, 20, NOW)
    other = spark.createDataFrame([("nobody", NOW)], "entity_id string, event_timestamp timestamp")
    other.write.mode("overwrite").parquet(f"{folder}/offline/entities/train_entities.parquet")
    with pytest.raises(EmptyDataset):
        train_job(spark, TrainConfig(base=folder, registry=f"{folder}/registry"), NOW)


def test_bad_spine_row_stops_training(spark, folder):
    generate(spark, folder, 20, NOW)
    bad = spark.createDataFrame([("cust-0001", None)], "entity_id string, event_timestamp timestamp")
    bad.write.mode("append").parquet(f"{folder}/offline/entities/train_entities.parquet")
    with pytest.raises(InvalidRows):
        train_job(spark, TrainConfig(base=folder, registry=f"{folder}/registry"), NOW)


def test_nulls_are_imputed_with_indicators(spark):
    from featureline.operators.model import ForestConfig, fit_forest

    df = spark.createDataFrame([(float(i), None if i % 3 == 0 else float(i % 7), i % 2 == 0) for i in range(60)],
                               "x double, y double, churned boolean")
    assert columns_with_nulls(df, ["x", "y"]) == ["y"]
    model = fit_forest(df, ForestConfig(("x", "y"), "churned", num_trees=5, max_depth=3))
    assert model.stages[-3].getInputCols() == ["x__filled", "y__filled", "y__missing"]
    assert score_rows(model, df).filter("score is null").count() == 0


def test_model_round_trip(spark, base, trained):
    model = load_model(trained.artifact)
    f = spark.read.parquet(f"{base}/{FEATURES_DIR}").select("entity_id", *CUSTOMER_FEATURES.features)
    assert score_rows(model, f).columns == ["entity_id", *CUSTOMER_FEATURES.features, "score"]
    with pytest.raises(ValueError):
        score_rows(model, f, "logit")


def test_foreign_model_is_loaded_per_task(spark):
    def load():
        return lambda batch: batch["x"] * 2

    df = spark.range(10).select(F.col("id").alias("x"))
    assert rows(score_foreign(df, load, ["x"]), "score") == sorted([(float(i * 2),) for i in range(10)], key=str)
