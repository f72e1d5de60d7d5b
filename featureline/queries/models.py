"""M1 to M12."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession, functions as F

from featureline.functions.exprs import utc_timestamp, wall_clock
from featureline.operators.asof import historical_features
from featureline.operators.linear import linear_weights
from featureline.operators.metrics import standardize
from featureline.operators.model import (ForestConfig, fit_forest, load_model, predict, save_model, score_foreign,
                                         score_rows)
from featureline.operators.registry import (Registry, append, current_aliases, next_versions, resolve,
                                            version_tags)
from featureline.operators.split import stratified_split
from featureline.plans.score import as_predictions, score_models
from featureline.plans.train import TrainConfig, row_key, train_on
from featureline.queries import base as b
from featureline.queries.base import query, table
from featureline.queries.windows import _split_sql
from featureline.session import work_dir
from featureline.sources.catalog import apply_schedules, judge_schedules
from featureline.sources.tables import read_predictions, score_spine, write_predictions, write_table

RUN_AT = datetime(2001, 8, 2, tzinfo=timezone.utc)
FEATURES = tuple(b.CUSTOMER_VIEW.features)
TRAIN = TrainConfig(base="", registry="", views=(b.CUSTOMER_VIEW,))


# The validation rows as SQL, and facts about answers that SQL can state without the model.
_VALIDATION_SQL = f"""
WITH {b.AS_OF_LABELS_SQL},
keyed AS (SELECT *, entity_id || '|' || CAST(event_timestamp AS VARCHAR) AS k FROM training_rows),
split AS ({_split_sql("keyed", "churned", "k")}),
validation AS (SELECT entity_id, keyed.churned FROM keyed JOIN split USING (k) WHERE is_validation)"""

_SPLITS: dict[tuple, str] = {}


def _split(spark: SparkSession, sf: str):
    """Training rows with their split, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPLITS:
        folder = work_dir(spark, "split")
        write_table(b.training_rows(spark, sf), f"{folder}/merged")
        merged = spark.read.parquet(f"{folder}/merged")
        write_table(stratified_split(merged, "churned", row_key(merged)), f"{folder}/split")
        _SPLITS[key] = f"{folder}/split"
    return spark.read.parquet(_SPLITS[key])


_SCALED = ["account_balance", "num_transactions"]


@query("m1_standardize", f"""
WITH {b.CUSTOMER_FEATURES_SQL},
s AS (SELECT avg(account_balance) AS m1, stddev_pop(account_balance) AS d1, avg(num_transactions) AS m2,
             stddev_pop(num_transactions) AS d2 FROM customer_features WHERE event_timestamp < TIMESTAMP '2000-01-01')
SELECT entity_id, event_timestamp, round((account_balance - m1) / d1, 6) AS account_balance,
       round((num_transactions - m2) / d2, 6) AS num_transactions FROM customer_features, s""")
def standardized(spark, sf):
    """Statistics of the earlier rows, applied to all rows."""
    features = b.customer_features(spark, sf)
    early = features.filter(F.col("event_timestamp") < b.ntz("2000-01-01 00:00:00"))
    scaled = standardize(features, early, _SCALED)
    return scaled.select("entity_id", "event_timestamp", *[F.round(c, 6).alias(c) for c in _SCALED])


_MODELS: dict[tuple, str] = {}


def _model_path(spark: SparkSession, sf: str) -> str:
    """A forest fitted on the training part and saved; once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        train = _split(spark, sf).filter(~F.col("is_validation"))
        path = work_dir(spark, "model")
        save_model(fit_forest(train, ForestConfig(FEATURES, "churned")), path)
        _MODELS[key] = path
    return _MODELS[key]


@query("m2_random_forest", f"""
WITH {b.AS_OF_LABELS_SQL},
split AS ({_split_sql("(SELECT *, entity_id || '|' || CAST(event_timestamp AS VARCHAR) AS k FROM training_rows)", "churned", "k")}),
train AS (SELECT t.* FROM training_rows t JOIN split s
  ON s.k = t.entity_id || '|' || CAST(t.event_timestamp AS VARCHAR) WHERE NOT s.is_validation),
inputs AS (SELECT unnest(['age', 'account_balance', 'num_transactions', 'days_since_last_txn']) AS f,
  unnest([count(*) - count(age), count(*) - count(account_balance), count(*) - count(num_transactions),
          count(*) - count(days_since_last_txn)]) AS nulls FROM train)
SELECT f || '__filled' AS input, 100 AS n_trees, true AS importances_sum_to_one FROM inputs
UNION ALL SELECT f || '__missing', 100, true FROM inputs WHERE nulls > 0""")
def forest(spark, sf):
    """Inputs of the fitted forest: a filled column for each feature, an indicator for each that has gaps."""
    model = load_model(_model_path(spark, sf))
    inputs = model.stages[-3].getInputCols()
    importances = model.stages[-1].featureImportances.toArray()
    whole = bool(abs(importances.sum() - 1) < 1e-9 and (importances >= 0).all() and len(importances) == len(inputs))
    return spark.createDataFrame([(n, model.stages[-1].getNumTrees, whole) for n in inputs],
                                 "input string, n_trees int, importances_sum_to_one boolean")


@query("m3_pipeline_round_trip", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM training_rows""")
def pipeline_round_trip(spark, sf):
    """A fitted pipeline before and after it was stored gives the same answers."""
    model = load_model(_model_path(spark, sf))
    path = work_dir(spark, "model-copy")
    save_model(model, path)
    validation = _split(spark, sf).filter("is_validation")
    first = predict(model, validation).select("entity_id", F.col("probability").alias("p1"))
    second = predict(load_model(path), validation).select("entity_id", F.col("probability").alias("p2"))
    return first.join(second, "entity_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.count_if(F.col("p1") != F.col("p2")).alias("n_different"))


@query("m4_predict_class", f"{_VALIDATION_SQL} SELECT entity_id, churned, true AS is_class FROM validation")
def predict_class(spark, sf):
    """Every validation row gets one of the two classes."""
    validation = _split(spark, sf).filter("is_validation")
    return predict(load_model(_model_path(spark, sf)), validation).select(
        "entity_id", "churned", F.col("prediction").isin(0.0, 1.0).alias("is_class"))


@query("m5_predict_probability", f"{_VALIDATION_SQL} SELECT entity_id, churned, true AS in_unit_range FROM validation")
def predict_probability(spark, sf):
    """Every validation row gets a probability."""
    validation = _split(spark, sf).filter("is_validation")
    return predict(load_model(_model_path(spark, sf)), validation).select(
        "entity_id", "churned", F.col("probability").between(0, 1).alias("in_unit_range"))


@query("m5_class_follows_probability", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_different
FROM training_rows""")
def class_follows_probability(spark, sf):
    """The class is the one with the larger probability, and probabilities lie in [0, 1]."""
    scored = predict(load_model(_model_path(spark, sf)), _split(spark, sf).filter("is_validation"))
    p = F.col("probability")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~p.between(0, 1)).alias("n_outside"),
                      F.count_if(F.col("prediction") != (p > 0.5).cast("double")).alias("n_different"))


def _scoring_rows(spark, sf):
    spine = score_spine(table(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_id"),
                        RUN_AT, b.NTZ)
    return historical_features(spine, b.CUSTOMER_FEATURE_REFS, (b.CUSTOMER_VIEW,),
                               {"customer_features": b.customer_features(spark, sf)}, time_range=(RUN_AT, RUN_AT))


@query("m6_batch_scoring", """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'models:/churn_model@champion' AS model_uri, CAST(1 AS BIGINT) AS model_version,
  TIMESTAMP '2001-08-02' AS predicted_at, true AS is_class FROM customer""")
def batch_scoring(spark, sf):
    """Every customer scored with the stored model, written as NDJSON and read back."""
    scored = score_rows(load_model(_model_path(spark, sf)), _scoring_rows(spark, sf))
    rows = as_predictions(scored, "models:/churn_model@champion", 1, RUN_AT)
    folder = write_predictions(rows, work_dir(spark, "predictions"), "churn_model", RUN_AT)
    return read_predictions(spark, folder).select(
        "entity_id", "model_uri", "model_version", wall_clock(F.col("predicted_at")).alias("predicted_at"),
        F.col("score").isin(0.0, 1.0).alias("is_class"))


def _linear_model():
    """Stands for a model that is not Spark's: a fixed formula over a pandas batch."""
    return lambda batch: (batch["num_transactions"].fillna(0) * 0.5 - batch["account_balance"].fillna(0) * 0.25)


@query("m6_foreign_model", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT entity_id, event_timestamp, num_transactions * 0.5::DOUBLE - account_balance * 0.25::DOUBLE AS score
FROM customer_features""")
def foreign_model(spark, sf):
    rows = b.customer_features(spark, sf).select("entity_id", "event_timestamp", "num_transactions", "account_balance")
    return score_foreign(rows, _linear_model, ["num_transactions", "account_balance"]).select(
        "entity_id", "event_timestamp", "score")


@query("m7_experiment_log", f"""
WITH {b.TRAINING_RUNS_SQL}
SELECT run_id, name AS experiment, CAST(n_rows AS VARCHAR) AS n_train, round(f1_score, 6) AS f1_score, created_at
FROM training_runs""")
def experiment_log(spark, sf):
    """Runs appended to the run table with their params and metrics, and queried back."""
    folder = work_dir(spark, "runs")
    runs = b.training_runs(spark, sf).select(
        "run_id", F.col("name").alias("experiment"), utc_timestamp(F.col("created_at")).alias("started_at"),
        F.create_map(F.lit("n_train"), F.col("n_rows").cast("string")).alias("params"),
        F.create_map(F.lit("f1_score"), F.col("f1_score")).alias("metrics"),
        F.create_map(F.lit("model_name"), F.col("name")).alias("tags"), F.lit(None).cast("string").alias("artifact"))
    registry = Registry(spark, folder)
    append(runs, registry.path("runs"))
    return registry.read("runs").select(
        "run_id", "experiment", F.col("params")["n_train"].alias("n_train"),
        F.round(F.col("metrics")["f1_score"], 6).alias("f1_score"),
        wall_clock(F.col("started_at")).alias("created_at"))


def _versions(spark, sf):
    """Runs before 1999 are registered already; the others come as one batch."""
    runs = b.training_runs(spark, sf)
    cut = b.ntz("1999-01-01 00:00:00")
    nothing = spark.createDataFrame([], "name string, version long")
    earlier = next_versions(nothing, runs.filter(F.col("created_at") < cut), ["created_at"])
    later = next_versions(earlier.select("name", "version"), runs.filter(F.col("created_at") >= cut), ["created_at"])
    return earlier.unionByName(later)


_VERSIONS_SQL = b.TRAINING_RUNS_SQL + """,
versions AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at) AS version FROM training_runs)"""


@query("m8_register_versions", f"""
WITH {_VERSIONS_SQL}
SELECT name, version, run_id, created_at, CAST(round_even(CAST(f1_score AS DECIMAL(20,12)), 4) AS DOUBLE) AS f1_score
FROM versions""")
def register_versions(spark, sf):
    versions = _versions(spark, sf).withColumn("tags", version_tags(
        F.col("run_id"), F.col("f1_score"), F.col("roc_auc")))
    return versions.select("name", "version", F.col("tags")["run_id"].alias("run_id"), "created_at",
                           F.col("tags")["f1_score"].cast("double").alias("f1_score"))


def _aliases(spark, sf):
    return _versions(spark, sf).select("name", F.lit("champion").alias("alias"), "version",
                                       F.col("created_at").alias("set_at"))


@query("m9_current_alias", f"""
WITH {_VERSIONS_SQL}
SELECT name, 'champion' AS alias, max(version) AS version, max(created_at) AS set_at FROM versions GROUP BY name""")
def current_alias(spark, sf):
    """Every run moved the alias to its version; the last one counts."""
    return current_aliases(_aliases(spark, sf))


@query("m10_resolve_champion", f"""
WITH {_VERSIONS_SQL}
SELECT name, 'models:/' || name || '@champion' AS model_uri, version, run_id, 'runs/' || run_id AS source FROM versions
QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1""")
def resolve_champion(spark, sf):
    versions = _versions(spark, sf).withColumn("source", F.concat(F.lit("runs/"), F.col("run_id")))
    return resolve(_aliases(spark, sf), versions)


_SCHEDULE_SQL = f"""
WITH {b.CATALOG_SQL},
updates AS (SELECT 'model-' || CAST(o_custkey AS VARCHAR) AS model_name,
    CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'rate(1 day)' END AS cron_schedule FROM orders GROUP BY 1),
champions AS (SELECT DISTINCT 'model-' || CAST(o_custkey AS VARCHAR) AS name FROM orders WHERE o_orderstatus = 'F'),
judged AS (SELECT u.model_name, u.cron_schedule,
    CASE WHEN c.model_name IS NULL THEN 'unknown_model' WHEN u.cron_schedule IS NULL THEN 'cleared'
         WHEN h.name IS NULL THEN 'no_champion' ELSE 'set' END AS status
  FROM updates u LEFT JOIN catalog c ON c.model_name = u.model_name LEFT JOIN champions h ON h.name = u.model_name)"""


def _judged(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "model_name", F.concat(F.lit("model-"), F.col("o_custkey").cast("string")))
    updates = orders.groupBy("model_name").agg(
        F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), F.lit("rate(1 day)")).alias("cron_schedule"))
    champions = orders.filter("o_orderstatus = 'F'").select(F.col("model_name").alias("name")).distinct()
    return judge_schedules(b.catalog_rows(spark, sf), updates, champions)


@query("m10_judge_schedules", _SCHEDULE_SQL + " SELECT * FROM judged")
def schedules_judged(spark, sf):
    """Scheduling needs a champion; clearing does not."""
    return _judged(spark, sf)


@query("m10_apply_schedules", _SCHEDULE_SQL + """
SELECT c.model_name, c.owner, c.is_active,
  CASE WHEN j.status IN ('set', 'cleared') THEN TIMESTAMP '2001-08-02' ELSE c.updated_at END AS updated_at,
  CASE WHEN j.status IN ('set', 'cleared') THEN j.cron_schedule ELSE c.cron_schedule END AS cron_schedule
FROM catalog c LEFT JOIN judged j ON j.model_name = c.model_name""")
def schedules_applied(spark, sf):
    return apply_schedules(b.catalog_rows(spark, sf), _judged(spark, sf), b.ntz("2001-08-02 00:00:00"))


@query("m11_catalog_scoring", """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, name AS model_name, 'models:/' || name || '@champion' AS model_uri,
  CAST(1 AS BIGINT) AS model_version, TIMESTAMP '2001-08-02' AS predicted_at, true AS in_unit_range
FROM customer, (SELECT unnest(['churn_model', 'retention_model']) AS name) WHERE name = 'churn_model' OR c_acctbal >= 0""")
def catalog_scoring(spark, sf):
    """Two models with their own spines go through one point-in-time join; the group's predictions are kept as a table."""
    path = _model_path(spark, sf)
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_id")
    spines = {
        "churn_model": score_spine(customers, RUN_AT, b.NTZ),
        "retention_model": score_spine(customers.filter("c_acctbal >= 0"), RUN_AT, b.NTZ),
    }
    refs = ",".join(b.CUSTOMER_FEATURE_REFS)
    rows = [{"model_name": name, "feature_refs": refs} for name in spines]
    champions = {name: {"source": path, "model_uri": f"models:/{name}@champion", "version": 1} for name in spines}
    scored = score_models(rows, spines.__getitem__, champions, (b.CUSTOMER_VIEW,),
                          {"customer_features": b.customer_features(spark, sf)}, RUN_AT, work_dir(spark, "scoring"),
                          spine_time=(RUN_AT, RUN_AT), output="probability")
    return scored.select("entity_id", "model_name", "model_uri", "model_version",
                         wall_clock(F.col("predicted_at")).alias("predicted_at"), F.col("score").between(0, 1).alias("in_unit_range"))


_TWO = ("account_balance", "num_transactions")
_LINEAR_SQL = _VALIDATION_SQL + """,
means AS (SELECT avg(account_balance) AS m1, avg(num_transactions) AS m2 FROM keyed JOIN split USING (k) WHERE NOT is_validation),
filled AS (SELECT is_validation, CAST(keyed.churned AS INTEGER)::DOUBLE AS y, coalesce(account_balance, m1) AS x1, coalesce(num_transactions, m2) AS x2
  FROM keyed JOIN split USING (k), means),
centre AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay FROM filled WHERE NOT is_validation),
sums AS (SELECT sum((x1 - a1) * (x1 - a1)) AS s11, sum((x1 - a1) * (x2 - a2)) AS s12, sum((x2 - a2) * (x2 - a2)) AS s22,
  sum((x1 - a1) * (y - ay)) AS s1y, sum((x2 - a2) * (y - ay)) AS s2y FROM filled, centre WHERE NOT is_validation),
weights AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM sums),
model AS (SELECT w1, w2, ay - w1 * a1 - w2 * a2 AS w0 FROM weights, centre)"""


@query("r8_linear_weights", f"""
{_LINEAR_SQL}
SELECT 'account_balance' AS feature, round(w1, 12) AS weight FROM model UNION ALL SELECT 'num_transactions', round(w2, 9) FROM model
UNION ALL SELECT 'intercept', round(w0, 9) FROM model""")
def linear_model_weights(spark, sf):
    """The weights of the second kind of model, against the closed form for two features."""
    weights, intercept, _ = linear_weights(_split(spark, sf).filter("NOT is_validation"), _TWO, "churned")
    made = [("account_balance", round(weights["account_balance"], 12)), ("num_transactions", round(weights["num_transactions"], 9)),
            ("intercept", round(intercept, 9))]
    return spark.createDataFrame(made, "feature string, weight double")


@query("m12_linear_train_job", f"""
{_LINEAR_SQL},
scored AS (SELECT y = 1 AS t, least(greatest(w0 + w1 * x1 + w2 * x2, 0), 1) AS p FROM filled, model WHERE is_validation),
c AS (SELECT count(*) AS n, count(*) FILTER (t AND p > 0.5) AS tp, count(*) FILTER (NOT t AND p > 0.5) AS fp, count(*) FILTER (t AND p <= 0.5) AS fn FROM scored),
ranks AS (SELECT t, rank() OVER (ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY round(p, 12)) - 1) / 2.0::DOUBLE AS r FROM scored),
a AS (SELECT count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg, sum(r) FILTER (t) AS ranks FROM ranks)
SELECT 'LeastSquares' AS model_class, (SELECT count(*) FROM filled WHERE NOT is_validation) AS n_train, n AS n_validation, CAST(1 AS BIGINT) AS version,
  round((n - fp - fn) / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score,
  round((ranks - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg), 6) AS roc_auc FROM c, a""")
def train_linear(spark, sf):
    """The same job with the second kind of model; the logged metrics are those that SQL works out from the closed form."""
    folder = work_dir(spark, "registry")
    refs = tuple(f"customer_features:{c}" for c in _TWO)
    cfg = TrainConfig(base=sf, registry=folder, views=(b.CUSTOMER_VIEW,), refs=refs, kind="linear", model_name=f"linear_{uuid.uuid4().hex[:6]}")
    train_on(spark, b.train_entities(spark, sf), b.churn_labels(spark, sf), {"customer_features": b.customer_features(spark, sf)}, cfg)
    registry = Registry(spark, folder)
    runs = registry.read("runs").select(
        "run_id", F.col("params")["model_class"].alias("model_class"), F.col("params")["n_train"].cast("long").alias("n_train"),
        F.col("params")["n_val"].cast("long").alias("n_validation"),
        *(F.round(F.col("metrics")[c], 6).alias(c) for c in ("accuracy", "f1_score", "roc_auc")))
    return runs.join(registry.champions().select("run_id", "version"), "run_id").drop("run_id")


@query("m12_train_job", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT (SELECT count(*) FROM as_of_labels) AS n_features, (SELECT count(*) FROM churn_labels) AS n_labels, count(*) AS n_merged,
  count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_train, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_validation,
  CAST(1 AS BIGINT) AS version, true AS metrics_in_range FROM training_rows""")
def train_end_to_end(spark, sf):
    """Join, split, fit, evaluate, log, register and promote; returns the logged run."""
    folder = work_dir(spark, "registry")
    cfg = TrainConfig(base=sf, registry=folder, views=(b.CUSTOMER_VIEW,), model_name=f"churn_{uuid.uuid4().hex[:6]}")
    train_on(spark, b.train_entities(spark, sf), b.churn_labels(spark, sf),
             {"customer_features": b.customer_features(spark, sf)}, cfg)
    registry = Registry(spark, folder)
    runs = registry.read("runs").select(
        "run_id", *(F.col("params")[n].cast("long").alias(n) for n in ("n_features", "n_labels", "n_merged", "n_train")),
        F.col("params")["n_val"].cast("long").alias("n_validation"),
        F.forall(F.map_values("metrics"), lambda x: x.between(0, 1)).alias("metrics_in_range"))
    return runs.join(registry.champions().select("run_id", "version"), "run_id").drop("run_id")
