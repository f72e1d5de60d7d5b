"""Training job: spine, features as of each label, split, fit, metrics, registration."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from featureline.functions.exprs import is_missing, wall_clock
from featureline.operators import skew
from featureline.operators.asof import historical_features
from featureline.operators.gate import compare_models
from featureline.operators.keyed import inner_join
from featureline.operators.linear import fit_linear
from featureline.operators.metrics import classification_metrics, roc_auc
from featureline.operators.model import ForestConfig, fit_forest, load_model, predict, save_model
from featureline.operators.profile import dataset_profile, input_example, row_counts
from featureline.operators.quality import apply_missing_policy, not_empty
from featureline.operators.registry import CHAMPION, Registry
from featureline.operators.split import stratified_split
from featureline.schema import CUSTOMER_FEATURE_REFS, CUSTOMER_FEATURES, ENTITY_ID, EVENT_TIMESTAMP, FeatureView
from featureline.schema import parse_refs
from featureline.session import remove_folder, work_dir
from featureline.sources.snapshots import Snapshots
from featureline.sources.tables import (FEATURES_DIR, LABELS_FILE, OFFLINE, TRAIN_ENTITIES_FILE, label_scan, read_labels, read_training_spine,
                                        read_view, training_spine, view_rows)

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class TrainConfig:
    """``base`` holds the offline folders, ``registry`` the run and model tables and the artifacts. ``kind`` names the fitter. With ``gate`` a
    version becomes champion only if it beats the present one on this run's validation rows. With ``snapshots`` (a folder that keeps them)
    the job reads a snapshot of ``base``/offline and logs its id: the one named ``snapshot``, which repeats an earlier run, or a new one."""

    base: str
    registry: str
    model_name: str = "churn_model"
    experiment: str = "training"
    label: str = "churned"
    refs: tuple[str, ...] = tuple(CUSTOMER_FEATURE_REFS)
    views: tuple[FeatureView, ...] = (CUSTOMER_FEATURES,)
    view_paths: dict[str, str] = field(default_factory=dict)
    share: float = 0.2
    seed: int = 42
    num_trees: int = 100
    max_depth: int = 10
    max_bins: int = 32
    missing: str = "impute"
    partitions: int = 32
    allow_exact: bool = False
    bucket: timedelta | None = skew.BUCKET
    kind: str = "forest"
    gate: bool = False
    snapshots: str | None = None
    snapshot: str | None = None


def _fit_forest(train: DataFrame, features: list[str], cfg: TrainConfig) -> PipelineModel:
    return fit_forest(train, ForestConfig(tuple(features), cfg.label, cfg.num_trees, cfg.max_depth, cfg.max_bins,
                                          cfg.seed, cfg.missing, cfg.partitions))


def _fit_linear(train: DataFrame, features: list[str], cfg: TrainConfig) -> PipelineModel:
    return fit_linear(train, features, cfg.label, cfg.missing)


#: Kinds of models: the name that is logged, and training rows, features and settings to a pipeline with class and probability.
KINDS = {"forest": ("RandomForestClassifier", _fit_forest), "linear": ("LeastSquares", _fit_linear)}


@dataclass(frozen=True)
class TrainResult:
    run_id: str
    version: int
    artifact: str
    model_uri: str
    metrics: dict[str, float | None]
    n_train: int
    n_validation: int
    n_features: int = 0
    n_labels: int = 0
    n_merged: int = 0
    n_incomplete: int = 0
    promoted: bool = True


def view_tables(spark: SparkSession, views, base: str, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Each view from its own path, its declared source, or the usual folder below ``base``."""
    def location(view: FeatureView) -> str:
        default = FEATURES_DIR if view.name == CUSTOMER_FEATURES.name else f"offline/{view.name}"
        return paths.get(view.name) or view.source or f"{base}/{default}"

    return {view.name: read_view(spark, view, location(view)) for view in views}


def training_set(spine: DataFrame, labels: DataFrame, tables: dict[str, DataFrame], cfg: TrainConfig) -> DataFrame:
    """Features as of each spine row, kept where there is a label for the same key and time."""
    features = historical_features(spine, list(cfg.refs), cfg.views, tables, allow_exact=cfg.allow_exact,
                                   bucket=cfg.bucket)
    return inner_join(features, label_scan(labels, cfg.label), [ENTITY_ID, EVENT_TIMESTAMP])


def row_key(rows: DataFrame) -> Column:
    """Entity and UTC time as text, the same under any session zone."""
    ts = F.col(EVENT_TIMESTAMP)
    if isinstance(rows.schema[EVENT_TIMESTAMP].dataType, TimestampType):
        ts = wall_clock(ts)
    return F.concat_ws("|", F.col(ENTITY_ID), ts.cast("string"))


def evaluate(model: PipelineModel, validation: DataFrame, label: str, folder: str) -> dict[str, float | None]:
    """Accuracy, F1 of the positive class and the exact area under the ROC curve (null for one class).

    The scored rows are kept in ``folder``: the model runs over them once, the metrics pass over its answers.
    """
    predict(model, validation).select(label, "prediction", "probability").write.mode("errorifexists").parquet(folder)
    scored = validation.sparkSession.read.parquet(folder)
    one = classification_metrics(scored, label, "prediction").first()
    auc = roc_auc(scored, label, "probability").first()
    return {"accuracy": one["accuracy"], "f1_score": one["f1_score"], "roc_auc": auc["roc_auc"]}


def beats_champion(registry: Registry, model: PipelineModel, validation: DataFrame, cfg: TrainConfig) -> bool:
    """Whether there is no champion yet, or the gate lets the model take its place. Both score the same validation rows."""
    champion = registry.champions().filter(F.col("name") == cfg.model_name).first()
    if champion is None:
        return True
    old = predict(load_model(champion["source"]), validation).drop("prediction").withColumnRenamed("probability", "_champion")
    judged = compare_models(predict(model, old), cfg.label, "_champion", "probability").first()
    logger.info("%s: candidate %s", cfg.model_name, judged.asDict())
    return judged["promote"]


def stored_split(merged: DataFrame, cfg: TrainConfig, folder: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows, kept as a table in two folders so that each is read alone."""
    features = [feature for _, feature in parse_refs(list(cfg.refs), cfg.views)]
    complete = apply_missing_policy(merged, features, cfg.missing)
    split = stratified_split(complete, cfg.label, row_key(complete), cfg.share, cfg.seed)
    split.write.mode("errorifexists").partitionBy("is_validation").parquet(folder)
    spark = merged.sparkSession
    stored = spark.read.schema(split.schema).parquet(folder)
    return stored.filter(~F.col("is_validation")), stored.filter("is_validation")


def from_catalog(row, cfg: TrainConfig) -> TrainConfig:
    """The settings with what a catalog row says: name, label, feature references, experiment."""
    refs = tuple(r.strip() for r in row["feature_refs"].split(",") if r.strip()) if row["feature_refs"] else cfg.refs
    return replace(cfg, model_name=row["model_name"], refs=refs, label=row["label_column"] or cfg.label,
                   experiment=row["experiment"] or cfg.experiment)


def stage_counts(train: DataFrame, validation: DataFrame, features: list[str]) -> dict[str, int]:
    """Rows of both parts, and rows that lack a feature (dropped before, or filled by the model), in one pass."""
    both = train.unionByName(validation)
    lacking = reduce(or_, [is_missing(c, both.schema[c].dataType) for c in features])
    return both.agg(F.count_if(~F.col("is_validation")).alias("n_train"), F.count_if("is_validation").alias("n_validation"),
                    F.count_if(lacking).alias("n_imputed")).first().asDict()


def pinned_tables(spark: SparkSession, cfg: TrainConfig) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(spine, labels, view tables) of the snapshot that the settings name. Views lie below ``base``/offline."""
    kept = Snapshots(spark, f"{cfg.base}/{OFFLINE}", cfg.snapshots)

    def pinned(location: str) -> DataFrame:
        return kept.read(cfg.snapshot, location.removeprefix(f"{OFFLINE}/"))

    tables = {v.name: view_rows(v, pinned(FEATURES_DIR if v.name == CUSTOMER_FEATURES.name else v.name)) for v in cfg.views}
    return training_spine(pinned(TRAIN_ENTITIES_FILE)), label_scan(pinned(LABELS_FILE), cfg.label), tables


def train_job(spark: SparkSession, cfg: TrainConfig, now: datetime | None = None) -> TrainResult:
    if cfg.snapshots:
        if not cfg.snapshot:
            cfg = replace(cfg, snapshot=Snapshots(spark, f"{cfg.base}/{OFFLINE}", cfg.snapshots).take())
        return train_on(spark, *pinned_tables(spark, cfg), cfg, now)
    spine = read_training_spine(spark, cfg.base)
    labels = read_labels(spark, cfg.base, cfg.label)
    tables = view_tables(spark, cfg.views, cfg.base, cfg.view_paths)
    return train_on(spark, spine, labels, tables, cfg, now)


def train_on(spark: SparkSession, spine: DataFrame, labels: DataFrame, tables: dict[str, DataFrame],
             cfg: TrainConfig, now: datetime | None = None) -> TrainResult:
    """The job on given tables."""
    started = now or datetime.now(timezone.utc)
    run_id = uuid.uuid4().hex
    # Written tables instead of a long lineage: every later step scans them, and a lost executor costs one scan.
    folder = work_dir(spark, f"train-{run_id}")
    training_set(spine, labels, tables, cfg).write.mode("errorifexists").parquet(f"{folder}/merged")
    merged = not_empty(spark.read.parquet(f"{folder}/merged"))
    features = [feature for _, feature in parse_refs(list(cfg.refs), cfg.views)]
    train, validation = stored_split(merged, cfg, f"{folder}/split")
    # The join keeps every spine row, so the spine's count is that of the features.
    sizes = {r["stage"]: r["n_rows"] for r in row_counts(
        {"n_features": spine, "n_labels": labels, "n_merged": merged}).collect()}
    sizes |= stage_counts(train, validation, features)
    n_train, n_validation = sizes["n_train"], sizes["n_validation"]
    sizes["n_dropped"] = sizes["n_merged"] - n_train - n_validation
    model_class, fit = KINDS[cfg.kind]
    model = fit(train, features, cfg)
    metrics = evaluate(model, validation, cfg.label, f"{folder}/scored")
    artifact = f"{cfg.registry.rstrip('/')}/artifacts/{run_id}/model"
    save_model(model, artifact)
    input_example(train.select(ENTITY_ID, EVENT_TIMESTAMP, *features), [ENTITY_ID, EVENT_TIMESTAMP]).drop(
        ENTITY_ID, EVENT_TIMESTAMP).write.json(f"{cfg.registry.rstrip('/')}/artifacts/{run_id}/input_example")
    registry = Registry(spark, cfg.registry)
    registry.log_input(run_id, dataset_profile(merged, "features_with_labels", cfg.base, cfg.label))
    registry.log_run(run_id, cfg.experiment, started, {
        "model_class": model_class, "n_estimators": cfg.num_trees if cfg.kind == "forest" else 0, "random_state": cfg.seed,
        "n_train": n_train, "n_val": n_validation, **{k: sizes[k] for k in (
            "n_features", "n_labels", "n_merged", "n_dropped", "n_imputed")}, "features": ",".join(features), "label_column": cfg.label,
        **({"snapshot": cfg.snapshot} if cfg.snapshot else {}),
    }, metrics, {"model_name": cfg.model_name}, artifact)
    version = registry.register(cfg.model_name, run_id, artifact, metrics["f1_score"], metrics["roc_auc"], started)
    promoted = not cfg.gate or beats_champion(registry, model, validation, cfg)
    if promoted:
        registry.set_alias(cfg.model_name, CHAMPION, version, started)
    uri = f"models:/{cfg.model_name}@{CHAMPION}"
    logger.info("trained %s version %d run %s %s", cfg.model_name, version, run_id, metrics)
    remove_folder(spark, folder)
    return TrainResult(run_id, version, artifact, uri, metrics, n_train, n_validation, sizes["n_features"],
                       sizes["n_labels"], sizes["n_merged"], sizes["n_dropped"] + sizes["n_imputed"], promoted)
