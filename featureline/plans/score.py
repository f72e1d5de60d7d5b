"""Batch scoring: one model, or every model of the catalog."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.types import TimestampType

from featureline.functions.exprs import ts_literal
from featureline.operators import skew
from featureline.operators.asof import historical_features
from featureline.operators.model import load_model, score_rows
from featureline.operators.quality import PREDICTION_RULES, validate
from featureline.operators.registry import Registry
from featureline.plans.train import view_tables
from featureline.schema import CUSTOMER_FEATURES, PREDICTION, FeatureView, parse_refs
from featureline.session import remove_folder, work_dir
from featureline.sources.tables import (JSON_TIMESTAMP, PREDICTIONS_DIR, prediction_rows, run_folder,
                                        score_entities_file, score_spine, write_predictions)

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class ScoreConfig:
    base: str
    registry: str
    model_name: str
    feature_refs: str
    views: tuple[FeatureView, ...] = (CUSTOMER_FEATURES,)
    view_paths: dict[str, str] = field(default_factory=dict)
    predictions: str | None = None
    output: str = "class"
    allow_exact: bool = False
    bucket: timedelta | None = skew.BUCKET

    @property
    def prefix(self) -> str:
        return self.predictions or f"{self.base}/{PREDICTIONS_DIR}"


def as_predictions(scored: DataFrame, model_uri: str, version: int, run_ts: datetime) -> DataFrame:
    return prediction_rows(scored, model_uri, ts_literal(run_ts, TimestampType()), F.lit(version))


def score_job(spark: SparkSession, cfg: ScoreConfig, run_ts: datetime | None = None, run_id: str | None = None) -> str:
    """Scores the entities of one model with its champion; returns the folder written.

    ``run_ts`` stands for the current time; a given one replays the run.
    """
    run_ts = run_ts or datetime.now(timezone.utc)
    entities = spark.read.parquet(f"{cfg.base}/{score_entities_file(cfg.model_name)}")
    spine = score_spine(entities, run_ts)
    tables = view_tables(spark, cfg.views, cfg.base, cfg.view_paths)
    # The spine has one time, so the scanned range is known without a job.
    features = historical_features(spine, cfg.feature_refs, cfg.views, tables, allow_exact=cfg.allow_exact,
                                   time_range=(run_ts, run_ts), bucket=cfg.bucket)
    champion = Registry(spark, cfg.registry).champion(cfg.model_name)
    scored = score_rows(load_model(champion["source"]), features, cfg.output)
    predictions = as_predictions(scored, champion["model_uri"], champion["version"], run_ts)
    return write_predictions(validate(predictions, PREDICTION_RULES, mode="inline"), cfg.prefix, cfg.model_name,
                             run_ts, run_id)


#: Models scored by one plan.
GROUP = 16


def score_models(catalog_rows: list, spine_of: Callable[[str], DataFrame], champions: dict, views, tables: dict[str, DataFrame],
                 run_ts: datetime, folder: str, *, spine_time=None, output: str = "class", allow_exact: bool = False,
                 bucket: timedelta | None = skew.BUCKET, group: int = GROUP) -> DataFrame:
    """Predictions of several models with a ``model_name`` column, kept in ``folder`` (a new one).

    Models go group by group, so no plan grows with the catalog. The spines of a group go through one point-in-time join over the references of
    its models, and its rows are written once, in a folder for each model; the models are loaded one by one and each reads its own folder.
    """
    spark = next(iter(tables.values())).sparkSession
    kept = T.StructType([*PREDICTION.fields, T.StructField("model_name", T.StringType())])
    for start in range(0, len(catalog_rows), group):
        _score_group(catalog_rows[start:start + group], spine_of, champions, views, tables, run_ts, f"{folder}/features/{start}",
                     spine_time, output, allow_exact, bucket).select(*kept.fieldNames()).write.mode("append").parquet(f"{folder}/scored")
    return spark.read.schema(kept).parquet(f"{folder}/scored") if catalog_rows else spark.createDataFrame([], kept)


def _score_group(catalog_rows, spine_of, champions, views, tables, run_ts, folder, spine_time, output, allow_exact, bucket) -> DataFrame:
    refs = list(dict.fromkeys(f"{view.name}:{feature}" for row in catalog_rows for view, feature in parse_refs(row["feature_refs"], views)))
    tagged = [spine_of(row["model_name"]).withColumn("model_name", F.lit(row["model_name"])) for row in catalog_rows]
    features = historical_features(reduce(DataFrame.unionByName, tagged), refs, views, tables, allow_exact=allow_exact,
                                   time_range=spine_time, bucket=bucket)
    features.write.partitionBy("model_name").parquet(folder)
    features = features.sparkSession.read.schema(features.schema).parquet(folder)
    parts = []
    for row in catalog_rows:
        name = row["model_name"]
        champion = champions[name]
        scored = score_rows(load_model(champion["source"]), features.filter(F.col("model_name") == name), output)
        parts.append(as_predictions(scored, champion["model_uri"], champion["version"], run_ts).withColumn("model_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def score_catalog(spark: SparkSession, catalog: DataFrame, base: str, registry: str, run_ts: datetime,
                  views=(CUSTOMER_FEATURES,), view_paths: dict[str, str] | None = None,
                  predictions: str | None = None, output: str = "class", group: int = GROUP) -> str:
    """Scores every model of the catalog that has a champion; one output folder, partitioned by model, written whole or not at all."""
    champions = {row["name"]: row for row in Registry(spark, registry).champions().collect()}
    models = catalog.select("model_name", "feature_refs").collect()  # one row per model
    rows = [row for row in models if row["model_name"] in champions]
    if left_out := [row["model_name"] for row in models if row["model_name"] not in champions]:
        logger.warning("%d models have no champion and are not scored: %s", len(left_out), ", ".join(left_out))
    tables = view_tables(spark, views, base, view_paths or {})
    work = work_dir(spark, "scoring")
    scored = score_models(rows, lambda name: score_spine(spark.read.parquet(f"{base}/{score_entities_file(name)}"), run_ts), champions, views,
                          tables, run_ts, work, spine_time=(run_ts, run_ts), output=output, group=group)
    scored = validate(scored, PREDICTION_RULES, mode="inline")
    folder = run_folder(predictions or f"{base}/{PREDICTIONS_DIR}", "catalog", run_ts)
    (scored.write.mode("errorifexists").partitionBy("model_name")
     .option("timestampFormat", JSON_TIMESTAMP).json(folder))
    remove_folder(spark, work)
    return folder

