"""Scans with declared schemas, and the Parquet and NDJSON sinks."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featureline.functions.exprs import partition_date, ts_literal, utc_timestamp
from featureline.operators.asof import in_time_range
from featureline.operators.keyed import latest_per_key
from featureline.operators.quality import SPINE_RULES, validate
from featureline.schema import ENTITY_ID, EVENT_TIMESTAMP, PREDICTION, FeatureView, conform

# Fixed folder layout under a base folder.
OFFLINE = "offline"
FEATURES_DIR = "offline/customer_features"
LABELS_FILE = "offline/labels/labels_synthetic.parquet"
TRAIN_ENTITIES_FILE = "offline/entities/train_entities.parquet"
PREDICTIONS_DIR = "predictions"

JSON_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def score_entities_file(model_name: str) -> str:
    return f"offline/entities/{model_name}_score_entities.parquet"


def read_view(spark: SparkSession, view: FeatureView, path: str | None = None, time_range=None) -> DataFrame:
    """The declared columns of a feature view, cut to the rows a spine of that time range can match."""
    return view_rows(view, spark.read.parquet(path or view.source), time_range)


def view_rows(view: FeatureView, table: DataFrame, time_range=None) -> DataFrame:
    """The same from a table that was read already. The stored types decide: a file that differs from the declaration must not be read as null."""
    declared = conform(table, view.table_schema)
    if view.date_column and view.date_column in table.columns:
        declared = table.select(*view.table_schema.fieldNames(), view.date_column)
    return in_time_range(view, declared, time_range)


def training_spine(raw: DataFrame) -> DataFrame:
    """Validated ``(entity_id, event_timestamp)`` rows in UTC; a bad row fails the job."""
    checked = validate(raw, SPINE_RULES, mode="fail")
    return as_spine(checked)


def as_spine(rows: DataFrame) -> DataFrame:
    """Key as text and time as a UTC timestamp, nothing else."""
    ts_type = rows.schema[EVENT_TIMESTAMP].dataType
    ts = F.col(EVENT_TIMESTAMP)
    if isinstance(ts_type, T.TimestampNTZType):
        ts = utc_timestamp(ts)
    elif not isinstance(ts_type, T.TimestampType):
        ts = ts.cast("timestamp")
    return rows.select(F.col(ENTITY_ID).cast("string").alias(ENTITY_ID), ts.alias(EVENT_TIMESTAMP))


def read_training_spine(spark: SparkSession, base: str) -> DataFrame:
    return training_spine(spark.read.parquet(f"{base}/{TRAIN_ENTITIES_FILE}"))


def read_labels(spark: SparkSession, base: str, label: str = "churned") -> DataFrame:
    return label_scan(spark.read.parquet(f"{base}/{LABELS_FILE}"), label)


def label_scan(table: DataFrame, label: str, keys: tuple[str, ...] = (ENTITY_ID, EVENT_TIMESTAMP)) -> DataFrame:
    return table.select(*keys, label)


def score_spine(entities: DataFrame, run_ts: datetime | str, ts_type: T.DataType | None = None) -> DataFrame:
    """Entities to score, all stamped with the time of the run."""
    return entities.select(
        F.col(ENTITY_ID).cast("string").alias(ENTITY_ID),
        ts_literal(run_ts, ts_type or T.TimestampType()).alias(EVENT_TIMESTAMP),
    )


def write_features(df: DataFrame, path: str, ts_col: str = EVENT_TIMESTAMP, grain: str = "day",
                   date_column: str = "event_date") -> None:
    """Parquet partitioned by event date (in UTC, the first day of its ``grain``); never onto existing data.

    A view that reads it names the same grain in ``date_grain``.
    The rebalance hint gathers each date into few files and splits a date that is too big
    for one task.
    """
    day = partition_date(F.col(ts_col), df.schema[ts_col].dataType, grain)
    (df.withColumn(date_column, day).hint("rebalance", F.col(date_column))
     .write.mode("errorifexists").partitionBy(date_column).parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def run_folder(prefix: str, model_name: str, run_ts: datetime, run_id: str | None = None) -> str:
    """A folder name of its own for every run: time stamp plus run id."""
    if run_ts.tzinfo is not None:
        run_ts = run_ts.astimezone(timezone.utc)
    stamp = run_ts.strftime("%Y%m%dT%H%M%SZ")
    return f"{prefix.rstrip('/')}/{model_name}/run={stamp}-{run_id or uuid.uuid4().hex[:12]}"


def prediction_rows(scored: DataFrame, model_uri: str | Column, predicted_at: Column,
                    model_version: Column | None = None, score: str = "score") -> DataFrame:
    """Scored rows in the prediction layout."""
    uri = model_uri if isinstance(model_uri, Column) else F.lit(model_uri)
    return scored.select(
        F.col(ENTITY_ID).cast("string").alias(ENTITY_ID),
        F.col(score).cast("double").alias("score"),
        uri.alias("model_uri"),
        (model_version if model_version is not None else F.lit(None)).cast("long").alias("model_version"),
        predicted_at.alias("predicted_at"),
    )


def write_predictions(predictions: DataFrame, prefix: str, model_name: str, run_ts: datetime,
                      run_id: str | None = None) -> str:
    """NDJSON, one new folder per run; returns the folder."""
    folder = run_folder(prefix, model_name, run_ts, run_id)
    predictions.write.mode("errorifexists").option("timestampFormat", JSON_TIMESTAMP).json(folder)
    return folder


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One run folder, or all runs of a model when given the folder above them."""
    return spark.read.schema(PREDICTION).option("timestampFormat", JSON_TIMESTAMP).json(path)


def latest_predictions(predictions: DataFrame, keys: tuple[str, ...] = (ENTITY_ID,)) -> DataFrame:
    """Over all appended runs, the newest prediction per entity."""
    return latest_per_key(predictions, list(keys), "predicted_at")
