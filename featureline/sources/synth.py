"""Synthetic customers, labels and spines; values depend on the seed and the row only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureline.functions.exprs import churn_probability, minus, padded_key, ts_literal, uniform, uniform_int
from featureline.schema import ENTITY_ID, EVENT_TIMESTAMP

SEED = 42


def customer_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "n")


def generate_features(ids: DataFrame, now: datetime | str, seed: int = SEED, id_col: str = "n",
                      ts_type: T.DataType | None = None) -> DataFrame:
    """Feature rows 7 to 90 days old (and up to 23 hours more)."""
    row = F.col(id_col)
    at = minus(ts_literal(now, ts_type or T.TimestampType()),
               uniform_int(seed, row, "feature_days", 7, 91), uniform_int(seed, row, "feature_hours", 0, 24))
    return ids.select(
        row,
        padded_key("cust-", row).alias(ENTITY_ID),
        at.alias(EVENT_TIMESTAMP),
        uniform_int(seed, row, "age", 18, 75).alias("age"),
        F.round(uniform(seed, row, "balance") * 50000.0, 2).alias("account_balance"),
        uniform_int(seed, row, "transactions", 0, 500).alias("num_transactions"),
        uniform_int(seed, row, "inactive", 0, 365).alias("days_since_last_txn"),
    )


def generate_labels(features: DataFrame, now: datetime | str, seed: int = SEED, id_col: str = "n",
                    ts_type: T.DataType | None = None) -> DataFrame:
    """Labels 0 to 6 days old (and up to 11 hours more), so always newer than the features."""
    row = F.col(id_col)
    at = minus(ts_literal(now, ts_type or T.TimestampType()),
               uniform_int(seed, row, "label_days", 0, 7), uniform_int(seed, row, "label_hours", 0, 12))
    p = churn_probability(F.col("account_balance"), F.col("days_since_last_txn"))
    return features.select(ENTITY_ID, at.alias(EVENT_TIMESTAMP), (uniform(seed, row, "churn") < p).alias("churned"))


def train_entities(labels: DataFrame) -> DataFrame:
    return labels.select(ENTITY_ID, EVENT_TIMESTAMP)


def score_entities(features: DataFrame) -> DataFrame:
    return features.select(ENTITY_ID)
