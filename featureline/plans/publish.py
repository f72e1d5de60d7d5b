"""Publishing features: write the tables, check them, bring the online table forward."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featureline.operators.asof import historical_features
from featureline.operators.contracts import VIOLATIONS, Contract, ContractBroken, broken, column_facts, report, with_violations
from featureline.operators.quality import completeness, leakage_report
from featureline.schema import CUSTOMER_FEATURE_REFS, CUSTOMER_FEATURES
from featureline.session import remove_folder, work_dir
from featureline.sources import synth
from featureline.sources.buckets import BucketedOnlineTable
from featureline.sources.online import OnlineTable
from featureline.sources.tables import (FEATURES_DIR, LABELS_FILE, TRAIN_ENTITIES_FILE, read_labels, read_view,
                                        score_entities_file, as_spine, write_features, write_table)


def generate(spark: SparkSession, base: str, n_customers: int = 200, now: datetime | str = "2026-01-15 00:00:00",
             model_name: str = "churn_model", seed: int = synth.SEED) -> None:
    """Synthetic features, labels, training and scoring entities in the usual folders."""
    features = synth.generate_features(synth.customer_ids(spark, n_customers), now, seed)
    labels = synth.generate_labels(features, now, seed)
    write_features(features.drop("n"), f"{base}/{FEATURES_DIR}")
    write_table(labels, f"{base}/{LABELS_FILE}")
    write_table(synth.train_entities(labels), f"{base}/{TRAIN_ENTITIES_FILE}")
    write_table(synth.score_entities(features), f"{base}/{score_entities_file(model_name)}")


def check(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(leakage report, completeness of the point-in-time join of the label rows)."""
    features = read_view(spark, CUSTOMER_FEATURES, f"{base}/{FEATURES_DIR}")
    labels = read_labels(spark, base)
    joined = historical_features(as_spine(labels), CUSTOMER_FEATURE_REFS, (CUSTOMER_FEATURES,),
                                 {CUSTOMER_FEATURES.name: features})
    return leakage_report(features, labels), completeness(joined, CUSTOMER_FEATURES.features)


def materialize(spark: SparkSession, base: str, end: datetime | str, buckets: int | None = None) -> DataFrame:
    """Brings the online table forward: appended folders, or with ``buckets`` key buckets, which bulk lookups need."""
    features = read_view(spark, CUSTOMER_FEATURES, f"{base}/{FEATURES_DIR}")
    online = BucketedOnlineTable(spark, f"{base}/online_buckets", CUSTOMER_FEATURES, buckets) if buckets else \
        OnlineTable(spark, f"{base}/online", CUSTOMER_FEATURES)
    return online.materialize_incremental(features, end)


def lookup(spark: SparkSession, base: str, keys: DataFrame, at: datetime | str) -> DataFrame:
    """Features of the asked keys from the table in key buckets, as of its last run."""
    return BucketedOnlineTable(spark, f"{base}/online_buckets", CUSTOMER_FEATURES).lookup(keys, at)


def ingest(spark: SparkSession, df: DataFrame, contract: Contract, base: str, table: str, run_id: str, period: Column | None = None) -> DataFrame:
    """Takes rows into ``{base}/{table}``, one folder per run; returns the report of the table rules.

    Rows that break a row rule go to ``{base}/{table}_quarantine`` with their reasons, the facts of all rows to ``{base}/{table}_facts``.
    A broken table rule stops the run before any row is taken in; its facts and rows aside stay to be looked at.
    """
    run = f"run={run_id}"
    folder = work_dir(spark, "ingest")
    marked = with_violations(df, contract).withColumn("_good", F.size(VIOLATIONS) == 0)
    marked.write.partitionBy("_good").parquet(folder)
    checked = spark.read.schema(marked.schema).parquet(folder)
    whole = checked.drop("_good", VIOLATIONS)
    facts = f"{base}/{table}_facts/{run}"
    column_facts(whole, contract, period).write.parquet(facts)
    found = report(whole, spark.read.parquet(facts), contract)
    lines = spark.createDataFrame(found.collect(), found.schema)  # one line per declared rule
    checked.where(~F.col("_good")).drop("_good").write.parquet(f"{base}/{table}_quarantine/{run}")
    if wrong := broken(lines):
        remove_folder(spark, folder)
        raise ContractBroken("; ".join(wrong))
    checked.where("_good").drop("_good", VIOLATIONS).write.parquet(f"{base}/{table}/{run}")
    remove_folder(spark, folder)
    return lines
