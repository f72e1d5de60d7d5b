"""The model catalog: one row per model, kept as appended row states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featureline.errors import ChampionMissing, ModelConflict, ModelNotFound
from featureline.operators.keyed import keyed_insert, keyed_update, latest_per_key, lookup, unknown_keys
from featureline.operators.registry import append, read_or_empty
from featureline.schema import CATALOG

CREATE_COLUMNS = ["model_name", "feature_view", "feature_refs", "label_column", "experiment", "owner"]


def model_id(name: Column, created_at: Column) -> Column:
    """An id in UUID form that a repeated task computes again."""
    digest = F.md5(F.concat_ws(":", name, F.unix_micros(created_at).cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def create_rows(accepted: DataFrame, now: Column) -> DataFrame:
    """Catalog rows for accepted create requests."""
    values = {
        "id": model_id(F.col("model_name"), now), "created_at": now, "updated_at": now,
        "created_by": F.lit(None), "updated_by": F.lit(None), "is_active": F.lit(True), "cron_schedule": F.lit(None),
    }
    return accepted.select(*[
        values.get(f.name, F.col(f.name) if f.name in CREATE_COLUMNS else None).cast(f.dataType).alias(f.name)
        for f in CATALOG.fields
    ])


def judge_schedules(catalog: DataFrame, updates: DataFrame, champions: DataFrame) -> DataFrame:
    """Schedule updates with ``status``: set, cleared, unknown_model or no_champion.

    An empty or null schedule clears. Setting one needs a champion version.
    """
    models = catalog.select("model_name", F.lit(True).alias("_known"))
    ready = champions.select(F.col("name").alias("model_name"), F.lit(True).alias("_champion"))
    judged = updates.join(models, "model_name", "left").join(ready, "model_name", "left")
    clears = F.coalesce(F.col("cron_schedule"), F.lit("")) == ""
    return judged.withColumn(
        "status",
        F.when(F.col("_known").isNull(), "unknown_model").when(clears, "cleared")
        .when(F.col("_champion").isNull(), "no_champion").otherwise("set"),
    ).drop("_known", "_champion")


def apply_schedules(catalog: DataFrame, judged: DataFrame, now: Column) -> DataFrame:
    """The catalog after the updates that may be applied; ``updated_at`` moves forward for those rows only."""
    allowed = judged.filter(F.col("status").isin("set", "cleared")).select("model_name", "cron_schedule")
    return keyed_update(catalog, allowed, "model_name", ["cron_schedule"],
                        {"updated_at": F.greatest(now, F.col("updated_at") + F.expr("INTERVAL 1 MICROSECOND"))})


def get_all(catalog: DataFrame) -> DataFrame:
    """All models, active or not."""
    return catalog


class Catalog:
    """Every insert and update appends the new state of a row; the newest state of a name counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def models(self) -> DataFrame:
        return latest_per_key(read_or_empty(self.spark, self.path, CATALOG), ["model_name"], "updated_at")

    def get(self, name: str) -> DataFrame:
        row = lookup(self.models(), "model_name", name)
        if row.isEmpty():
            raise ModelNotFound(f"model {name} not found")
        return row

    def create(self, requests: DataFrame, order_cols: list[str], now: datetime, strict: bool = True) -> DataFrame:
        """Adds new models. A known or repeated name is a conflict: an error, or with ``strict`` off a returned row."""
        judged = keyed_insert(self.models(), requests, "model_name", order_cols)
        conflicts = judged.filter(F.col("status") == "conflict")
        if strict:
            names = [r["model_name"] for r in conflicts.select("model_name").limit(5).collect()]
            if names:
                raise ModelConflict(f"models already in the catalog: {names}")
        append(create_rows(judged.filter(F.col("status") == "accepted"), F.lit(now)), self.path)
        return conflicts

    def set_schedules(self, updates: DataFrame, champions: DataFrame, now: datetime) -> None:
        current = self.models()
        judged = judge_schedules(current, updates, champions)
        refused = judged.filter(F.col("status").isin("unknown_model", "no_champion")).limit(5).collect()
        for row in refused:
            if row["status"] == "unknown_model":
                raise ModelNotFound(f"model {row['model_name']} not found")
            raise ChampionMissing(f"model {row['model_name']} has no champion and cannot be scheduled")
        changed = lookup(apply_schedules(current, judged, F.lit(now)), "model_name", updates)
        append(changed, self.path)


__all__ = ["Catalog", "apply_schedules", "create_rows", "get_all", "judge_schedules", "unknown_keys"]
