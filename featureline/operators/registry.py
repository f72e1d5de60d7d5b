"""Runs, model versions and aliases: small append-only tables with one writer."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from featureline.errors import ChampionMissing
from featureline.functions.exprs import champion_uri
from featureline.operators.keyed import latest_per_key

CHAMPION = "champion"

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
_TEXT_MAP, _NUMBER_MAP = T.MapType(_S, _S), T.MapType(_S, T.DoubleType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES = {
    "runs": _table(run_id=_S, experiment=_S, started_at=_TS, params=_TEXT_MAP, metrics=_NUMBER_MAP,
                   tags=_TEXT_MAP, artifact=_S),
    "run_inputs": _table(run_id=_S, dataset=_S, source=_S, targets=_S, context=_S, n_rows=_L, digest=_S,
                         position=T.IntegerType(), column=_S, type=_S, nulls=_L, min_value=_S, max_value=_S),
    "model_versions": _table(name=_S, version=_L, run_id=_S, source=_S, tags=_TEXT_MAP, created_at=_TS),
    "model_aliases": _table(name=_S, alias=_S, version=_L, set_at=_TS),
}


def next_versions(existing: DataFrame, requests: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Requests with ``version``: one above the highest of the name, counted on in request order."""
    highest = existing.groupBy("name").agg(F.max("version").alias("_top"))
    number = F.row_number().over(Window.partitionBy("name").orderBy(*order_cols))
    return (requests.withColumn("_number", number).join(highest, "name", "left")
            .withColumn("version", (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_number")).cast("long"))
            .drop("_number", "_top"))


def version_tags(run_id: Column, f1: Column, auc: Column) -> Column:
    """Text tags of a version; scores rounded half-even to four digits."""
    return F.create_map(F.lit("run_id"), run_id.cast("string"),
                        F.lit("f1_score"), F.bround(f1, 4).cast("string"),
                        F.lit("roc_auc"), F.bround(auc, 4).cast("string"))


def current_aliases(aliases: DataFrame) -> DataFrame:
    """Where each alias of a name points now: the last setting wins, whatever the version."""
    return latest_per_key(aliases, ["name", "alias"], "set_at", ["version"])


def resolve(aliases: DataFrame, versions: DataFrame, alias: str = CHAMPION) -> DataFrame:
    """Per name the alias URI and the version it stands for."""
    current = current_aliases(aliases).filter(F.col("alias") == alias)
    return current.join(versions, ["name", "version"], "inner").select(
        "name", champion_uri(F.col("name"), alias).alias("model_uri"), "version", "run_id", "source")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Registry:
    """The tables below one base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def read(self, table: str) -> DataFrame:
        return read_or_empty(self.spark, self.path(table), TABLES[table])

    def _append_row(self, table: str, **values) -> None:
        schema = TABLES[table]
        row = [tuple(values.get(name) for name in schema.fieldNames())]
        append(self.spark.createDataFrame(row, schema), self.path(table))

    def log_run(self, run_id: str, experiment: str, started_at: datetime, params: dict[str, str],
                metrics: dict[str, float], tags: dict[str, str] | None = None, artifact: str | None = None) -> None:
        self._append_row("runs", run_id=run_id, experiment=experiment, started_at=started_at,
                         params={k: str(v) for k, v in params.items()},
                         metrics={k: float(v) for k, v in metrics.items() if v is not None},
                         tags=tags or {}, artifact=artifact)

    def log_input(self, run_id: str, profile: DataFrame) -> None:
        rows = profile.withColumn("run_id", F.lit(run_id))
        append(rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES["run_inputs"].fields]),
               self.path("run_inputs"))

    def register(self, name: str, run_id: str, source: str, f1: float | None, auc: float | None,
                 now: datetime) -> int:
        """A new version of the model; returns its number."""
        top = self.read("model_versions").filter(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (top or 0) + 1
        tags = {"run_id": run_id, "f1_score": str(round(f1, 4)) if f1 is not None else None,
                "roc_auc": str(round(auc, 4)) if auc is not None else None}
        self._append_row("model_versions", name=name, version=version, run_id=run_id, source=source, tags=tags,
                         created_at=now)
        return version

    def set_alias(self, name: str, alias: str, version: int, now: datetime) -> None:
        self._append_row("model_aliases", name=name, alias=alias, version=version, set_at=now)

    def champions(self, alias: str = CHAMPION) -> DataFrame:
        return resolve(self.read("model_aliases"), self.read("model_versions"), alias)

    def champion(self, name: str, alias: str = CHAMPION):
        """The resolved row of one model, or ChampionMissing."""
        row = self.champions(alias).filter(F.col("name") == name).first()
        if row is None:
            raise ChampionMissing(f"no version of {name} carries the alias {alias}")
        return row
