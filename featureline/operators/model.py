"""Random forest pipelines: fit, persist, predict, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.operators.quality import null_counts


@dataclass(frozen=True)
class ForestConfig:
    """``max_depth`` and ``max_bins`` bound the trees. ``partitions`` is how many parts the training rows are dealt into by their
    hash: with the seed it decides the model, so it follows neither the table's size nor the cores; set it so that a part fits an executor. ``missing`` is fail, drop or impute; with fail a row that
    lacks a feature stops scoring too, otherwise it is scored with the medians of the training rows."""

    features: tuple[str, ...]
    label: str
    num_trees: int = 100
    max_depth: int = 10
    max_bins: int = 32
    seed: int = 42
    missing: str = "impute"
    partitions: int = 32
    max_memory_mb: int = 512


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    counts = null_counts(df, columns).first()
    return [c for c in columns if counts[f"{c}_nulls"]]


def scaling_stages(features: Sequence[str], with_nulls: Sequence[str] = (), fill: bool = True) -> list:
    """Features to doubles, medians for nulls, indicators for ``with_nulls``, one vector, standardised.

    With ``fill`` every feature gets a median, also those complete in training: rows to be
    scored later may lack them.
    """
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}__value`" for c in features]
    casts += [f"CAST(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) AS DOUBLE) AS `{c}__missing`" for c in with_nulls]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")]
    inputs = [f"{c}__value" for c in features]
    if fill:
        filled = [f"{c}__filled" for c in features]
        stages.append(Imputer(strategy="median", inputCols=inputs, outputCols=filled))
        inputs = filled
    inputs = inputs + [f"{c}__missing" for c in with_nulls]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_vector", handleInvalid="error"))
    stages.append(StandardScaler(inputCol="raw_vector", outputCol="scaled_vector", withMean=True, withStd=True))
    return stages


def forest_pipeline(cfg: ForestConfig, with_nulls: Sequence[str] = ()) -> Pipeline:
    forest = RandomForestClassifier(
        featuresCol="scaled_vector", labelCol="_label", predictionCol="prediction",
        numTrees=cfg.num_trees, maxDepth=cfg.max_depth, maxBins=cfg.max_bins, seed=cfg.seed,
        impurity="gini", featureSubsetStrategy="sqrt", maxMemoryInMB=cfg.max_memory_mb,
        cacheNodeIds=True,  # a level goes on from where the level before left each row, not from the roots of all trees
    )
    return Pipeline(stages=[*scaling_stages(cfg.features, with_nulls, cfg.missing != "fail"), forest])


def fit_forest(train: DataFrame, cfg: ForestConfig) -> PipelineModel:
    with_nulls = columns_with_nulls(train, cfg.features) if cfg.missing == "impute" else []
    # The forest draws its samples by part and place, so both follow from the rows alone.
    spread = F.pmod(F.xxhash64(*train.columns), F.lit(cfg.partitions))
    rows = train.select(*cfg.features, F.col(cfg.label).cast("double").alias("_label"), spread.alias("_part"),
                        F.xxhash64(*train.columns).alias("_row"))
    # Every stage of the pipeline passes over the rows; they are dealt out and sorted once.
    rows = rows.repartition(cfg.partitions, "_part").sortWithinPartitions("_part", "_row").drop("_part", "_row").persist()
    try:
        return forest_pipeline(cfg, with_nulls).fit(rows)
    finally:
        rows.unpersist()


def save_model(model: PipelineModel, path: str) -> None:
    """The whole pipeline as one artifact; it holds the column order."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (the class) and ``probability`` of the positive class."""
    out = model.transform(df)
    positive = vector_to_array("probability")[1]
    return out.select(*df.columns, "prediction", positive.alias("probability"))


def score_rows(model: PipelineModel, df: DataFrame, output: str = "class") -> DataFrame:
    """Adds ``score``: the predicted class as 0.0 or 1.0 (default), or the probability."""
    if output not in ("class", "probability"):
        raise ValueError(f"unknown output {output!r}")
    scored = predict(model, df)
    return scored.select(*df.columns, F.col("prediction" if output == "class" else "probability").alias("score"))


def score_foreign(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], Sequence[float]]],
                  features: Sequence[str]) -> DataFrame:
    """Scores with a model that is not Spark's. ``load`` runs once per task, the model per Arrow batch."""
    columns = list(features)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            scores = [float(x) for x in model(batch[columns])]
            if len(scores) != len(batch):
                raise ValueError(f"model gave {len(scores)} scores for {len(batch)} rows")
            yield batch.assign(score=scores)

    return df.mapInPandas(run, schema)
