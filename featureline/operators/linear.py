"""A linear model of a 0 or 1 label by least squares: sums of products in one pass, the weights by one small solve.

It is a pipeline of the same form as the forests (class and probability), so it is kept, loaded and used for scoring like them. The probability
is the linear value, cut to 0 and 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F


def linear_weights(train: DataFrame, features: Sequence[str], label: str, fill: bool = True) -> tuple[dict[str, float], float, dict[str, float]]:
    """(weights, intercept, means). With ``fill`` missing values count as the mean of the feature; else rows that lack one are left out.

    Values are centred before products are summed, which keeps the sums exact enough. The driver gets one row of
    ``(k + 1) * (k + 2) / 2`` numbers for k features. Of features that depend on others the shortest weights are taken.
    """
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    rows = train.select(*[number(c).alias(f"x{i}") for i, c in enumerate(features)], F.col(f"`{label}`").cast("int").cast("double").alias("y"))
    names = [f"x{i}" for i in range(len(features))]
    rows = rows.dropna(subset=["y"] if fill else [*names, "y"])
    means = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in [*names, "y"]]).first()
    centred = rows.select(*[(F.coalesce(F.col(c), F.lit(means[c])) - means[c]).alias(c) for c in [*names, "y"]])
    order = [*names, "y"]
    sums = centred.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}_{b}")
                         for i, a in enumerate(order) for b in order[i:]]).first()
    both = np.array([[sums[f"{a}_{b}"] if i <= j else sums[f"{b}_{a}"] for j, b in enumerate(order)] for i, a in enumerate(order)])
    # Scaled to ones on the diagonal, so that features of any size weigh alike in the solve.
    size = np.sqrt(np.diag(both)[:-1])
    size[size == 0] = 1.0
    w = np.linalg.lstsq(both[:-1, :-1] / np.outer(size, size), both[:-1, -1] / size, rcond=1e-12)[0] / size
    intercept = means["y"] - float(sum(x * means[c] for x, c in zip(w, names)))
    return dict(zip(features, map(float, w))), intercept, {c: means[n] for c, n in zip(features, names)}


def _literal(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def fit_linear(train: DataFrame, features: Sequence[str], label: str, missing: str = "impute") -> PipelineModel:
    """The model as a pipeline. With ``missing`` fail a row that lacks a feature stops scoring, otherwise it counts as the training mean."""
    weights, intercept, means = linear_weights(train, features, label, fill=missing != "fail")
    terms = []
    for c in features:
        value = f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))"
        terms.append(f"{_literal(weights[c])} * " + (f"coalesce({value}, {_literal(means[c])})" if missing != "fail" else value))
    value = " + ".join([_literal(intercept), *terms])
    if missing == "fail":  # also where only the class is asked for
        value = f"coalesce({value}, CAST(raise_error('a row lacks a feature of the model') AS DOUBLE))"
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, least(greatest({value}, 0D), 1D) AS __p FROM __THIS__"),
        SQLTransformer(statement="SELECT *, 1D - __p AS __q, CAST(__p > 0.5D AS DOUBLE) AS prediction FROM __THIS__"),
        VectorAssembler(inputCols=["__q", "__p"], outputCol="probability", handleInvalid="error")])
