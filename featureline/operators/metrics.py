"""Scaler statistics and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from featureline.session import work_dir

#: Distinct scores that one score range holds, about.
RANGE_SCORES = 1_000_000


def scaler_statistics(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """One row per column: rows, mean and deviation (``ddof`` 0 over n, 1 over n - 1). One pass."""
    deviation = F.stddev_pop if ddof == 0 else F.stddev_samp
    one = df.agg(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"),
                 F.avg(F.col(c).cast("double")).alias("mean"),
                 deviation(F.col(c).cast("double")).alias("deviation")).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def standardize(df: DataFrame, fit_on: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """``(x - mean) / deviation`` with statistics of ``fit_on``; a constant column becomes 0."""
    stats = {r["feature"]: r for r in scaler_statistics(fit_on, columns, ddof).collect()}
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(stats[c]["deviation"] or 1.0)
        for c in columns
    })


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    t, p = truth.cast("int") == 1, predicted.cast("int") == 1
    return {"tp": F.count_if(t & p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "tn": F.count_if(~t & ~p)}


def classification_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 of the positive class, 0 where F1 has no denominator."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion(F.col(truth), F.col(predicted)).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    wide = 2 * tp + fp + fn
    return counts.withColumns({
        "accuracy": F.when(n > 0, (tp + tn) / n),
        "f1_score": F.when(wide > 0, 2 * tp / wide).otherwise(F.lit(0.0)),
    })


def running_below(df: DataFrame, order: str, weights: Sequence[str], range_rows: int = RANGE_SCORES) -> DataFrame:
    """Adds ``<weight>_below`` for every weight: its sum over all rows with a smaller ``order``, a double that differs in every row.

    Sums go over ranges of about ``range_rows`` rows first and then inside each, so no task sees all rows. ``df`` is read
    several times: give a table or something cheap.
    """
    ranges = -(-df.count() // range_rows)
    cuts = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.5 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted({c for c in cuts if isfinite(c)}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_r").transform(df) \
        if len(splits) > 2 else df.withColumn("_r", F.lit(0.0))
    below = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_r").agg(*[F.sum(w).alias(f"_range_{w}") for w in weights]).select(
        "_r", *[F.coalesce(F.sum(f"_range_{w}").over(below), F.lit(0)).alias(f"_offset_{w}") for w in weights])
    inside = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # offsets has one row per range.
    counted = ranged.withColumns({f"_inside_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}).join(offsets, "_r")
    return counted.select(*[F.col(f"`{c}`") for c in df.columns],
                          *[(F.col(f"_offset_{w}") + F.col(f"_inside_{w}")).alias(f"{w}_below") for w in weights])


def roc_auc(df: DataFrame, truth: str, score: str, range_scores: int = RANGE_SCORES) -> DataFrame:
    """One row: positives, negatives and the area under the ROC curve; equal scores count half.

    Rows shrink to one per distinct score, which are written and read from there on. Infinite scores count like any other; NaN and
    null scores and null truths are left out and counted in ``n_unscored``. ``roc_auc`` is null when only one class is present.
    """
    t = F.col(truth).cast("int") == 1
    # Adding 0.0 makes -0.0 and 0.0 one score.
    rows = df.select((F.col(score).cast("double") + F.lit(0.0)).alias("_score"), t.alias("_t"))
    known = F.col("_score").isNotNull() & ~F.isnan("_score") & F.col("_t").isNotNull()
    folder = work_dir(df.sparkSession, "scores")
    # Rows that can't be ranked are one more score, null, and only counted.
    rows.withColumn("_score", F.when(known, F.col("_score"))).groupBy("_score").agg(
        F.count_if("_t").alias("_pos"), F.count_if(~F.col("_t")).alias("_neg"), F.count(F.lit(1)).alias("_n")).write.parquet(folder)
    by_score = df.sparkSession.read.schema("_score double, _pos long, _neg long, _n long").parquet(folder)
    left_out, by_score = by_score.filter("_score IS NULL"), by_score.filter("_score IS NOT NULL").drop("_n")
    counted = running_below(by_score, "_score", ["_neg"], range_scores)
    wins = F.col("_pos").cast("double") * (F.col("_neg_below") + F.col("_neg") / 2)
    counted = counted.select("_pos", "_neg", wins.alias("_win"), F.lit(0).cast("long").alias("_n")).unionByName(
        left_out.select(F.lit(0).cast("long").alias("_pos"), F.lit(0).cast("long").alias("_neg"), F.lit(0.0).alias("_win"), "_n"))
    totals = counted.agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("n_negative"), F.sum("_win").alias("_wins"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_unscored"))
    p, n = F.col("n_positive"), F.col("n_negative")
    return totals.select(
        "n_positive", "n_negative", "n_unscored",
        F.when((p > 0) & (n > 0), F.col("_wins") / (p.cast("double") * n)).alias("roc_auc"),
        ((p == 0) | (n == 0)).alias("one_class"),
    )
