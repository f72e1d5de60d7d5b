"""Accuracy over time, from predictions and labels that come later, each as a stream.

A prediction waits for its label for ``horizon``; the wait, and how late rows of either stream may be, bound the state. What is decided
in a micro-batch (a labelled prediction, or one whose wait is over) is added to score histograms: counts per week, score range and
label, a few rows for each batch. Weekly figures come from merged histograms; no prediction is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from featureline.functions.exprs import utc_timestamp, wall_clock

BINS = 100
HISTOGRAM = T.StructType([
    T.StructField("week", T.TimestampNTZType()), T.StructField("bin", T.IntegerType()), T.StructField("label", T.BooleanType()),
    T.StructField("n", T.LongType())])


def _in_utc(df: DataFrame, column: str) -> Column:
    ts = F.col(column)
    return utc_timestamp(ts) if isinstance(df.schema[column].dataType, T.TimestampNTZType) else ts


def with_late_labels(predictions: DataFrame, labels: DataFrame, key: str, horizon: str, late: str) -> DataFrame:
    """Predictions (``key``, predicted_at, score) with the label (``key``, labelled_at, label) that came within ``horizon``; null if none did.

    A key has one label. Rows are sent once they are decided; what lies behind the watermark (``late`` behind the newest row of the
    stream that lags) is dropped, and Spark counts it in the query's progress.
    """
    made = predictions.select(F.col(key).alias("_p"), _in_utc(predictions, "predicted_at").alias("predicted_at"),
                              F.col("score").cast("double").alias("score")).withWatermark("predicted_at", late)
    known = labels.select(F.col(key).alias("_l"), _in_utc(labels, "labelled_at").alias("labelled_at"),
                          F.col("label").cast("boolean").alias("label")).withWatermark("labelled_at", late)
    within = F.expr(f"_p = _l AND labelled_at >= predicted_at AND labelled_at <= predicted_at + INTERVAL {horizon}")
    return made.join(known, within, "leftOuter").select(F.col("_p").alias(key), "predicted_at", "score", "label")


def score_histogram(decided: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts per week (UTC), score range and label. Scores lie from 0 to 1; others count in the first or the last range."""
    week = F.date_trunc("week", wall_clock(F.col("predicted_at"))).cast("timestamp_ntz")
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))).cast("int")
    scored = F.col("score").isNotNull() & ~F.isnan("score")
    return decided.where(scored).groupBy(week.alias("week"), place.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))


def batch_counts(batch: DataFrame, bins: int = BINS) -> DataFrame:
    """The histogram of a micro-batch in one part. Its few rows are put together after the counting: by ``coalesce`` one task would
    count, and hold the memory of, all partitions."""
    return score_histogram(batch, bins).repartition(1)


def start_decay_stream(decided: DataFrame, path: str, checkpoint: str, bins: int = BINS) -> StreamingQuery:
    """Writes the histogram of each micro-batch to a folder of its own, takes in all that is there and stops. A batch that
    comes again replaces its folder."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch_counts(batch, bins).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return decided.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def histograms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTOGRAM).parquet(path)


def weekly_metrics(histograms: DataFrame, bins: int = BINS, threshold: float = 0.5) -> DataFrame:
    """One row per week: predictions, labelled ones, accuracy, F1 and ROC area. Scores within one range count as equal; ``threshold``
    is taken at the range it lies in. Null where nothing is labelled, and for the area where one class is missing."""
    merged = histograms.groupBy("week", "bin").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("label"), F.col("n"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(~F.col("label"), F.col("n"))), F.lit(0)).alias("neg"))
    below = Window.partitionBy("week").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # ``bins`` rows at most
    ranked = merged.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    high = F.col("bin") >= int(threshold * bins)
    sums = ranked.groupBy("week").agg(
        F.sum("n").alias("n_predictions"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"),
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(high, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).alias("wins"))
    labelled = F.col("n_positive") + F.col("n_negative")
    tn, fn = F.col("n_negative") - F.col("fp"), F.col("n_positive") - F.col("tp")
    wide = F.col("tp") + F.col("fp") + F.col("tp") + fn
    return sums.select(
        "week", "n_predictions", labelled.alias("n_labelled"), "n_positive",
        F.when(labelled > 0, (F.col("tp") + tn) / labelled).alias("accuracy"),
        F.when(labelled > 0, F.when(wide > 0, 2 * F.col("tp") / wide).otherwise(0.0)).alias("f1_score"),
        F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0),
               F.col("wins") / (2.0 * F.col("n_positive") * F.col("n_negative"))).alias("roc_auc"))
