"""The online table fed by a stream of feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from featureline.operators.skew import complete_key
from featureline.schema import FeatureView
from featureline.sources.online import OnlineTable


def feature_stream(spark: SparkSession, view: FeatureView, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(view.table_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def materialize_stream(stream: DataFrame, online: OnlineTable, checkpoint: str) -> StreamingQuery:
    """Takes in all files that are there and stops; the next start goes on where this one ended.

    Each micro-batch is reduced to one row per key before it is merged. A late row never replaces
    a newer one and a batch that comes again adds nothing new, so neither the order of files nor a
    repeated batch matters.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        online.merge(batch.filter(complete_key([*online.view.keys, online.view.ts_col])), f"batch-{batch_id:09d}")

    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
