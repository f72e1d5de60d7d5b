"""The online table: the newest feature row per key, brought forward interval by interval.

A run writes the newest row per key of its interval to a folder of its own and appends one row
to the state table. Readers take the folders since the last full one and keep the newest row
per key. Every ``full_every`` runs the folders are merged into a full one, so a run costs about
as much as its new rows. Nothing that is being read is overwritten, and a row that is taken in
twice changes nothing.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from featureline.functions.exprs import ts_literal, utc_text
from featureline.operators.keyed import latest_per_key
from featureline.operators.registry import append, read_or_empty
from featureline.operators.skew import complete_key
from featureline.schema import FeatureView

FULL_EVERY = 16

STATE = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("interval_end", T.StringType()),  # with its zone, unless the view's times have none
    T.StructField("folder", T.StringType()),
    T.StructField("is_full", T.BooleanType()),
])


class OnlineTable:
    def __init__(self, spark: SparkSession, base: str, view: FeatureView, full_every: int = FULL_EVERY):
        self.spark = spark
        self.view = view
        self.base = f"{base.rstrip('/')}/{view.name}"
        self.columns = view.table_schema.fieldNames()
        self.full_every = full_every

    @property
    def state_path(self) -> str:
        return f"{self.base}/state"

    def _live(self) -> list[Row]:
        """State rows from the last full folder on, in order: one for each run since then, whatever ``full_every`` is now."""
        state = read_or_empty(self.spark, self.state_path, STATE)
        full = state.filter("is_full").agg(F.max("sequence")).first()[0]
        return state.filter(F.col("sequence") >= full).orderBy("sequence").collect() if full is not None else []

    def read(self) -> DataFrame:
        return self._read(self._live())

    def _read(self, live: list[Row]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.view.table_schema)
        rows = self.spark.read.schema(self.view.table_schema).parquet(*[r["folder"] for r in live])
        return rows if len(live) == 1 else self.newest(rows)

    def newest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows.select(*self.columns), self.view.keys, self.view.ts_col, self.view.tiebreak)

    def merge(self, rows: DataFrame, run_id: str, interval_end: str | None = None) -> None:
        """Takes the rows in; the newer event time wins, so repeats and late rows change nothing."""
        self._merge(rows, run_id, interval_end, self._live())

    def _merge(self, rows: DataFrame, run_id: str, interval_end: str | None, live: list[Row]) -> None:
        is_full = not live or len(live) >= self.full_every
        newest = self.newest(rows)
        if is_full and live:
            newest = self.newest(self._read(live).unionByName(newest))
        folder = f"{self.base}/rows/{run_id}-{uuid.uuid4().hex[:12]}"
        newest.write.mode("errorifexists").parquet(folder)
        end = interval_end or (live[-1]["interval_end"] if live else None)
        sequence = (live[-1]["sequence"] if live else 0) + 1
        state = [(self.view.name, sequence, run_id, end, folder, is_full)]
        append(self.spark.createDataFrame(state, STATE), self.state_path)

    def materialize_incremental(self, table: DataFrame, end: datetime | str, run_id: str | None = None) -> DataFrame:
        """Rows with event time after the last run's end and not after ``end``."""
        live = self._live()
        ts = F.col(self.view.ts_col)
        ts_type = table.schema[self.view.ts_col].dataType
        end = utc_text(end, ts_type)
        rows = table.filter((ts <= ts_literal(end, ts_type)) & complete_key(self.view.keys))
        if live and live[-1]["interval_end"]:
            rows = rows.filter(ts > ts_literal(live[-1]["interval_end"], ts_type))
        self._merge(rows, run_id or "run", end, live)
        return self.read()
