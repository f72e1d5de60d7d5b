"""The online table in key buckets, for runs that touch few keys and for bulk lookups.

Keys are dealt into ``buckets`` by hash. A run writes the newest row per key of its interval as one segment for each bucket it
touches. A manifest, one small table for each run, lists the live segments of all buckets. When a bucket has
``fanout`` segments of a level, they become one of the next level, together with that level if this one completes it. So a run
writes the buckets it touches only, and a row is rewritten once per level, of which there are as many as the logarithm
of the runs to the base ``fanout``. Nothing that is being read is overwritten; :meth:`clean` removes what no manifest needs.

One writer at a time: a second one that commits the same sequence number fails, and its segments are never live.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from featureline.functions.exprs import ts_literal
from featureline.schema import FeatureView
from featureline.session import folders_in, remove_folder
from featureline.sources.online import OnlineTable

BUCKETS, FANOUT = 64, 4

MANIFEST = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("interval_end", T.StringType()),
    T.StructField("bucket", T.IntegerType()),  # null in the row that stands for the run itself
    T.StructField("level", T.IntegerType()),
    T.StructField("folder", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("buckets", T.IntegerType()),
])


class BucketedOnlineTable(OnlineTable):
    def __init__(self, spark: SparkSession, base: str, view: FeatureView, buckets: int = BUCKETS, fanout: int = FANOUT):
        """``buckets`` counts for a new table; one that is there keeps its own."""
        super().__init__(spark, base, view)
        self.fanout = max(fanout, 2)
        live = self._live()
        self.buckets = live[0]["buckets"] if live else buckets

    @property
    def state_path(self) -> str:
        return f"{self.base}/manifest"

    def bucket(self) -> Column:
        """The bucket of a row or of a key that is asked for, whatever whole-number type its key has."""
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.view.keys]), F.lit(self.buckets)).cast("int")

    def _live(self) -> list[Row]:
        """The newest manifest: the run's own row first, then its live segments in the order they were written."""
        names = sorted(n for n in folders_in(self.spark, self.state_path) if n.isdigit())
        if not names:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.state_path}/{names[-1]}").collect()
        return sorted(rows, key=lambda r: (r["bucket"] is not None, r["bucket"], -(r["level"] or 0), r["folder"]))

    def segments(self) -> list[Row]:
        return [r for r in self._live() if r["bucket"] is not None]

    def _read(self, live: list[Row]) -> DataFrame:
        live = [r for r in live if r["bucket"] is not None]
        if not live:
            return self.spark.createDataFrame([], self.view.table_schema)
        rows = self.spark.read.schema(self.view.table_schema).parquet(*[f"{r['folder']}/bucket={r['bucket']}" for r in live])
        return rows if len({r["bucket"] for r in live}) == len(live) else self.newest(rows)

    def _write(self, rows: DataFrame, name: str) -> dict[int, tuple[str, int]]:
        """Writes rows by bucket, one file each; the folder and row count of every bucket there is."""
        folder = f"{self.base}/rows/{name}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        schema = T.StructType([*self.view.table_schema.fields, T.StructField("bucket", T.IntegerType())])
        counts = self.spark.read.schema(schema).parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["bucket"]: (folder, r["n"]) for r in counts}

    def _due(self, segments: list[Row]) -> tuple[int, list[Row]]:
        """What of one bucket is to be merged, and the level it makes."""
        by_level: dict[int, list[Row]] = defaultdict(list)
        for s in segments:
            by_level[s["level"]].append(s)
        if len(by_level[0]) < self.fanout:
            return 0, []
        level, due = 1, list(by_level[0])
        while len(by_level[level]) + 1 >= self.fanout:
            due += by_level[level]
            level += 1
        return level, due

    def _merge(self, rows: DataFrame, run_id: str, interval_end: str | None, live: list[Row]) -> None:
        sequence = (live[0]["sequence"] if live else 0) + 1
        end = interval_end or (live[0]["interval_end"] if live else None)
        entry = lambda bucket, level, folder, n: Row(
            view=self.view.name, sequence=sequence, run_id=run_id, interval_end=end, bucket=bucket, level=level, folder=folder, n_rows=n,
            buckets=self.buckets)
        touched = self._write(self.newest(rows), run_id)
        segments: dict[int, list[Row]] = defaultdict(list)
        for r in live:
            if r["bucket"] is not None:
                segments[r["bucket"]].append(r)
        for bucket, (folder, n) in touched.items():
            segments[bucket].append(entry(bucket, 0, folder, n))
        due = {bucket: found for bucket in touched if (found := self._due(segments[bucket]))[1]}
        if due:
            merged = self._write(self.newest(self._read([s for _, old in due.values() for s in old])), f"{run_id}-merged")
            for bucket, (level, old) in due.items():
                segments[bucket] = [s for s in segments[bucket] if s not in old] + [entry(bucket, level, *merged[bucket])]
        rows_ = [entry(None, None, None, sum(n for _, n in touched.values()))]
        rows_ += [entry(s["bucket"], s["level"], s["folder"], s["n_rows"]) for bucket in segments.values() for s in bucket]
        self.spark.createDataFrame(rows_, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.state_path}/{sequence:012d}")

    def materialize_incremental(self, table: DataFrame, end: datetime | str, run_id: str | None = None) -> DataFrame:
        return super().materialize_incremental(table, end, run_id or f"run-{uuid.uuid4().hex[:8]}")

    def rows_for(self, keys: DataFrame) -> DataFrame:
        """The newest rows of the buckets that the keys fall in; no other bucket is opened."""
        asked = {r[0] for r in keys.select(self.bucket()).distinct().collect()}  # one row per bucket at most
        return self._read([s for s in self.segments() if s["bucket"] in asked])

    def lookup(self, keys: DataFrame, at: datetime | str | Column) -> DataFrame:
        """Every asked row with the features of its key: null, with ``found`` false, for keys that are not there, and null, with
        ``expired`` true, for rows that are older than the view's time to live at ``at``."""
        ts_type = self.view.table_schema[self.view.ts_col].dataType
        at = at if isinstance(at, Column) else ts_literal(at, ts_type)
        other = [c for c in self.columns if c not in self.view.keys and c != self.view.ts_col]
        stored = self.rows_for(keys).select(*[F.col(f"`{k}`").cast("string").alias(f"_k{i}") for i, k in enumerate(self.view.keys)],
                                            F.col(self.view.ts_col).alias("feature_timestamp"), *other, F.lit(True).alias("_there"))
        asked = keys.select(*[F.col(f"`{c}`") for c in keys.columns if c not in (*other, "feature_timestamp")], at.alias("_at"),
                            *[F.col(f"`{k}`").cast("string").alias(f"_k{i}") for i, k in enumerate(self.view.keys)])
        joined = asked.join(stored, [f"_k{i}" for i in range(len(self.view.keys))], "left")
        found = F.coalesce("_there", F.lit(False))
        expired = F.lit(False) if not self.view.ttl else F.coalesce(
            F.col("feature_timestamp") < F.col("_at") - F.lit(self.view.ttl), F.lit(False))
        joined = joined.withColumns({"found": found, "expired": expired})
        return joined.select(*[F.col(f"`{c}`") for c in keys.columns if c not in (*other, "feature_timestamp", "found", "expired")],
                             *[F.when(~F.col("expired"), F.col(c)).alias(c) for c in other], "feature_timestamp", "found", "expired")

    def clean(self) -> int:
        """Removes segments that the newest manifest doesn't name; only when nobody reads an older one. Returns their number."""
        live = {f"{s['folder']}/bucket={s['bucket']}" for s in self.segments()}
        gone = 0
        for run in folders_in(self.spark, f"{self.base}/rows"):
            for name in folders_in(self.spark, f"{self.base}/rows/{run}"):
                path = f"{self.base}/rows/{run}/{name}"
                if name.startswith("bucket=") and path not in live:
                    remove_folder(self.spark, path)
                    gone += 1
        return gone
