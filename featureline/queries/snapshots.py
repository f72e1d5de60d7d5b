"""R4: pinned snapshots of tables that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.operators.profile import row_digest
from featureline.queries.base import ntz, query, table
from featureline.session import work_dir
from featureline.sources.snapshots import Snapshots

_KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ROW_SQL = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'n')" for c in _KEPT)


def _grown(spark, sf):
    """Orders in folders of years: a snapshot of those before July 1997, then the rest is appended, and a second snapshot."""
    folder = work_dir(spark, "snapshots")
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    early = F.coalesce(F.col("o_orderdate") < ntz("1997-07-01 00:00:00"), F.lit(False))
    kept = Snapshots(spark, f"{folder}/orders", f"{folder}/store")
    orders.where(early).write.partitionBy("year").parquet(f"{folder}/orders")
    before = kept.take()
    orders.where(~early).write.mode("append").partitionBy("year").parquet(f"{folder}/orders")
    return kept, before, kept.take(before)


@query("r4_snapshot_diff", """
SELECT 'year=' || year(o_orderdate) AS folder, count(*) FILTER (o_orderdate < TIMESTAMP '1997-07-01') AS n_rows_before, count(*) AS n_rows_after,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1997-07-01') AS n_rows_added, bool_and(o_orderdate < TIMESTAMP '1997-07-01') AS unchanged FROM orders GROUP BY year(o_orderdate)""")
def diff(spark, sf):
    """What two snapshots hold by folder, and what the comparison of their files finds."""
    kept, before, after = _grown(spark, sf)
    old = kept.folders(before).select("folder", F.col("n_rows").alias("n_rows_before"), F.col("digest").alias("_old"))
    added = kept.diff(before, after).where("change = 'added'").groupBy("folder").agg(F.sum("n_rows_after").alias("n_rows_added"))
    none = F.lit(0).cast("long")
    return kept.folders(after).join(old, "folder", "left").join(added, "folder", "left").select(
        "folder", F.coalesce("n_rows_before", none).alias("n_rows_before"), F.col("n_rows").alias("n_rows_after"),
        F.coalesce("n_rows_added", none).alias("n_rows_added"), F.col("digest").eqNullSafe(F.col("_old")).alias("unchanged"))


@query("r4_snapshot_replay", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows,
  CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS HUGEINT)) AS VARCHAR) AS digest
FROM (SELECT o_orderdate, md5({_ROW_SQL}) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01') GROUP BY ALL""")
def replay(spark, sf):
    """The rows of the first snapshot, read after the table has grown."""
    kept, before, _ = _grown(spark, sf)
    return kept.read(before).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), row_digest(_KEPT).alias("digest"))
