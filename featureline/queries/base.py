"""Registration, and the tables most queries start from (as DataFrames and as SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from featureline.operators.asof import historical_features
from featureline.operators.keyed import inner_join
from featureline.schema import CUSTOMER, CUSTOMER_FEATURE_REFS, CUSTOMER_FEATURES, Entity, FeatureView

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NTZ = T.TimestampNTZType()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- views over the given tables ------------------------------------------------------------

CUSTOMER_VIEW = replace(CUSTOMER_FEATURES, ts_type=NTZ)

BASKET_VIEW = FeatureView(
    name="basket", entities=(CUSTOMER,), ttl=timedelta(days=730), ts_type=NTZ,
    schema=T.StructType([T.StructField("total_quantity", T.DoubleType()),
                         T.StructField("mean_discount", T.DoubleType())]),
)

NATION_VIEW = FeatureView(
    name="nation_day", entities=(Entity("nation", ("nation_key",)),), ttl=timedelta(days=30), ts_type=NTZ,
    key_type=T.LongType(),
    schema=T.StructType([T.StructField("nation_orders", T.LongType()),
                         T.StructField("nation_revenue", T.DoubleType())]),
)

PAGE_VIEWS = FeatureView(
    name="page_views", entities=(Entity("user", ("user_id",)),), ttl=timedelta(days=1), ts_col="ts", ts_type=NTZ,
    key_type=T.LongType(), schema=T.StructType([T.StructField("value", T.DoubleType())]),
)

PENDING_ORDERS = FeatureView(
    name="pending", entities=(Entity("buyer", ("o_custkey",)),), ts_col="o_orderdate", ts_type=NTZ,
    key_type=T.LongType(), tiebreak=("p_orderkey",),
    schema=T.StructType([T.StructField("p_orderkey", T.LongType()), T.StructField("p_totalprice", T.DoubleType())]),
)


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and order day; orders shrink to one row per day before any window."""
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("_n"))
    by_time = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = F.col("o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return days.select(
        "o_custkey", day.alias("event_timestamp"),
        F.date_diff(day, F.min(day).over(running)).cast("long").alias("age"),
        F.sum("_n").over(running).alias("num_transactions"),
        F.date_diff(day, F.lag(day).over(by_time)).cast("long").alias("days_since_last_txn"),
    ).join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("entity_id"), "event_timestamp", "age",
        F.col("c_acctbal").alias("account_balance"), "num_transactions", "days_since_last_txn")


def label_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_custkey").cast("string").alias("entity_id"),
        (ntz("1999-01-01 00:00:00") + F.make_dt_interval((F.col("c_custkey") % 365).cast("int")))
        .alias("event_timestamp"))


def train_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_times(spark, sf_dir).select("entity_id", "event_timestamp")


def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True where no order follows within 180 days."""
    times = label_times(spark, sf_dir)
    at, day = F.col("event_timestamp"), F.col("o_orderdate")
    active = (table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").distinct()
              .join(times.select("c_custkey", "event_timestamp"), F.col("o_custkey") == F.col("c_custkey"))
              .filter((day > at) & (day <= at + F.lit(timedelta(days=180))))
              .select("c_custkey", F.lit(True).alias("_active")).distinct())
    return times.join(active, "c_custkey", "left").select(
        "entity_id", "event_timestamp", F.col("_active").isNull().alias("churned"))


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    return (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").cast("string").alias("entity_id"),
                     F.col("o_orderdate").alias("event_timestamp"))
            .agg(F.sum("q").alias("total_quantity"), (F.sum("d") / F.sum("n")).alias("mean_discount")))


def nation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"))
    return (by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("long").alias("nation_key"),
                     F.col("o_orderdate").alias("event_timestamp"))
            .agg(F.sum("n").alias("nation_orders"), F.sum("price").alias("nation_revenue")))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows with their features as of the label time, and the label."""
    spine = train_entities(spark, sf_dir)
    features = historical_features(spine, CUSTOMER_FEATURE_REFS, (CUSTOMER_VIEW,),
                                   {"customer_features": customer_features(spark, sf_dir)})
    return inner_join(features, churn_labels(spark, sf_dir), ["entity_id", "event_timestamp"])


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog row per customer with money in the account; the others are not registered yet."""
    return table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(
        F.concat(F.lit("model-"), F.col("c_custkey").cast("string")).alias("model_name"),
        F.lower("c_mktsegment").alias("owner"), (F.col("c_acctbal") >= 5000).alias("is_active"),
        ntz("1995-01-01 00:00:00").alias("updated_at"), F.lit("cron(0 3 * * ? *)").alias("cron_schedule"))


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per order priority and month, with figures of that month."""
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "").alias("name"), month.alias("created_at"),
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f1_score"),
        F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("roc_auc"),
    ).withColumn("run_id", F.concat_ws("-", "name", F.date_format("created_at", "yyyyMM")))


# --- the same tables in SQL -----------------------------------------------------------------

CUSTOMER_FEATURES_SQL = """
order_days AS (
  SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate),
customer_features AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate AS event_timestamp,
         date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS age,
         c_acctbal AS account_balance,
         CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS num_transactions,
         date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate)
           AS days_since_last_txn
  FROM order_days JOIN customer ON c_custkey = o_custkey)"""

LABEL_TIMES_SQL = """
label_times AS (
  SELECT c_custkey, c_nationkey, CAST(c_custkey AS VARCHAR) AS entity_id,
         TIMESTAMP '1999-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS event_timestamp
  FROM customer)"""

CHURN_LABELS_SQL = LABEL_TIMES_SQL + """,
churn_labels AS (
  SELECT entity_id, event_timestamp, NOT EXISTS (
    SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > event_timestamp
      AND o_orderdate <= event_timestamp + INTERVAL 180 DAY) AS churned
  FROM label_times)"""

AS_OF_LABELS_SQL = CUSTOMER_FEATURES_SQL + "," + CHURN_LABELS_SQL + """,
as_of_labels AS (
  SELECT s.entity_id, s.event_timestamp,
         CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.age END AS age,
         CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.account_balance END
           AS account_balance,
         CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.num_transactions END
           AS num_transactions,
         CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.days_since_last_txn END
           AS days_since_last_txn
  FROM label_times s ASOF LEFT JOIN customer_features f
    ON s.entity_id = f.entity_id AND s.event_timestamp > f.event_timestamp),
training_rows AS (
  SELECT a.*, l.churned FROM as_of_labels a JOIN churn_labels l USING (entity_id, event_timestamp))"""

BASKET_SQL = """
basket AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate AS event_timestamp,
         sum(l_quantity) AS total_quantity, sum(l_discount) / count(*) AS mean_discount
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""

NATION_DAYS_SQL = """
nation_days AS (
  SELECT CAST(c_nationkey AS BIGINT) AS nation_key, o_orderdate AS event_timestamp,
         count(*) AS nation_orders, sum(o_totalprice) AS nation_revenue
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""

CATALOG_SQL = """
catalog AS (
  SELECT 'model-' || CAST(c_custkey AS VARCHAR) AS model_name, lower(c_mktsegment) AS owner,
         c_acctbal >= 5000 AS is_active, TIMESTAMP '1995-01-01' AS updated_at,
         'cron(0 3 * * ? *)' AS cron_schedule
  FROM customer WHERE c_acctbal >= 0)"""

TRAINING_RUNS_SQL = """
training_runs AS (
  SELECT regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') AS name,
         CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS created_at, count(*) AS n_rows,
         avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS f1_score,
         avg(CAST(o_totalprice > 100000 AS DOUBLE)) AS roc_auc,
         regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') || '-'
           || strftime(date_trunc('month', o_orderdate), '%Y%m') AS run_id
  FROM orders GROUP BY ALL)"""
