"""S1 to S11, P1 to P8, L1, L2 and U1."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession, functions as F, types as T

from featureline.functions.exprs import utc_timestamp, wall_clock
from featureline.operators.keyed import lookup, lookup_one
from featureline.operators.profile import drop_keys, feature_matrix, input_example
from featureline.queries import base as b
from featureline.queries.base import query, table
from featureline.schema import conform, explode_refs
from featureline.session import work_dir
from featureline.sources import synth
from featureline.sources.catalog import get_all
from featureline.sources.buckets import BucketedOnlineTable
from featureline.sources.online import OnlineTable
from featureline.sources.tables import (label_scan, latest_predictions, prediction_rows, read_predictions, read_view,
                                        score_spine, training_spine, write_features, write_predictions, write_table)

RUN_TS = "2001-08-02 00:00:00"
RUN_AT = datetime(2001, 8, 2)


@query("s1_feature_scan", """
SELECT user_id, ts, value FROM events
WHERE ts BETWEEN (SELECT min(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY
             AND (SELECT max(ts) FROM events WHERE event_type = 'purchase')""")
def feature_scan(spark, sf):
    """All event rows a purchase could match; the bounds reach the Parquet reader as constants."""
    purchases = table(spark, sf, "events").filter("event_type = 'purchase'")
    first, last = purchases.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    return read_view(spark, b.PAGE_VIEWS, f"{sf}/events.parquet", (first, last))


@query("s2_training_spine", """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate AS event_timestamp FROM orders""")
def spine_scan(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderdate").alias("event_timestamp"),
        "o_orderstatus")
    spine = training_spine(raw)
    return spine.withColumn("event_timestamp", wall_clock(F.col("event_timestamp")))


@query("s3_label_scan", f"WITH {b.CHURN_LABELS_SQL} SELECT entity_id, event_timestamp, churned FROM churn_labels")
def labels(spark, sf):
    folder = work_dir(spark, "labels")
    write_table(b.churn_labels(spark, sf).withColumn("note", F.lit("unused")), folder)
    return label_scan(spark.read.parquet(folder), "churned")


@query("s4_score_spine", """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, TIMESTAMP '2001-08-02' AS event_timestamp FROM customer""")
def score_entities(spark, sf):
    return score_spine(table(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_id"), RUN_TS, b.NTZ)


@query("s5_declared_schema", "SELECT o_custkey, o_orderdate, o_totalprice FROM orders")
def declared(spark, sf):
    wanted = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderdate", b.NTZ),
                           T.StructField("o_totalprice", T.DoubleType())])
    return conform(table(spark, sf, "orders"), wanted)


@query("s6_parquet_sink", f"WITH {b.CUSTOMER_FEATURES_SQL} SELECT * FROM customer_features")
def parquet_sink(spark, sf):
    """Written by event month and read back through the declared view."""
    folder = work_dir(spark, "features")
    write_features(b.customer_features(spark, sf), folder, grain="month")
    return read_view(spark, b.CUSTOMER_VIEW, folder)


_PREDICTIONS_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_acctbal / 4 AS score, 'models:/churn_model@champion' AS model_uri,
       CAST(3 AS BIGINT) AS model_version, TIMESTAMP '2001-08-02' AS predicted_at FROM customer"""


def _predictions(spark: SparkSession, sf: str):
    """Deterministic scores; no model needed."""
    scored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), (F.col("c_acctbal") / 4).alias("score"))
    return prediction_rows(scored, "models:/churn_model@champion", utc_timestamp(b.ntz(RUN_TS)), F.lit(3))


def _zoneless(df):
    return df.withColumn("predicted_at", wall_clock(F.col("predicted_at")))


@query("s7_prediction_sink", f"""
SELECT model_uri, count(*) AS n_lines, count(DISTINCT entity_id) AS n_entities FROM ({_PREDICTIONS_SQL}) GROUP BY 1""")
def prediction_sink(spark, sf):
    """The lines as they were written, one JSON object each."""
    folder = write_predictions(_predictions(spark, sf), work_dir(spark, "predictions"), "churn_model", RUN_AT)
    lines = spark.read.text(folder)
    return lines.groupBy(F.get_json_object("value", "$.model_uri").alias("model_uri")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct(F.get_json_object("value", "$.entity_id")).alias("n_entities"))


@query("s8_prediction_round_trip", _PREDICTIONS_SQL)
def prediction_round_trip(spark, sf):
    folder = write_predictions(_predictions(spark, sf), work_dir(spark, "predictions"), "churn_model", RUN_AT)
    return _zoneless(read_predictions(spark, folder))


@query("s9_online_incremental", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT * FROM customer_features WHERE event_timestamp <= TIMESTAMP '2000-12-31'
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_timestamp DESC) = 1""")
def online_incremental(spark, sf):
    """Three intervals, each brought forward from the one before."""
    folder = work_dir(spark, "online")
    write_table(b.customer_features(spark, sf), f"{folder}/features")
    features = read_view(spark, b.CUSTOMER_VIEW, f"{folder}/features")
    online = OnlineTable(spark, folder, b.CUSTOMER_VIEW)
    for end in ("1997-06-30 00:00:00", "1999-12-31 00:00:00", "2000-12-31 00:00:00"):
        newest = online.materialize_incremental(features, end)
    return newest


@query("s9_online_buckets", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT * FROM customer_features WHERE event_timestamp <= TIMESTAMP '2000-12-31'
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_timestamp DESC) = 1""")
def online_buckets(spark, sf):
    """Six intervals into key buckets, of which two of a level become one of the next."""
    folder = work_dir(spark, "buckets")
    write_table(b.customer_features(spark, sf), f"{folder}/features")
    features = read_view(spark, b.CUSTOMER_VIEW, f"{folder}/features")
    online = BucketedOnlineTable(spark, folder, b.CUSTOMER_VIEW, buckets=16, fanout=2)
    for end in ("1996-12-31", "1997-06-30", "1999-01-31", "1999-12-31", "2000-06-30", "2000-12-31"):
        newest = online.materialize_incremental(features, f"{end} 00:00:00")
    return newest


@query("r1_online_lookup", f"""
WITH {b.CUSTOMER_FEATURES_SQL},
newest AS (SELECT * FROM customer_features QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_timestamp DESC) = 1),
asked AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS entity_id, o_orderkey FROM orders),
joined AS (SELECT a.*, n.* EXCLUDE (entity_id), n.entity_id IS NOT NULL AS found,
  coalesce(n.event_timestamp < TIMESTAMP '2001-08-02' - INTERVAL 365 DAY, false) AS expired
  FROM asked a LEFT JOIN newest n ON n.entity_id = CAST(a.entity_id AS VARCHAR))
SELECT entity_id, o_orderkey, CASE WHEN NOT expired THEN age END AS age, CASE WHEN NOT expired THEN account_balance END AS account_balance,
  CASE WHEN NOT expired THEN num_transactions END AS num_transactions, CASE WHEN NOT expired THEN days_since_last_txn END AS days_since_last_txn,
  event_timestamp AS feature_timestamp, found, expired FROM joined""")
def online_lookup(spark, sf):
    """One request per order, a fifth of them for keys that are not there."""
    online = BucketedOnlineTable(spark, work_dir(spark, "lookup"), b.CUSTOMER_VIEW, buckets=16)
    online.materialize_incremental(b.customer_features(spark, sf), "2001-08-01 00:00:00")
    asked = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("entity_id"), "o_orderkey")
    return online.lookup(asked, "2001-08-02 00:00:00")


@query("s10_catalog_scan", f"WITH {b.CATALOG_SQL} SELECT * FROM catalog")
def catalog_scan(spark, sf):
    folder = work_dir(spark, "catalog")
    write_table(b.catalog_rows(spark, sf), folder)
    return get_all(spark.read.parquet(folder))


def _uniform_sql(name: str) -> str:
    return (f"(CAST('0x' || substr(md5(concat_ws(':', '42', CAST(n AS VARCHAR), '{name}')), 1, 12) AS BIGINT) "
            f"/ 281474976710656.0::DOUBLE)")


def _int_sql(name: str, low: int, high: int) -> str:
    return f"CAST(floor({_uniform_sql(name)} * {high - low}) AS BIGINT) + {low}"


SYNTH_SQL = f"""
ids AS (SELECT c_custkey AS n FROM customer),
synth_features AS (
  SELECT n, printf('cust-%04d', n) AS entity_id,
    TIMESTAMP '2026-01-15' - to_days(CAST({_int_sql('feature_days', 7, 91)} AS INTEGER))
      - to_hours({_int_sql('feature_hours', 0, 24)}) AS event_timestamp,
    {_int_sql('age', 18, 75)} AS age, round({_uniform_sql('balance')} * 50000.0::DOUBLE, 2) AS account_balance,
    {_int_sql('transactions', 0, 500)} AS num_transactions, {_int_sql('inactive', 0, 365)} AS days_since_last_txn
  FROM ids),
synth_labels AS (
  SELECT entity_id,
    TIMESTAMP '2026-01-15' - to_days(CAST({_int_sql('label_days', 0, 7)} AS INTEGER))
      - to_hours({_int_sql('label_hours', 0, 12)}) AS event_timestamp,
    {_uniform_sql('churn')} < greatest(0.05::DOUBLE, least(0.95::DOUBLE,
      0.2::DOUBLE + 0.5::DOUBLE * (days_since_last_txn / 365.0::DOUBLE)
      - 0.3::DOUBLE * (account_balance / 50000.0::DOUBLE))) AS churned
  FROM synth_features)"""


def _synth(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("n"))
    features = synth.generate_features(ids, "2026-01-15 00:00:00", ts_type=b.NTZ)
    return features, synth.generate_labels(features, "2026-01-15 00:00:00", ts_type=b.NTZ)


@query("s11_synthetic_features", f"WITH {SYNTH_SQL} SELECT * EXCLUDE (n) FROM synth_features")
def synthetic_features(spark, sf):
    return _synth(spark, sf)[0].drop("n")


@query("s11_synthetic_labels", f"WITH {SYNTH_SQL} SELECT * FROM synth_labels")
def synthetic_labels(spark, sf):
    return _synth(spark, sf)[1]


@query("p1_spine_projection", "SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS event_timestamp FROM events")
def spine_projection(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("event_timestamp"))


@query("p2_feature_refs", """
WITH refs AS (
  SELECT o_orderkey, ' customer_features:age , ,' || lower(o_orderstatus) || '_view:' || o_orderpriority
    || ',,basket:total_quantity ' AS feature_refs FROM orders),
items AS (SELECT o_orderkey, list_filter(list_transform(string_split(feature_refs, ','), lambda x: trim(x)),
                                         lambda x: x <> '') AS l FROM refs),
numbered AS (SELECT o_orderkey, unnest(l) AS ref, generate_subscripts(l, 1) - 1 AS position FROM items)
SELECT o_orderkey, CAST(position AS INTEGER) AS position, split_part(ref, ':', 1) AS "view",
       split_part(ref, ':', 2) AS feature FROM numbered""")
def feature_refs(spark, sf):
    refs = F.concat(F.lit(" customer_features:age , ,"), F.lower("o_orderstatus"), F.lit("_view:"),
                    F.col("o_orderpriority"), F.lit(",,basket:total_quantity "))
    return explode_refs(table(spark, sf, "orders").select("o_orderkey", refs.alias("feature_refs")))


@query("p3_feature_matrix", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT age, account_balance, num_transactions, days_since_last_txn, churned FROM training_rows""")
def matrix(spark, sf):
    return feature_matrix(b.training_rows(spark, sf), b.CUSTOMER_VIEW.features, "churned")


@query("p4_drop_keys", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT age, account_balance, num_transactions, days_since_last_txn FROM customer_features""")
def without_keys(spark, sf):
    return drop_keys(b.customer_features(spark, sf), ["entity_id", "event_timestamp", "not_there"])


@query("p5_key_cast", "SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderkey FROM orders")
def key_cast(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity_id"), "o_orderkey")


@query("p6_run_timestamp", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, TIMESTAMP '2024-02-01 03:00:00' AS event_timestamp FROM events""")
def run_timestamp(spark, sf):
    return score_spine(table(spark, sf, "events").withColumnRenamed("user_id", "entity_id"),
                       datetime(2024, 2, 1, 3), b.NTZ)


@query("p7_lookup_by_names", f"""
WITH {b.CATALOG_SQL}
SELECT * FROM catalog WHERE model_name IN
  (SELECT 'model-' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')""")
def by_names(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("model_name"))
    return lookup(b.catalog_rows(spark, sf), "model_name", wanted)


@query("p8_prediction_rows", _PREDICTIONS_SQL)
def predictions(spark, sf):
    return _zoneless(_predictions(spark, sf))


@query("l1_input_example", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT * FROM customer_features ORDER BY entity_id, event_timestamp LIMIT 1""")
def example(spark, sf):
    return input_example(b.customer_features(spark, sf), ["entity_id", "event_timestamp"])


@query("l2_lookup_one", f"WITH {b.CATALOG_SQL} SELECT * FROM catalog WHERE model_name = 'model-7' LIMIT 1")
def one_by_name(spark, sf):
    return lookup_one(b.catalog_rows(spark, sf), "model_name", "model-7")


@query("u1_latest_of_appended_runs", """
WITH runs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, max(o_totalprice) AS score,
         'models:/' || lower(o_orderstatus) || '@champion' AS model_uri,
         max(o_orderdate) AS predicted_at FROM orders GROUP BY o_custkey, o_orderstatus)
SELECT * FROM runs QUALIFY row_number() OVER (
  PARTITION BY entity_id ORDER BY predicted_at DESC, score DESC, model_uri DESC) = 1""")
def latest_run(spark, sf):
    """One run per order status, appended below one folder; the newest prediction per entity counts."""
    orders = table(spark, sf, "orders")
    folder = work_dir(spark, "predictions")
    for status in ("F", "O", "P"):
        scored = orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("entity_id")).agg(
            F.max("o_totalprice").alias("score"), utc_timestamp(F.max("o_orderdate")).alias("at"))
        write_predictions(prediction_rows(scored, f"models:/{status.lower()}@champion", F.col("at")),
                          folder, "churn_model", RUN_AT, status)
    newest = latest_predictions(read_predictions(spark, f"{folder}/churn_model").drop("run", "model_version"))
    return _zoneless(newest)
