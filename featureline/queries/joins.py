"""J1 to J7."""

from __future__ import annotations


from datetime import timedelta

from pyspark.sql import functions as F

from featureline.operators.asof import historical_features
from featureline.operators.keyed import (keyed_insert, keyed_update, latest_per_key, suffix_join, unknown_keys,
                                         unmatched_report)
from featureline.queries import base as b
from featureline.queries.base import query, table

_EVENT_ASOF = """
WITH f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT s.event_id, s.user_id, s.ts, CASE WHEN f.ts >= s.ts - INTERVAL 1 DAY THEN f.value END AS value
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') s
ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts >= f.ts"""


def _purchases(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")


def _views(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'view'").select("user_id", "ts", "value")


@query("j1_asof_ttl", _EVENT_ASOF)
def asof_ttl(spark, sf):
    return historical_features(_purchases(spark, sf), "page_views:value", (b.PAGE_VIEWS,),
                               {"page_views": _views(spark, sf)}, spine_ts="ts", allow_exact=True)


def _order_asof_sql(operator: str) -> str:
    return f"""
WITH f AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS p_orderkey,
                  arg_max(o_totalprice, o_orderkey) AS p_totalprice
           FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey, o_orderdate)
SELECT s.o_orderkey, s.o_custkey, s.o_orderdate, f.p_orderkey, f.p_totalprice
FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') s
ASOF LEFT JOIN f ON s.o_custkey = f.o_custkey AND s.o_orderdate {operator} f.o_orderdate"""


def _order_asof(spark, sf, allow_exact, bucket=timedelta(days=90)):
    orders = table(spark, sf, "orders")
    spine = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    pending = orders.filter("o_orderstatus = 'P'").select(
        "o_custkey", "o_orderdate", F.col("o_orderkey").alias("p_orderkey"), F.col("o_totalprice").alias("p_totalprice"))
    return historical_features(spine, "pending:p_orderkey,pending:p_totalprice", (b.PENDING_ORDERS,),
                               {"pending": pending}, spine_ts="o_orderdate", allow_exact=allow_exact,
                               bucket=bucket)


@query("j1_asof_strict_tiebreak", _order_asof_sql(">"))
def asof_strict(spark, sf):
    return _order_asof(spark, sf, False)


@query("j1_asof_inclusive_tiebreak", _order_asof_sql(">="))
def asof_inclusive(spark, sf):
    return _order_asof(spark, sf, True)


@query("j1_asof_customer_features", f"WITH {b.AS_OF_LABELS_SQL} SELECT * FROM as_of_labels")
def asof_customer_features(spark, sf):
    return historical_features(b.train_entities(spark, sf), b.CUSTOMER_FEATURE_REFS, (b.CUSTOMER_VIEW,),
                               {"customer_features": b.customer_features(spark, sf)})


@query("j1_asof_hot_user", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, ts, event_type, value
           FROM events),
f AS (SELECT user_id, ts, value FROM e WHERE event_type = 'view')
SELECT s.event_id, s.user_id, s.ts, CASE WHEN f.ts >= s.ts - INTERVAL 1 DAY THEN f.value END AS value
FROM (SELECT event_id, user_id, ts FROM e WHERE event_type = 'purchase') s
ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts >= f.ts""")
def asof_hot_user(spark, sf):
    """Half of all rows on one user: every user is cut into time buckets."""
    events = table(spark, sf, "events").withColumn(
        "user_id", F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")))
    spine = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", "value")
    return historical_features(spine, "page_views:value", (b.PAGE_VIEWS,), {"page_views": views}, spine_ts="ts",
                               allow_exact=True, bucket=timedelta(hours=6))


@query("j2_two_views", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}, {b.BASKET_SQL},
first AS (SELECT s.entity_id, s.event_timestamp,
            CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.num_transactions END
              AS customer_features__num_transactions,
            CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.age END
              AS customer_features__age
          FROM label_times s ASOF LEFT JOIN customer_features f
            ON s.entity_id = f.entity_id AND s.event_timestamp > f.event_timestamp)
SELECT s.entity_id, s.event_timestamp, s.customer_features__num_transactions, s.customer_features__age,
  CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 730 DAY THEN f.total_quantity END
    AS basket__total_quantity,
  CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 730 DAY THEN round(f.mean_discount, 6) END
    AS basket__mean_discount
FROM first s ASOF LEFT JOIN basket f ON s.entity_id = f.entity_id AND s.event_timestamp > f.event_timestamp""")
def asof_two_views(spark, sf):
    """Two views with the same key share one shuffle."""
    joined = historical_features(
        b.train_entities(spark, sf),
        "customer_features:num_transactions, basket:total_quantity, basket:mean_discount, customer_features:age",
        (b.CUSTOMER_VIEW, b.BASKET_VIEW),
        {"customer_features": b.customer_features(spark, sf), "basket": b.basket(spark, sf)}, full_names=True)
    return joined.withColumn("basket__mean_discount", F.round("basket__mean_discount", 6))


@query("j2_views_with_different_keys", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}, {b.NATION_DAYS_SQL},
first AS (SELECT s.entity_id, CAST(s.c_nationkey AS BIGINT) AS nation_key, s.event_timestamp,
            CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 365 DAY THEN f.age END AS age
          FROM label_times s ASOF LEFT JOIN customer_features f
            ON s.entity_id = f.entity_id AND s.event_timestamp > f.event_timestamp)
SELECT s.*, CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 30 DAY THEN f.nation_orders END
              AS nation_orders,
  CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 30 DAY THEN round(f.nation_revenue, 2) END
    AS nation_revenue
FROM first s ASOF LEFT JOIN nation_days f
  ON s.nation_key = f.nation_key AND s.event_timestamp > f.event_timestamp""")
def asof_different_keys(spark, sf):
    spine = b.label_times(spark, sf).select(
        "entity_id", F.col("c_nationkey").cast("long").alias("nation_key"), "event_timestamp")
    joined = historical_features(
        spine, ["customer_features:age", "nation_day:nation_orders", "nation_day:nation_revenue"],
        (b.CUSTOMER_VIEW, b.NATION_VIEW),
        {"customer_features": b.customer_features(spark, sf), "nation_day": b.nation_days(spark, sf)})
    return joined.withColumn("nation_revenue", F.round("nation_revenue", 2))


@query("j3_features_with_labels", f"WITH {b.AS_OF_LABELS_SQL} SELECT * FROM training_rows")
def features_with_labels(spark, sf):
    return b.training_rows(spark, sf)


@query("j4_suffix_join", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}
SELECT f.entity_id, f.event_timestamp AS event_timestamp_feature, l.event_timestamp AS event_timestamp_label
FROM customer_features f JOIN label_times l USING (entity_id)""")
def suffixes(spark, sf):
    """Labels have one row per entity, so this join does not multiply rows."""
    return suffix_join(b.customer_features(spark, sf).select("entity_id", "event_timestamp"),
                       b.train_entities(spark, sf), ["entity_id"], ("_feature", "_label"))


@query("j5_keyed_insert", f"""
WITH {b.CATALOG_SQL},
requests AS (SELECT 'model-' || CAST(o_custkey AS VARCHAR) AS model_name, o_orderdate AS requested_at,
                    o_orderkey AS request_id FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY requested_at, request_id) AS rn
           FROM requests)
SELECT model_name, requested_at, request_id,
  CASE WHEN rn = 1 AND model_name NOT IN (SELECT model_name FROM catalog) THEN 'accepted' ELSE 'conflict' END
    AS status
FROM ranked""")
def insert_with_conflicts(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("model_name"),
        F.col("o_orderdate").alias("requested_at"), F.col("o_orderkey").alias("request_id"))
    return keyed_insert(b.catalog_rows(spark, sf), requests, "model_name", ["requested_at", "request_id"])


_UPDATES_SQL = """
updates AS (SELECT 'model-' || CAST(o_custkey AS VARCHAR) AS model_name,
              arg_max(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'rate(' || o_orderstatus || ')' END,
                      (o_orderdate, o_orderkey)) AS raw
            FROM orders GROUP BY o_custkey),
schedules AS (SELECT model_name, CASE WHEN raw <> '' THEN raw END AS cron_schedule FROM updates)"""


def _updates(spark, sf):
    """The last order of a customer sets the schedule; low priority clears it."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("model_name"),
        "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    last = latest_per_key(orders, ["model_name"], "o_orderdate", ["o_orderkey"])
    return last.select("model_name", F.when(F.col("o_orderpriority") != "5-LOW", F.format_string(
        "rate(%s)", "o_orderstatus")).alias("cron_schedule"))


@query("j6_keyed_update", f"""
WITH {b.CATALOG_SQL}, {_UPDATES_SQL}
SELECT c.model_name, c.owner, c.is_active,
  CASE WHEN s.model_name IS NULL THEN c.updated_at ELSE TIMESTAMP '2001-08-02' END AS updated_at,
  CASE WHEN s.model_name IS NULL THEN c.cron_schedule ELSE s.cron_schedule END AS cron_schedule
FROM catalog c LEFT JOIN schedules s ON s.model_name = c.model_name""")
def update_schedules(spark, sf):
    return keyed_update(b.catalog_rows(spark, sf), _updates(spark, sf), "model_name", ["cron_schedule"],
                        {"updated_at": b.ntz("2001-08-02 00:00:00")})


@query("j6_unknown_names", f"""
WITH {b.CATALOG_SQL}, {_UPDATES_SQL}
SELECT model_name, cron_schedule FROM schedules WHERE model_name NOT IN (SELECT model_name FROM catalog)""")
def update_unknown(spark, sf):
    return unknown_keys(b.catalog_rows(spark, sf), _updates(spark, sf), "model_name")


@query("j7_unmatched_report", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}
SELECT (SELECT count(*) FROM customer_features) AS n_features,
       (SELECT count(*) FROM label_times) AS n_labels,
       (SELECT count(*) FROM customer_features JOIN label_times USING (entity_id, event_timestamp)) AS n_merged,
       (SELECT count(*) FROM customer_features f ANTI JOIN label_times l USING (entity_id, event_timestamp))
         AS n_features_unmatched,
       (SELECT count(*) FROM label_times l ANTI JOIN customer_features f USING (entity_id, event_timestamp))
         AS n_labels_unmatched""")
def unmatched(spark, sf):
    return unmatched_report(b.customer_features(spark, sf), b.train_entities(spark, sf),
                            ["entity_id", "event_timestamp"])
