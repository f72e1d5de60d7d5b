"""W1 to W4."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.operators.alarms import AlarmRule, alarm_states, metric_points
from featureline.operators.asof import historical_features
from featureline.operators.keyed import latest_per_key
from featureline.operators.split import stratified_split
from featureline.queries import base as b
from featureline.queries.base import query, table


@query("w1_last_not_after", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT o.o_orderkey, CAST(o.o_custkey AS VARCHAR) AS entity_id, o.o_orderdate AS event_timestamp,
  CASE WHEN f.event_timestamp >= o.o_orderdate - INTERVAL 365 DAY THEN f.num_transactions END AS num_transactions,
  CASE WHEN f.event_timestamp >= o.o_orderdate - INTERVAL 365 DAY THEN f.days_since_last_txn END
    AS days_since_last_txn
FROM orders o ASOF LEFT JOIN customer_features f
  ON CAST(o.o_custkey AS VARCHAR) = f.entity_id AND o.o_orderdate >= f.event_timestamp""")
def last_not_after(spark, sf):
    """Every order with the state of its customer on that day; a null inside the matched row stays null."""
    spine = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"),
                                              F.col("o_orderdate").alias("event_timestamp"))
    return historical_features(spine, "customer_features:num_transactions,customer_features:days_since_last_txn",
                               (b.CUSTOMER_VIEW,), {"customer_features": b.customer_features(spark, sf)},
                               allow_exact=True)


@query("w2_latest_per_key", """
SELECT * FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest(spark, sf):
    return latest_per_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


def _split_sql(source: str, label: str, key: str) -> str:
    return f"""
WITH n AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
t AS (SELECT c, n, sum(n) OVER () AS total, CAST(ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS val FROM n),
f AS (SELECT *, n * val // total AS base, n * val % total AS rest FROM t),
q AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= val - sum(base) OVER () THEN 1 ELSE 0 END
        AS quota FROM f),
r AS (SELECT {key}, {label}, row_number() OVER (
        PARTITION BY {label} ORDER BY md5(concat_ws(':', '42', CAST({key} AS VARCHAR))), {key}) AS rn FROM {source})
SELECT {key}, {label}, rn <= quota AS is_validation FROM r JOIN q ON c = {label}"""


@query("w3_stratified_split", _split_sql("labels", "quality", "doc_id"))
def split_labels(spark, sf):
    return stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("w3_stratified_split_orders", _split_sql("orders", "o_orderpriority", "o_orderkey"))
def split_orders(spark, sf):
    return stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority",
                            "o_orderkey")


ALARM_RULE = AlarmRule("avg", 18.0, n=5, m=3, missing_breaches=True)


@query("w4_m_of_n", """
WITH p AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "minute",
             CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM events GROUP BY ALL),
g AS (SELECT series, unnest(generate_series(min("minute"), max("minute"), INTERVAL 1 HOUR)) AS "minute"
      FROM p GROUP BY series),
d AS (SELECT g.series, g."minute", p.value, coalesce(p.value > 18, true) AS breaching
      FROM g LEFT JOIN p USING (series, "minute")),
w AS (SELECT *, sum(CAST(breaching AS INTEGER)) OVER f AS b, count(*) OVER f AS seen FROM d
      WINDOW f AS (PARTITION BY series ORDER BY "minute" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series, "minute", round(value, 9) AS value, breaching, CAST(b AS BIGINT) AS breaches,
       seen >= 5 AND b >= 3 AS in_alarm FROM w""")
def m_of_n(spark, sf):
    """Hourly means per event type, alarm at 3 of 5."""
    points = metric_points(table(spark, sf, "events").withColumn("series", F.col("event_type")), ["series"], "ts",
                           F.col("value"), "avg", "hour")
    return alarm_states(points, ["series"], ALARM_RULE, "hour").withColumn("value", F.round("value", 9))
