"""F1 to F15: the column expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from featureline.functions import exprs as e
from featureline.queries import base as b
from featureline.queries.base import query, table
from featureline.queries.scans import _int_sql, _uniform_sql


@query("f01_split_and_join", """
SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(
         o_orderpriority || ' , ' || o_orderstatus || ',, x ', ','), lambda x: trim(x)), lambda x: x <> ''), ',')
         AS items FROM orders""")
def split_and_join(spark, sf):
    text = F.concat(F.col("o_orderpriority"), F.lit(" , "), F.col("o_orderstatus"), F.lit(",, x "))
    return table(spark, sf, "orders").select("o_orderkey", e.join_items(e.non_empty_items(text)).alias("items"))


@query("f02_padded_key", "SELECT c_custkey, printf('cust-%04d', c_custkey) AS entity_id FROM customer")
def padded(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", e.padded_key("cust-", F.col("c_custkey")).alias("entity_id"))


@query("f03_utc_time", "SELECT event_id, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch FROM events")
def utc_time(spark, sf):
    utc = e.utc_timestamp(F.col("ts"))
    return table(spark, sf, "events").select("event_id", e.wall_clock(utc).alias("ts"),
                                             F.unix_seconds(utc).alias("epoch"))


@query("f04_parse_iso", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS parsed FROM events""")
def parse_iso(spark, sf):
    """Errors carry text that is no time; all others ISO text with a zone."""
    text = F.when(F.col("event_type") == "error", F.lit("not-a-date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "events").select("event_id", e.wall_clock(e.parse_iso(text)).alias("parsed"))


@query("f05_minus_days_hours", """
SELECT event_id, ts - to_days(CAST(user_id % 90 AS INTEGER)) - to_hours(user_id % 24) AS earlier FROM events""")
def minus_days_hours(spark, sf):
    user = F.col("user_id")
    return table(spark, sf, "events").select("event_id", e.minus(F.col("ts"), user % 90, user % 24).alias("earlier"))


@query("f06_time_formats", """
SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def time_formats(spark, sf):
    return table(spark, sf, "events").select("event_id", e.run_stamp(F.col("ts")).alias("stamp"),
                                             e.day_text(F.col("ts")).alias("day"))


@query("f07_rounding", """
SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS half_up,
       CAST(round_even(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS half_even FROM orders""")
def rounding(spark, sf):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf, "orders").select("o_orderkey", F.round(price, 1).cast("double").alias("half_up"),
                                             F.bround(price, 1).cast("double").alias("half_even"))


@query("f08_clip", """
SELECT l_orderkey, l_linenumber, greatest(0.02::DOUBLE, least(0.07::DOUBLE, l_discount)) AS clipped FROM lineitem""")
def clipped(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                               e.clip(F.col("l_discount"), 0.02, 0.07).alias("clipped"))


@query("f09_churn_probability", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT entity_id, event_timestamp, CASE WHEN days_since_last_txn IS NOT NULL AND account_balance IS NOT NULL THEN
         round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.2::DOUBLE
         + 0.5::DOUBLE * (days_since_last_txn / 365.0::DOUBLE) - 0.3::DOUBLE * (account_balance / 50000.0::DOUBLE))), 9) END
         AS p
FROM customer_features""")
def churn_probability(spark, sf):
    rows = b.customer_features(spark, sf)
    p = e.churn_probability(F.col("account_balance"), F.col("days_since_last_txn"))
    return rows.select("entity_id", "event_timestamp", F.round(p, 9).alias("p"))


@query("f10_uniform", f"""
SELECT n, {_uniform_sql('x')} AS u, {_int_sql('age', 18, 75)} AS age
FROM (SELECT event_id AS n FROM events)""")
def uniform(spark, sf):
    row = F.col("event_id")
    return table(spark, sf, "events").select(row.alias("n"), e.uniform(42, row, "x").alias("u"),
                                             e.uniform_int(42, row, "age", 18, 75).alias("age"))


@query("f11_widen", """
SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic = 1 AS DOUBLE) AS toxic FROM labels""")
def widen(spark, sf):
    return table(spark, sf, "labels").select("doc_id", e.as_float(F.col("quality")).alias("quality"),
                                             e.as_float(F.col("toxic") == 1).alias("toxic"))


@query("f12_json_round_trip", """
SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       '{"entity_id":"' || CAST(user_id AS VARCHAR) || '","name":"' || event_type || '"}' AS line FROM events""")
def json_round_trip(spark, sf):
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("name")))
    rows = table(spark, sf, "events").withColumn("line", line)
    return rows.select("event_id", F.from_json("line", "entity_id string, name string")["name"].alias("name"),
                       F.get_json_object("props", "$.k").cast("long").alias("k"), "line")


@query("f13_is_null", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT entity_id, event_timestamp, days_since_last_txn IS NULL AS missing FROM customer_features""")
def is_null(spark, sf):
    return b.customer_features(spark, sf).select("entity_id", "event_timestamp",
                                                 e.is_missing("days_since_last_txn", T.LongType()).alias("missing"))


@query("f14_uri_parts", """
WITH uris AS (SELECT page_id, rtrim(url || '//', '/') AS uri FROM pages)
SELECT page_id, uri, CASE WHEN starts_with(uri, 'https://') THEN split_part(substr(uri, 9), '/', 1) END AS bucket,
       CASE WHEN starts_with(uri, 'https://')
         THEN substr(substr(uri, 9), length(split_part(substr(uri, 9), '/', 1)) + 2) END AS key
FROM uris""")
def uri_parts(spark, sf):
    uri = F.col("uri")
    uris = table(spark, sf, "pages").select(
        "page_id", e.strip_trailing_slashes(F.concat(F.col("url"), F.lit("//"))).alias("uri"))
    return uris.select("page_id", "uri", e.uri_bucket(uri, "https://").alias("bucket"),
                       e.uri_key(uri, "https://").alias("key"))


@query("f15_model_uri", """
SELECT c_custkey, 'models:/' || c_name || '@champion' AS model_uri FROM customer""")
def model_uri(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", e.champion_uri(F.col("c_name")).alias("model_uri"))
