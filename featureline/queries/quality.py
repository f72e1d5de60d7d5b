"""D1 to D7."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F, types as T

from featureline.operators.asof import historical_features
from featureline.operators.quality import (ERRORS, PREDICTION_RULES, SPINE_RULES, apply_missing_policy, completeness,
                                           leakage_report, leaking_count, leaking_keys, not_empty, split_valid, with_errors)
from featureline.functions.exprs import wall_clock
from featureline.queries import base as b
from featureline.queries.base import query, table
from featureline.sources.tables import as_spine

_RAW_SPINE_SQL = """
raw AS (SELECT event_id,
    CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS entity_id,
    CASE event_type WHEN 'signup' THEN 'not-a-date' WHEN 'click' THEN NULL
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS event_timestamp,
    event_type, ts FROM events)"""


def _raw_spine(spark, sf):
    """Event rows as text; some types lack the key, the time, or carry text that is no time."""
    kind = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select(
        "event_id", F.when(kind != "error", F.col("user_id").cast("string")).alias("entity_id"),
        F.when(kind == "signup", F.lit("not-a-date")).when(kind != "click", iso).alias("event_timestamp"))


@query("d1_spine_errors", f"""
WITH {_RAW_SPINE_SQL}
SELECT event_id, CASE event_type WHEN 'error' THEN 'entity_id: missing'
    WHEN 'signup' THEN 'event_timestamp: not a time' WHEN 'click' THEN 'event_timestamp: missing' ELSE '' END
    AS errors FROM raw""")
def spine_errors(spark, sf):
    judged = with_errors(_raw_spine(spark, sf), SPINE_RULES)
    return judged.select("event_id", F.array_join(ERRORS, "; ").alias("errors"))


@query("d1_valid_spine", f"""
WITH {_RAW_SPINE_SQL}
SELECT event_id, entity_id, date_trunc('second', ts) AS event_timestamp FROM raw
WHERE event_type NOT IN ('error', 'signup', 'click')""")
def valid_spine(spark, sf):
    valid, _ = split_valid(_raw_spine(spark, sf), SPINE_RULES)
    return valid.withColumn("event_timestamp", wall_clock(F.col("event_timestamp")))


_RAW_PREDICTIONS_SQL = """
raw AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS entity_id,
    CASE o_orderstatus WHEN 'P' THEN 'high' WHEN 'O' THEN CAST(o_orderkey % 2 AS VARCHAR) ELSE
      CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE '0.25' END END AS score,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'models:/churn_model@champion' END AS model_uri,
    o_orderdate AS predicted_at, o_orderstatus, o_orderpriority FROM orders)"""


def _raw_predictions(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    score = (F.when(status == "P", F.lit("high")).when(status == "O", (F.col("o_orderkey") % 2).cast("string"))
             .when(priority != "5-LOW", F.lit("0.25")))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"), score.alias("score"),
        F.when(priority != "1-URGENT", F.lit("models:/churn_model@champion")).alias("model_uri"),
        F.col("o_orderdate").alias("predicted_at"))


@query("d2_prediction_errors", f"""
WITH {_RAW_PREDICTIONS_SQL}
SELECT o_orderkey, concat_ws('; ', CASE WHEN score IS NULL THEN 'score: missing'
    WHEN score = 'high' THEN 'score: not a number' END,
    CASE WHEN model_uri IS NULL THEN 'model_uri: missing' END) AS errors FROM raw""")
def prediction_errors(spark, sf):
    judged = with_errors(_raw_predictions(spark, sf), PREDICTION_RULES)
    return judged.select("o_orderkey", F.array_join(ERRORS, "; ").alias("errors"))


@query("d2_valid_predictions", f"""
WITH {_RAW_PREDICTIONS_SQL}
SELECT o_orderkey, entity_id, CAST(score AS DOUBLE) AS score, model_uri, predicted_at FROM raw
WHERE score IS NOT NULL AND score <> 'high' AND model_uri IS NOT NULL""")
def valid_predictions(spark, sf):
    return split_valid(_raw_predictions(spark, sf), PREDICTION_RULES)[0]


@query("d3_utc_spine", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS event_timestamp, epoch_us(ts) AS epoch_us FROM events""")
def utc_spine(spark, sf):
    raw = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("event_timestamp"))
    utc = F.col("event_timestamp")
    return as_spine(raw).select("entity_id", wall_clock(utc).alias("event_timestamp"),
                                F.unix_micros(utc).alias("epoch_us"))


@query("d4_leakage_report", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE f.event_timestamp >= l.event_timestamp) AS n_leaking,
       count(*) FILTER (WHERE f.event_timestamp >= l.event_timestamp) = 0 AS passed
FROM customer_features f JOIN label_times l USING (entity_id)""")
def leakage(spark, sf):
    """The same counts as the pair join, without forming the pairs."""
    report = leakage_report(b.customer_features(spark, sf), b.train_entities(spark, sf))
    return report.withColumns({c: F.col(c).cast("long") for c in ("n_pairs", "n_leaking")})


@query("d4_leaking_keys", """
WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
l AS (SELECT user_id, ts FROM events WHERE event_type = 'signup')
SELECT user_id, count(*) AS n_pairs, count(*) FILTER (WHERE f.ts >= l.ts) AS n_leaking
FROM f JOIN l USING (user_id) GROUP BY user_id HAVING count(*) FILTER (WHERE f.ts >= l.ts) > 0""")
def leaking_users(spark, sf):
    events = table(spark, sf, "events")
    found = leaking_keys(events.filter("event_type = 'view'"), events.filter("event_type = 'signup'"),
                         ["user_id"], "ts")
    return found.withColumns({c: F.col(c).cast("long") for c in ("n_pairs", "n_leaking")})


@query("d4_leakage_many_labels", """
WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
l AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE f.ts >= l.ts) AS n_leaking,
       count(*) FILTER (WHERE f.ts >= l.ts) = 0 AS passed
FROM f JOIN l USING (user_id)""")
def leakage_many_labels(spark, sf):
    """Many labels and many feature rows per key."""
    events = table(spark, sf, "events")
    report = leakage_report(events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"),
                            ["user_id"], "ts")
    return report.withColumns({c: F.col(c).cast("long") for c in ("n_pairs", "n_leaking")})


@query("d4_leakage_of_matches", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}
SELECT count(*) FILTER (WHERE f.event_timestamp >= s.event_timestamp) AS n_leaking
FROM label_times s ASOF LEFT JOIN customer_features f
  ON s.entity_id = f.entity_id AND s.event_timestamp >= f.event_timestamp""")
def leakage_of_matches(spark, sf):
    """The check on the rows an inclusive point-in-time join picked."""
    features = b.customer_features(spark, sf).withColumn("feature_ts", F.col("event_timestamp"))
    view = replace(b.CUSTOMER_VIEW, ttl=None, schema=T.StructType([T.StructField("feature_ts", b.NTZ)]))
    joined = historical_features(b.train_entities(spark, sf), "customer_features:feature_ts", (view,),
                                 {"customer_features": features}, allow_exact=True)
    return leaking_count(joined, "feature_ts", "event_timestamp")


@query("d5_completeness", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) - count(age) AS age_nulls,
  count(*) - count(account_balance) AS account_balance_nulls,
  count(*) - count(num_transactions) AS num_transactions_nulls,
  count(*) - count(days_since_last_txn) AS days_since_last_txn_nulls,
  count(*) = count(age) AND count(*) = count(account_balance) AND count(*) = count(num_transactions)
    AND count(*) = count(days_since_last_txn) AS complete
FROM as_of_labels""")
def complete(spark, sf):
    joined = historical_features(b.train_entities(spark, sf), b.CUSTOMER_FEATURE_REFS, (b.CUSTOMER_VIEW,),
                                 {"customer_features": b.customer_features(spark, sf)})
    return completeness(joined, b.CUSTOMER_VIEW.features)


@query("d6_training_set_guard", f"""
WITH {b.AS_OF_LABELS_SQL} SELECT churned, count(*) AS n FROM training_rows GROUP BY churned""")
def guard(spark, sf):
    return not_empty(b.training_rows(spark, sf)).groupBy("churned").agg(F.count(F.lit(1)).alias("n"))


@query("d7_drop_incomplete", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT * FROM training_rows WHERE age IS NOT NULL AND account_balance IS NOT NULL AND num_transactions IS NOT NULL
  AND days_since_last_txn IS NOT NULL""")
def drop_incomplete(spark, sf):
    return apply_missing_policy(b.training_rows(spark, sf), b.CUSTOMER_VIEW.features, "drop")
