"""A1 to A11."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from featureline.operators.keyed import suffix_join
from featureline.operators.metrics import classification_metrics, roc_auc, scaler_statistics
from featureline.operators.profile import dataset_profile, positive_rate, row_counts, time_range
from featureline.operators.quality import leaking_count, not_empty, null_counts
from featureline.operators.split import class_counts
from featureline.queries import base as b
from featureline.queries.base import query, table

SCORED_SQL = """
scored AS (
  SELECT l.doc_id, lang, toxic, ((l.doc_id * 37) % 101) / 100.0::DOUBLE AS score,
         CAST(((l.doc_id * 37) % 101) / 100.0::DOUBLE > 0.5::DOUBLE AS INTEGER) AS predicted
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def scored_documents(spark, sf):
    """A fixed score per labelled document, with many equal scores; no model needed."""
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(100.0)
    return (table(spark, sf, "labels").select("doc_id", "toxic")
            .join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
            .withColumn("score", score).withColumn("predicted", (F.col("score") > 0.5).cast("int")))


@query("a1_row_counts", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT 'features' AS stage, count(*) AS n_rows FROM customer_features
UNION ALL SELECT 'labels', count(*) FROM churn_labels
UNION ALL SELECT 'merged', count(*) FROM training_rows""")
def stage_counts(spark, sf):
    return row_counts({"features": b.customer_features(spark, sf), "labels": b.churn_labels(spark, sf),
                       "merged": b.training_rows(spark, sf)})


@query("a2_null_counts", f"""
WITH {b.AS_OF_LABELS_SQL}
SELECT count(*) FILTER (WHERE age IS NULL) AS age_nulls,
       count(*) FILTER (WHERE account_balance IS NULL) AS account_balance_nulls,
       count(*) FILTER (WHERE num_transactions IS NULL) AS num_transactions_nulls,
       count(*) FILTER (WHERE days_since_last_txn IS NULL) AS days_since_last_txn_nulls FROM training_rows""")
def nulls(spark, sf):
    return null_counts(b.training_rows(spark, sf), b.CUSTOMER_VIEW.features)


@query("a3_leaking_count", f"""
WITH {b.CUSTOMER_FEATURES_SQL}, {b.LABEL_TIMES_SQL}
SELECT count(*) FILTER (WHERE f.event_timestamp >= l.event_timestamp) AS n_leaking
FROM customer_features f JOIN label_times l USING (entity_id)""")
def leaking(spark, sf):
    joined = suffix_join(b.customer_features(spark, sf).select("entity_id", "event_timestamp"),
                         b.train_entities(spark, sf), ["entity_id"], ("_feature", "_label"))
    return leaking_count(joined, "event_timestamp_feature", "event_timestamp_label")


@query("a4_time_range", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def event_time_range(spark, sf):
    return time_range(table(spark, sf, "events"), "ts")


@query("a5_churn_rate", f"""
WITH {b.CHURN_LABELS_SQL}
SELECT round(avg(CAST(churned AS INTEGER)) * 100, 6) AS positive_pct FROM churn_labels""")
def churn_rate(spark, sf):
    return positive_rate(b.churn_labels(spark, sf), "churned").select(F.round("positive_pct", 6).alias("positive_pct"))


@query("a6_class_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def classes(spark, sf):
    return class_counts(table(spark, sf, "orders"), "o_orderstatus")


_FEATURES = ["age", "account_balance", "num_transactions", "days_since_last_txn"]


@query("a7_scaler_statistics", f"WITH {b.CUSTOMER_FEATURES_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation,
       round(stddev_samp({c}), 6) AS sample_deviation FROM customer_features""" for c in _FEATURES))
def scaler(spark, sf):
    features = b.customer_features(spark, sf)
    sample = scaler_statistics(features, _FEATURES, ddof=1).select(
        "feature", F.round("deviation", 6).alias("sample_deviation"))
    return scaler_statistics(features, _FEATURES).select(
        "feature", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")
    ).join(sample, "feature")


@query("a8_classification_metrics", f"""
WITH {SCORED_SQL}, c AS (
  SELECT lang, count(*) FILTER (WHERE toxic = 1 AND predicted = 1) AS tp,
    count(*) FILTER (WHERE toxic = 0 AND predicted = 1) AS fp,
    count(*) FILTER (WHERE toxic = 1 AND predicted = 0) AS fn,
    count(*) FILTER (WHERE toxic = 0 AND predicted = 0) AS tn FROM scored GROUP BY lang)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score FROM c""")
def metrics_by_language(spark, sf):
    return classification_metrics(scored_documents(spark, sf), "toxic", "predicted", ["lang"]).withColumns({
        "accuracy": F.round("accuracy", 6), "f1_score": F.round("f1_score", 6)})


def _auc_sql(scored: str, truth: str) -> str:
    return f"""
h AS (SELECT score, count(*) FILTER (WHERE {truth}) AS pos, count(*) FILTER (WHERE NOT ({truth})) AS neg
      FROM {scored} GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM h)
SELECT CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
  round(sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc,
  sum(pos) = 0 OR sum(neg) = 0 AS one_class FROM r"""


@query("a9_roc_auc", f"WITH {SCORED_SQL}, {_auc_sql('scored', 'toxic = 1')}")
def auc(spark, sf):
    return roc_auc(scored_documents(spark, sf), "toxic", "score").drop("n_unscored").withColumn("roc_auc", F.round("roc_auc", 9))


@query("a9_roc_auc_many_scores", "WITH o AS (SELECT o_totalprice AS score, o_orderstatus FROM orders), "
       + _auc_sql("o", "o_orderstatus = 'F'"))
def auc_many_scores(spark, sf):
    """Nearly every score differs: the running count goes over score ranges."""
    orders = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("finished"), "o_totalprice")
    return roc_auc(orders, "finished", "o_totalprice", range_scores=5_000).drop("n_unscored").withColumn("roc_auc", F.round("roc_auc", 9))


@query("a10_not_empty", f"WITH {b.AS_OF_LABELS_SQL} SELECT count(*) AS n_rows FROM training_rows")
def guarded(spark, sf):
    return not_empty(b.training_rows(spark, sf)).agg(F.count(F.lit(1)).alias("n_rows"))


_PROFILED = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
             ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("a11_dataset_profile", " UNION ALL ".join(f"""
SELECT 'orders' AS dataset, 'orders.parquet' AS source, 'o_orderstatus' AS targets, 'training' AS context,
  count(*) AS n_rows, {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls,
  CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders"""
       for i, (c, t) in enumerate(_PROFILED)))
def profile(spark, sf):
    return dataset_profile(table(spark, sf, "orders"), "orders", "orders.parquet", "o_orderstatus", digest=False)


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
         "l_linestatus", "l_shipdate"]
_ROW_SQL = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'n')" for c in _LINE)


def _digest_sql(rows: str) -> str:
    parts = [f"CAST(sum(CAST(('0x' || substr(h, {at}, 15)) AS HUGEINT)) AS VARCHAR)" for at in (1, 16)]
    return f"(SELECT {parts[0]} || '-' || {parts[1]} FROM (SELECT md5({_ROW_SQL}) AS h FROM {rows}))"


@query("a11_dataset_digest", f"""
WITH first_ AS (SELECT l_orderkey AS k, l_linenumber AS m FROM lineitem ORDER BY ALL LIMIT 1),
less AS (SELECT * FROM lineitem, first_ WHERE NOT (l_orderkey = k AND l_linenumber = m)),
changed AS (SELECT * REPLACE (CASE WHEN l_orderkey = k AND l_linenumber = m THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem, first_)
SELECT count(*) AS n_rows, {_digest_sql("lineitem")} AS digest, {_digest_sql("lineitem")} AS in_another_order, {_digest_sql("less")} AS without_a_row,
  {_digest_sql("changed")} AS with_a_change FROM lineitem""")
def digest(spark, sf):
    """The digest of all rows, of the rows in another order, without the first row, and with one value changed."""
    rows = table(spark, sf, "lineitem").select(*_LINE)
    key = rows.orderBy("l_orderkey", "l_linenumber").first()
    first = (F.col("l_orderkey") == key["l_orderkey"]) & (F.col("l_linenumber") == key["l_linenumber"])
    changed = rows.withColumn("l_quantity", F.when(first, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    forms = {"digest": rows, "in_another_order": rows.repartition(7, "l_suppkey").sortWithinPartitions("l_quantity"),
             "without_a_row": rows.filter(~first), "with_a_change": changed}
    digests = [dataset_profile(df, "lineitem", "lineitem.parquet", "l_returnflag").limit(1).select(
        *([F.col("n_rows")] if k == "digest" else []), F.col("digest").alias(k)) for k, df in forms.items()]
    return reduce(lambda x, y: x.join(y), digests)
