"""T1, T2 and R6."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.functions.exprs import wall_clock
from featureline.queries import base as b
from featureline.queries.base import query
from featureline.operators.alarms import UTILISATION, AlarmRule
from featureline.session import work_dir
from featureline.sources.online import OnlineTable
from featureline.streaming.alarm import alarm_stream, minute_metrics, start_alarm_stream
from featureline.streaming.decay import histograms, start_decay_stream, weekly_metrics, with_late_labels
from featureline.streaming.silence import run_silence_alarms, silence_alarms
from featureline.streaming.materialize import feature_stream, materialize_stream


@query("t1_stream_materialize", f"""
WITH {b.CUSTOMER_FEATURES_SQL}
SELECT * FROM customer_features QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_timestamp DESC) = 1""")
def stream_materialize(spark, sf):
    """Feature files in any order, a few per micro-batch, into the online table."""
    folder = work_dir(spark, "stream")
    b.customer_features(spark, sf).write.option("maxRecordsPerFile", 1_000_000).parquet(f"{folder}/features")
    online = OnlineTable(spark, f"{folder}/online", b.CUSTOMER_VIEW)
    stream = feature_stream(spark, b.CUSTOMER_VIEW, f"{folder}/features", files_per_batch=4)
    materialize_stream(stream, online, f"{folder}/checkpoint").awaitTermination()
    return online.read()


STREAM_RULE = AlarmRule("avg", 10.0, n=5, m=3, missing_breaches=False)


@query("t2_stream_alarm", """
WITH p AS (SELECT event_type AS series, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS "minute",
             CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
           FROM events GROUP BY ALL
           HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE
                  <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR),
g AS (SELECT series, unnest(generate_series(min("minute"), max("minute"), INTERVAL 1 MINUTE)) AS "minute"
      FROM p GROUP BY series),
d AS (SELECT g.series, g."minute", p.value, coalesce(p.value > 10, false) AS breaching
      FROM g LEFT JOIN p USING (series, "minute")),
w AS (SELECT *, sum(CAST(breaching AS INTEGER)) OVER f AS b, count(*) OVER f AS seen FROM d
      WINDOW f AS (PARTITION BY series ORDER BY "minute" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series, "minute", round(value, 9) AS value, breaching, CAST(b AS BIGINT) AS breaches,
       seen >= 5 AND b >= 3 AS in_alarm FROM w""")
def stream_alarm(spark, sf):
    """All events as a stream; minutes the watermark has not passed at the end are still open."""
    folder = work_dir(spark, "alarms")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    points = minute_metrics(events, F.col("event_type"), F.col("ts"), F.col("value"), STREAM_RULE.statistic, "1 hour")
    alarms = alarm_stream(points, STREAM_RULE)
    start_alarm_stream(alarms, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumns({
        "minute": wall_clock(F.col("minute")), "value": F.round("value", 9)})


_BY_BIN_SQL = """
hist AS (SELECT date_trunc('week', o_orderdate) AS week, greatest(0, least(99, CAST(floor(score * 100) AS INTEGER))) AS bin, label, count(*) AS n
  FROM decided GROUP BY ALL),
bins AS (SELECT week, bin, sum(n) AS n, coalesce(sum(n) FILTER (label), 0) AS pos, coalesce(sum(n) FILTER (NOT label), 0) AS neg FROM hist GROUP BY ALL),
ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY week ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bins),
sums AS (SELECT week, sum(n) AS n, sum(pos) AS p, sum(neg) AS q, coalesce(sum(pos) FILTER (bin >= 50), 0) AS tp,
  coalesce(sum(neg) FILTER (bin >= 50), 0) AS fp, sum(pos * (2 * below + neg)) AS wins FROM ranked GROUP BY week)
SELECT CAST(week AS TIMESTAMP) AS week, CAST(n AS BIGINT) AS n_predictions, CAST(p + q AS BIGINT) AS n_labelled, CAST(p AS BIGINT) AS n_positive,
  round(CASE WHEN p + q > 0 THEN (tp + q - fp) / (p + q) END, 9) AS accuracy,
  round(CASE WHEN p + q > 0 THEN CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END END, 9) AS f1_score,
  round(CASE WHEN p > 0 AND q > 0 THEN wins / (2.0::DOUBLE * p * q) END, 9) AS roc_auc FROM sums"""


@query("r6_accuracy_decay", f"""
WITH labels_ AS (SELECT l_orderkey, l_shipdate, l_returnflag = 'R' AS label FROM lineitem WHERE l_linenumber = 1),
watermark AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM labels_)) - INTERVAL 252 HOUR AS mark),
decided AS (SELECT o_orderdate, ((o_orderkey * 37) % 101) / 100.0::DOUBLE AS score, label
  FROM orders LEFT JOIN labels_ ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 365 DAY
  WHERE label IS NOT NULL OR o_orderdate + INTERVAL 365 DAY < (SELECT mark FROM watermark)), {_BY_BIN_SQL}""")
def accuracy_decay(spark, sf):
    """A score per order, and as its label whether its first line came back, known when that line was shipped."""
    folder = work_dir(spark, "decay")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema) \
        .option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    predictions = read("orders").select("o_orderkey", F.col("o_orderdate").alias("predicted_at"),
                                        (F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / F.lit(100.0)).alias("score"))
    labels = read("lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("labelled_at"), (F.col("l_returnflag") == "R").alias("label"))
    decided = with_late_labels(predictions, labels, "o_orderkey", "365 DAYS", "252 hours")
    start_decay_stream(decided, f"{folder}/histograms", f"{folder}/checkpoint").awaitTermination()
    return weekly_metrics(histograms(spark, f"{folder}/histograms")).withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "f1_score", "roc_auc")})


_MARK_SQL = "(SELECT date_trunc('milliseconds', max(ts)) FROM heard) - INTERVAL 1 HOUR"


@query("t2_silent_series_stream", f"""
WITH heard AS (SELECT * FROM events WHERE event_type <> 'click' OR ts < (SELECT min(ts) + INTERVAL 2 HOUR FROM events)),
p AS (SELECT event_type AS series, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS "minute",
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
      FROM heard GROUP BY ALL HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= {_MARK_SQL}),
g AS (SELECT series, unnest(generate_series(min("minute"), CAST(date_trunc('minute', {_MARK_SQL}) AS TIMESTAMP) - INTERVAL 1 MINUTE,
        INTERVAL 1 MINUTE)) AS "minute" FROM p GROUP BY series),
d AS (SELECT g.series, g."minute", p.value, coalesce(p.value > 80, true) AS breaching FROM g LEFT JOIN p USING (series, "minute")),
w AS (SELECT *, sum(CAST(breaching AS INTEGER)) OVER f AS b, count(*) OVER f AS seen FROM d
      WINDOW f AS (PARTITION BY series ORDER BY "minute" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series, "minute", round(value, 9) AS value, breaching, CAST(b AS BIGINT) AS breaches, seen >= 5 AND b >= 5 AS in_alarm FROM w""")
def silent_series_stream(spark, sf):
    """One series stops after two hours; timers judge its missing minutes as the watermark goes on."""
    folder = work_dir(spark, "silence")
    source = spark.read.parquet(f"{sf}/events.parquet")
    stop = source.agg(F.min("ts")).first()[0]
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    heard = events.filter((F.col("event_type") != "click") | (F.col("ts") < F.lit(stop) + F.expr("INTERVAL 2 HOURS")))
    alarms = silence_alarms(heard, F.col("event_type"), F.col("ts"), F.col("value"), UTILISATION, "1 hour")
    run_silence_alarms(alarms, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").withColumns({"minute": wall_clock(F.col("minute")), "value": F.round("value", 9)})
