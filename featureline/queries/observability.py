"""O1 to O3."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.functions.exprs import wall_clock
from featureline.operators.alarms import THROTTLES, UTILISATION, alarm_states, dashboard, metric_points
from featureline.operators.logs import count_by, parse_lines, read_lines
from featureline.queries.base import query, table
from featureline.session import work_dir


def _log_lines(spark, sf):
    """One log line per event, written as text; signup lines lost their end."""
    kind = F.col("event_type")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.upper(kind).alias("level"),
        F.lit("job.run").alias("logger"), kind.alias("message"), F.lit("run").alias("module"),
        F.pmod("event_id", F.lit(500)).cast("int").alias("line"), F.col("event_id").cast("string").alias("run_id"),
        F.get_json_object("props", "$.k").alias("k")))
    broken = F.when(kind == "signup", F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    folder = work_dir(spark, "logs")
    table(spark, sf, "events").select(broken.alias("value")).write.text(folder)
    return read_lines(spark, folder)


@query("o1_log_table", """
SELECT CASE WHEN ok THEN date_trunc('second', ts) END AS "timestamp", CASE WHEN ok THEN upper(event_type) END AS level,
  CASE WHEN ok THEN 'job.run' END AS logger, CASE WHEN ok THEN event_type END AS message,
  CASE WHEN ok THEN 'run' END AS module, CASE WHEN ok THEN CAST(event_id % 500 AS INTEGER) END AS line,
  CASE WHEN ok THEN CAST(event_id AS VARCHAR) END AS run_id,
  CASE WHEN ok THEN json_extract_string(props, '$.k') END AS k, CASE WHEN ok THEN 2 ELSE 0 END AS n_extra,
  NOT ok AS malformed
FROM (SELECT *, event_type <> 'signup' AS ok FROM events)""")
def log_table(spark, sf):
    logs = parse_lines(_log_lines(spark, sf))
    return logs.select(
        wall_clock(F.col("timestamp")).alias("timestamp"), "level", "logger", "message", "module", "line",
        F.col("extra")["run_id"].alias("run_id"), F.col("extra")["k"].alias("k"),
        F.size("extra").alias("n_extra"), "malformed")


@query("o1_log_counts", """
SELECT CASE WHEN event_type <> 'signup' THEN upper(event_type) END AS level,
       CASE WHEN event_type <> 'signup' THEN json_extract_string(props, '$.k') END AS k, count(*) AS n
FROM events GROUP BY ALL""")
def log_counts(spark, sf):
    return count_by(parse_lines(_log_lines(spark, sf)), "level", "k")


def _alarm_sql(value: str, threshold: float, n: int, m: int, missing: str, kinds: str = "true",
               until: str = 'max("minute")') -> str:
    return f"""
WITH p AS (SELECT event_type AS series, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS "minute", {value} AS value
           FROM events WHERE {kinds} GROUP BY ALL),
g AS (SELECT series, unnest(generate_series(min("minute"), {until}, INTERVAL 1 MINUTE)) AS "minute"
      FROM p GROUP BY series),
d AS (SELECT g.series, g."minute", p.value, coalesce(p.value > {threshold}, {missing}) AS breaching
      FROM g LEFT JOIN p USING (series, "minute")),
w AS (SELECT *, sum(CAST(breaching AS INTEGER)) OVER f AS b, count(*) OVER f AS seen FROM d
      WINDOW f AS (PARTITION BY series ORDER BY "minute" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
SELECT series, "minute", round(value, 9) AS value, breaching, CAST(b AS BIGINT) AS breaches,
       seen >= {n} AND b >= {m} AS in_alarm FROM w"""


_MEAN = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*)"
_SUM = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


def _series(spark, sf):
    return table(spark, sf, "events").withColumn("series", F.col("event_type"))


@query("o2_utilisation_alarm", _alarm_sql(_MEAN, 80, 5, 5, "true"))
def utilisation_alarm(spark, sf):
    points = metric_points(_series(spark, sf), ["series"], "ts", F.col("value"), UTILISATION.statistic)
    return alarm_states(points, ["series"], UTILISATION).withColumn("value", F.round("value", 9))


_CLICKS_END = "(SELECT min(ts) + INTERVAL 2 HOUR FROM events)"


@query("o2_silent_series_alarm", _alarm_sql(
    _MEAN, 80, 5, 5, "true", f"event_type <> 'click' OR ts < {_CLICKS_END}",
    "(SELECT CAST(date_trunc('minute', max(ts)) AS TIMESTAMP) FROM events)"))
def silent_series_alarm(spark, sf):
    """One series stops after two hours; up to the last event of all its missing minutes are breaches."""
    events = _series(spark, sf)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    kept = events.filter((F.col("event_type") != "click") | (F.col("ts") < F.lit(first) + F.expr("INTERVAL 2 HOURS")))
    points = metric_points(kept, ["series"], "ts", F.col("value"), UTILISATION.statistic)
    return alarm_states(points, ["series"], UTILISATION, until=F.lit(last)).withColumn("value", F.round("value", 9))


@query("o2_throttle_alarm", _alarm_sql(_SUM, 0, 1, 1, "false"))
def throttle_alarm(spark, sf):
    points = metric_points(_series(spark, sf), ["series"], "ts", F.col("value"), THROTTLES.statistic)
    return alarm_states(points, ["series"], THROTTLES).withColumn("value", F.round("value", 9))


@query("o3_dashboard", f"""
SELECT 'cpu' AS series, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS "minute", round({_MEAN}, 9) AS value
FROM events WHERE event_type = 'view' GROUP BY ALL
UNION ALL SELECT 'memory', CAST(date_trunc('minute', ts) AS TIMESTAMP), round({_MEAN}, 9)
FROM events WHERE event_type = 'click' GROUP BY ALL
UNION ALL SELECT 'connections', CAST(date_trunc('minute', ts) AS TIMESTAMP), CAST(count(*) AS DOUBLE)
FROM events GROUP BY ALL
UNION ALL SELECT 'throttles', CAST(date_trunc('minute', ts) AS TIMESTAMP), CAST(count(*) AS DOUBLE)
FROM events WHERE event_type = 'error' AND value > 50 GROUP BY ALL
UNION ALL SELECT 'errors', CAST(date_trunc('minute', ts) AS TIMESTAMP), CAST(count(*) AS DOUBLE)
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def minute_dashboard(spark, sf):
    kind, value, one = F.col("event_type"), F.col("value"), F.lit(1)
    widgets = {
        "cpu": (kind == "view", value, "avg"), "memory": (kind == "click", value, "avg"),
        "connections": (F.lit(True), one, "sum"), "throttles": ((kind == "error") & (value > 50), one, "sum"),
        "errors": (kind == "error", one, "sum"),
    }
    return dashboard(table(spark, sf, "events"), "ts", widgets).withColumn("value", F.round("value", 9))
