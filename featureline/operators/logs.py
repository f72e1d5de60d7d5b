"""Structured log lines as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureline.functions.exprs import parse_iso

# Fixed fields of every log line; all others are extras.
FIXED = ["timestamp", "level", "logger", "message", "module", "line"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw")


def parse_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Fixed fields as columns, all others in the map ``extra``; lines that are no JSON object are kept and flagged."""
    # A broken line gives a null map or one that lost its tail; the second has no closing brace.
    fields = F.from_json(F.col(raw), "map<string,string>")
    parsed = lines.withColumn("_m", F.when(F.trim(F.col(raw)).endswith("}"), fields))
    bad = F.col("_m").isNull()
    return parsed.select(
        *[c for c in lines.columns],
        parse_iso(F.col("_m")["timestamp"]).alias("timestamp"),
        *[F.col("_m")[name].alias(name) for name in FIXED[1:-1]],
        F.col("_m")["line"].try_cast("int").alias("line"),
        F.map_filter(F.coalesce(F.col("_m"), F.create_map().cast("map<string,string>")),
                     lambda name, _: ~name.isin(FIXED)).alias("extra"),
        bad.alias("malformed"),
    )


def count_by(logs: DataFrame, *names: str) -> DataFrame:
    """Line counts by fixed fields or extras."""
    columns = [F.col(n) if n in logs.columns else F.col("extra")[n].alias(n) for n in names]
    return logs.select(*columns).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
