"""Row rules, leakage and completeness checks, and the policy for missing features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from featureline.errors import EmptyDataset, InvalidRows, MissingFeatures
from featureline.functions.exprs import is_missing, parse_iso
from featureline.operators import skew
from featureline.schema import ENTITY_ID, EVENT_TIMESTAMP

ERRORS = "_errors"
SAMPLES = 5
PAIRS = "decimal(38,0)"


@dataclass(frozen=True)
class Rule:
    """``kind``: text (a string), time (timestamp or ISO text), number (numeric or numeric text)."""

    column: str
    kind: str


SPINE_RULES = (Rule(ENTITY_ID, "text"), Rule(EVENT_TIMESTAMP, "time"))
PREDICTION_RULES = (Rule(ENTITY_ID, "text"), Rule("score", "number"), Rule("model_uri", "text"),
                    Rule("predicted_at", "time"))


def _problem(df: DataFrame, rule: Rule) -> Column:
    if rule.column not in df.columns:
        return F.lit(f"{rule.column}: missing")
    col = F.col(rule.column)
    dtype = df.schema[rule.column].dataType
    missing = F.when(col.isNull(), F.lit(f"{rule.column}: missing"))
    is_text = isinstance(dtype, T.StringType)
    if rule.kind == "text":
        return missing if is_text else F.lit(f"{rule.column}: not text")
    if rule.kind == "time":
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return missing
        if is_text:
            return missing.when(parse_iso(col).isNull(), F.lit(f"{rule.column}: not a time"))
        return F.lit(f"{rule.column}: not a time")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return missing
    if is_text:
        return missing.when(col.try_cast("double").isNull(), F.lit(f"{rule.column}: not a number"))
    return F.lit(f"{rule.column}: not a number")


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``_errors``: what is wrong with the row, empty for a good one."""
    return df.withColumn(ERRORS, F.array_compact(F.array(*[_problem(df, rule) for rule in rules])))


def _coerced(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    changed = {}
    for rule in rules:
        dtype = df.schema[rule.column].dataType
        if rule.kind == "time" and isinstance(dtype, T.StringType):
            changed[rule.column] = parse_iso(F.col(rule.column))
        if rule.kind == "number":
            changed[rule.column] = F.col(rule.column).cast("double")
    return df.withColumns(changed) if changed else df


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows with times and numbers converted, rejected rows with ``_errors``)."""
    judged = with_errors(df, rules)
    rejected = judged.filter(F.size(ERRORS) > 0)
    valid = judged.filter(F.size(ERRORS) == 0).drop(ERRORS)
    if any(rule.column not in df.columns for rule in rules):
        return valid, rejected
    return _coerced(valid, rules), rejected


def validate(df: DataFrame, rules: Sequence[Rule], mode: str = "fail") -> DataFrame:
    """Valid rows. One bad row stops the job in ``fail`` mode before it goes on, with the count and some samples,
    and in ``inline`` mode when the row is reached, without a pass of its own. ``split`` leaves bad rows out."""
    if mode == "inline":
        judged = with_errors(df, rules)
        text = F.concat(F.lit("invalid row: "), F.array_join(ERRORS, "; "))
        return _coerced(judged.filter(F.when(F.size(ERRORS) > 0, F.raise_error(text)).otherwise(F.lit(True)))
                        .drop(ERRORS), rules)
    valid, rejected = split_valid(df, rules)
    if mode == "fail":
        samples = rejected.limit(SAMPLES).collect()
        if samples:
            raise InvalidRows(f"{rejected.count()} invalid rows, for example {[r.asDict() for r in samples]}")
    return valid


def not_empty(df: DataFrame, what: str = "merged training dataset") -> DataFrame:
    if df.isEmpty():
        raise EmptyDataset(f"{what} is empty: check that keys and event times of features and labels agree")
    return df


def leakage_report(features: DataFrame, labels: DataFrame, keys: Sequence[str] = (ENTITY_ID,),
                   ts_col: str = EVENT_TIMESTAMP, bucket: timedelta | None = skew.BUCKET) -> DataFrame:
    """One row: pairs (feature row, label row) of one key, and how many have the feature not before the label."""
    return leakage_by_key(features, labels, keys, ts_col, bucket).agg(
        F.coalesce(F.sum("n_pairs"), F.lit(0)).cast(PAIRS).alias("n_pairs"),
        F.coalesce(F.sum("n_leaking"), F.lit(0)).cast(PAIRS).alias("n_leaking"),
    ).withColumn("passed", F.col("n_leaking") == 0)


def leaking_keys(features: DataFrame, labels: DataFrame, keys: Sequence[str] = (ENTITY_ID,),
                 ts_col: str = EVENT_TIMESTAMP, bucket: timedelta | None = skew.BUCKET) -> DataFrame:
    """The keys with at least one feature row that is not before a label, and their counts."""
    return leakage_by_key(features, labels, keys, ts_col, bucket).filter(F.col("n_leaking") > 0)


def leakage_by_key(features: DataFrame, labels: DataFrame, keys: Sequence[str], ts_col: str,
                   bucket: timedelta | None) -> DataFrame:
    """Per key the number of pairs and of leaking pairs.

    The pairs are counted, never formed: per key the rows are reduced to counts per time and a
    running sum over time says how many labels lie at or before each feature. Every key is cut
    into time buckets; each starts from the counts of the buckets before it.
    """
    keys = list(keys)
    def reduced(df: DataFrame, is_feature: int) -> DataFrame:
        return (df.filter(F.col(ts_col).isNotNull() & skew.complete_key(keys))
                .groupBy(*keys, F.col(ts_col).alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
                .withColumns({"_f": F.col("_n") * is_feature, "_l": F.col("_n") * (1 - is_feature)}).drop("_n"))

    times = reduced(features, 1).unionByName(reduced(labels, 0))
    times = times.groupBy(*keys, "_ts").agg(F.sum("_f").alias("_f"), F.sum("_l").alias("_l"))
    number = skew.time_bucket(F.col("_ts"), features.schema[ts_col].dataType, bucket) if bucket else F.lit(0)
    times = times.withColumn("_g", number)
    upto = (Window.partitionBy(*keys, "_g").orderBy("_ts")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = times.withColumn("_seen", F.sum("_l").over(upto))
    per_group = local.groupBy(*keys, "_g").agg(
        F.sum("_f").alias("_f"), F.sum("_l").alias("_l"), F.sum(_times("_f", "_seen")).alias("_leak"))
    before = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_group.withColumn("_earlier", F.coalesce(F.sum("_l").over(before), F.lit(0)))
    per_key = per_group.groupBy(*keys).agg(
        F.sum("_f").alias("_f"), F.sum("_l").alias("_l"),
        (F.sum("_leak") + F.sum(_times("_f", "_earlier"))).cast(PAIRS).alias("n_leaking"))
    return per_key.select(*keys, _times("_f", "_l").cast(PAIRS).alias("n_pairs"), "n_leaking")


def _times(a: str, b: str) -> Column:
    """Product of two counts; pair counts may pass the range of a long."""
    return F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")


def leaking_count(joined: DataFrame, feature_ts: str, label_ts: str) -> DataFrame:
    """The same check on rows that are already joined, for example as-of matches that kept the feature time."""
    return joined.agg(F.count_if(F.col(feature_ts) >= F.col(label_ts)).alias("n_leaking"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the count of missing values (null or NaN) of every column, in one pass."""
    return df.agg(*[F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"{c}_nulls") for c in columns])


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: shape, nulls per feature and whether all features are there."""
    nulls = [F.count_if(is_missing(c, df.schema[c].dataType)) for c in columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
        *[n.alias(f"{c}_nulls") for c, n in zip(columns, nulls)], (total == 0).alias("complete"),
    )


def apply_missing_policy(df: DataFrame, features: Sequence[str], policy: str) -> DataFrame:
    """``fail`` raises, ``drop`` removes incomplete rows, ``impute`` leaves them to the model pipeline."""
    if policy == "impute":
        return df
    if policy == "drop":
        return df.filter(~reduce(or_, [is_missing(c, df.schema[c].dataType) for c in features]))
    if policy != "fail":
        raise ValueError(f"unknown policy {policy!r}")
    counts = null_counts(df, features).first().asDict()
    bad = {name: n for name, n in counts.items() if n}
    if bad:
        raise MissingFeatures(f"null features: {bad}")
    return df
