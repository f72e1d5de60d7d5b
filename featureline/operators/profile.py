"""Counts, ranges and the dataset profile kept for lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per stage with its row count."""
    stages = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
              for name, df in frames.items()]
    result = stages[0]
    for stage in stages[1:]:
        result = result.unionByName(stage)
    return result


def time_range(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"))


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    """Share of true labels in percent."""
    return df.agg((F.avg(F.col(label).cast("int")) * 100).alias("positive_pct"))


def row_digest(columns: Sequence[str]) -> Column:
    """An aggregate: the sums of two parts (60 bits each) of every row's md5, joined by a hyphen. A row is the text of its values, each with its
    length before it, and n for null."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts])
    part = lambda at: F.sum(F.conv(F.substring(F.md5(whole.cast("binary")), at, 15), 16, 10).cast("decimal(20,0)"))
    return F.concat_ws("-", *[F.coalesce(part(at).cast("string"), F.lit("0")) for at in (1, 16)])


def dataset_profile(df: DataFrame, name: str, source: str, targets: str, context: str = "training",
                    digest: bool = True) -> DataFrame:
    """One row per column: rows, type, nulls, smallest and largest value as text, and a digest of the rows.

    The digest is a sum of row hashes, the same for any order of the rows. It is made of md5 so that any engine that writes values
    as text in the same way can check it. One pass.
    """
    measures: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        measures += [F.count_if(c.isNull()).alias(f"_nulls{i}"), F.min(c).cast("string").alias(f"_min{i}"),
                     F.max(c).cast("string").alias(f"_max{i}")]
    measures.append(row_digest(df.columns).alias("_digest"))
    one = df.agg(*measures)
    columns = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col(f"_nulls{i}").alias("nulls"),
                 F.col(f"_min{i}").alias("min_value"), F.col(f"_max{i}").alias("max_value"))
        for i, f in enumerate(df.schema.fields)
    ])
    head = [F.lit(name).alias("dataset"), F.lit(source).alias("source"), F.lit(targets).alias("targets"),
            F.lit(context).alias("context"), F.col("_n").alias("n_rows")]
    if digest:
        head.append(F.col("_digest").alias("digest"))
    return one.select(*head, F.inline(columns))


def feature_matrix(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(*features, label)


def drop_keys(df: DataFrame, columns: Sequence[str] = ("entity_id", "event_timestamp")) -> DataFrame:
    """Absent names are no error."""
    return df.drop(*columns)


def input_example(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(1)
