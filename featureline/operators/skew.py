"""Time buckets that cut every key's rows, and salted joins. No key is counted or collected beforehand.

A window over one key runs in one task. With ``bucket`` set, it runs per (key, time bucket), whatever the key; what a bucket needs from
the ones before it comes from a summary with one row per key and bucket. The width is the caller's: a key's rows within one bucket
are what one task sorts, so it follows from how many rows of the busiest key a task should hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureline.functions.exprs import utc_timestamp

#: Default width of a time bucket.
BUCKET = timedelta(days=30)
NULL_KEY_SPREAD = 1024


def complete_key(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(key).isNotNull() for key in keys])


def time_bucket(ts: Column, dtype: T.DataType, width: timedelta) -> Column:
    """The number of the bucket since 1970 (UTC)."""
    micros = F.unix_micros(utc_timestamp(ts) if isinstance(dtype, T.TimestampNTZType) else ts)
    return F.floor(micros / F.lit(width // timedelta(microseconds=1)))


def spread(df: DataFrame, copies: Column) -> Column:
    """A copy number for a row, from its values and its input partition: a repeated task picks the same one,
    rows of one partition differ by their values, and equal rows by their partition."""
    hashable = [f.name for f in df.schema.fields
                if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable], F.spark_partition_id()), copies).cast("int")


def null_key_group(keys: list[str], otherwise: Column | None = None) -> Column:
    """``otherwise`` (0) for rows with a complete key; rows without one match nothing and are spread out."""
    group = F.lit(0).cast("long") if otherwise is None else otherwise
    return F.when(complete_key(keys), group).otherwise(-1 - F.pmod(F.spark_partition_id(), F.lit(NULL_KEY_SPREAD)))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Equi-join; adaptive execution splits large partitions.

    Where that is not enough, ``salts`` deals each key's left rows over so many groups, and copies the right rows to each: right for
    a small right side, whatever the keys are.
    """
    keys = list(keys)
    if salts <= 1:
        return left.join(right, keys, how)
    salted = left.withColumn("_salt", spread(left, F.lit(salts)))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
