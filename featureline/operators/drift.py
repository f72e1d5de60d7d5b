"""Feature drift from quantile sketches that are stored per feature and period and merged over any range.

A sketch counts values in buckets whose width grows with the value: bucket i holds what lies in (g ** (i - 1), g ** i] with
g = (1 + a) / (1 - a), so a value is known to a relative error of ``a``. Buckets are counts, so merging adds them up: merged
sketches and a sketch of all rows are the same. Doubles have some 70,000 buckets for ``a`` = 1 %, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Relative error of a value.
ERROR = 0.01
#: Added to bucket numbers, so that those of positive values are positive and those of negative ones negative.
SHIFT = 100_000
INFINITE = 10 * SHIFT
#: Common limits: a population stability index above 0.2 or a Kolmogorov distance above 0.1 means drift.
PSI_LIMIT, DISTANCE_LIMIT = 0.2, 0.1


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = ERROR) -> Column:
    """The bucket of a number: in the order of values, 0 for zero, null for null and NaN."""
    value = value.cast("double")
    size = F.ceil(F.ln(F.abs(value)) / F.lit(math.log(_gamma(error)))).cast("int") + SHIFT
    return (F.when(value.isNull() | F.isnan(value), None).when(value == 0, 0)
            .when(F.abs(value) == float("inf"), F.signum(value).cast("int") * INFINITE)
            .otherwise(F.signum(value).cast("int") * size))


def value_of(bucket: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket: at most ``error`` away from any value in it, in proportion."""
    g = _gamma(error)
    size = F.pow(F.lit(g), (F.abs(bucket) - SHIFT).cast("double")) * (2 / (g + 1))
    return F.when(bucket == 0, 0.0).when(F.abs(bucket) == INFINITE, F.signum(bucket) * float("inf")).otherwise(F.signum(bucket) * size)


def feature_sketches(df: DataFrame, features: Sequence[str], period: Column, error: float = ERROR) -> DataFrame:
    """One row per feature and period: rows, rows without a value, and the sketch. Rows shrink to buckets before the shuffle."""
    tall = df.select(period.alias("period"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), bucket_of(F.col(f"`{c}`"), error).alias("bucket")) for c in features])))
    counts = tall.groupBy("feature", "period", "bucket").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("bucket").isNotNull()
    return counts.groupBy("feature", "period").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.array_sort(F.collect_list(F.when(known, F.struct("bucket", "n")))).alias("sketch"))


def merged_buckets(sketches: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """The counts per bucket of the sketches of each group."""
    return sketches.select(*by, F.inline("sketch")).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """One sketch for each group of stored ones, in the same form."""
    totals = sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"))
    buckets = merged_buckets(sketches, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sketch"))
    return totals.join(buckets, list(by), "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<struct<bucket:int,n:bigint>>")))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ("feature",), error: float = ERROR) -> DataFrame:
    """The lower quantiles of merged sketches, one row per group and share."""
    inside = Window.partitionBy(*by).orderBy("bucket")
    running = merged_buckets(sketches, by).withColumns({
        "_to": F.sum("n").over(inside), "_all": F.sum("n").over(Window.partitionBy(*by))})
    share = running.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    # The value of rank ceil(share * n), the first one for a share of 0.
    rank = F.greatest(F.ceil(F.col("share") * F.col("_all")), F.lit(1))
    return share.where((F.col("_to") >= rank) & (F.col("_to") - F.col("n") < rank)).select(*by, "share", value_of(F.col("bucket"), error).alias("value"))


def feature_drift(baseline: DataFrame, current: DataFrame, bins: int = 10, psi_limit: float = PSI_LIMIT,
                  distance_limit: float = DISTANCE_LIMIT) -> DataFrame:
    """One row per feature and period of ``current``: stability index and largest distance of the distribution functions.

    Both take sketches; those of ``baseline`` are merged, those of one period of ``current`` too. The bins of the index are cut where the
    baseline's shares pass multiples of 1 / ``bins``, at borders of buckets; half a row is added to each count, so that none is empty.
    Null where one of the two has no values.
    """
    base = merged_buckets(baseline)
    now = merged_buckets(current, ["feature", "period"])
    periods = current.groupBy("feature", "period").agg(F.sum("n_rows").alias("n_current"), F.sum("n_missing").alias("n_missing"))
    # One row per bucket of a sketch and period, whatever the number of rows behind them.
    both = now.select("feature", "period", "bucket", F.col("n").alias("now"), F.lit(0).cast("long").alias("base")).unionByName(
        base.join(periods.select("feature", "period"), "feature").select("feature", "period", "bucket", F.lit(0).cast("long").alias("now"),
                                                                         F.col("n").alias("base")))
    group = Window.partitionBy("feature", "period")
    buckets = both.groupBy("feature", "period", "bucket").agg(F.sum("now").alias("now"), F.sum("base").alias("base"))
    running = group.orderBy("bucket")
    placed = buckets.withColumns({
        "now_to": F.sum("now").over(running), "base_to": F.sum("base").over(running),
        "n_now": F.sum("now").over(group), "n_base": F.sum("base").over(group)})
    placed = placed.withColumns({
        "bin": F.when(F.col("n_base") > 0, F.least(F.lit(bins - 1), F.expr(f"{bins} * (base_to - base) div nullif(n_base, 0)"))),
        "gap": F.abs(F.try_divide("now_to", "n_now") - F.try_divide("base_to", "n_base"))})
    binned = placed.groupBy("feature", "period", "bin").agg(
        F.sum("now").alias("now"), F.sum("base").alias("base"), F.max("gap").alias("gap"),
        F.first("n_now").alias("n_now"), F.first("n_base").alias("n_base"))
    used = F.count(F.lit(1)).over(group)
    half = lambda n, total: (F.col(n) + 0.5) / (F.col(total) + 0.5 * F.col("used"))
    shares = binned.withColumn("used", used).withColumns({"p": half("now", "n_now"), "q": half("base", "n_base")})
    found = shares.groupBy("feature", "period").agg(
        F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"), F.max("gap").alias("distance"),
        F.first("n_now").alias("n_now"), F.first("n_base").alias("n_base"))
    valid = (F.col("n_now") > 0) & (F.col("n_base") > 0)
    psi, distance = F.when(valid, F.col("psi")), F.when(valid, F.col("distance"))
    return periods.join(found, ["feature", "period"], "left").select(
        "feature", "period", "n_current", "n_missing", psi.alias("psi"), distance.alias("distance"),
        F.coalesce((psi > psi_limit) | (distance > distance_limit), F.lit(False)).alias("drifted"))
