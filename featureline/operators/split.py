"""Exact stratified split, repeatable under any partitioning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureline.session import work_dir

DIGITS = (4, 8, 32, 48)
MAX_TIED = 1_000_000


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def validation_quota(counts: DataFrame, label: str, share: float) -> DataFrame:
    """Rows of each class that go to validation: ``ceil(share * n)`` shared out by largest remainder.

    ``counts`` has one row per class, so the windows without keys see only the classes.
    """
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    sized = counts.select(
        label, "n", total.alias("_total"),
        # The rounding keeps 0.2 * 1000 at 200 although 0.2 is not exact in binary.
        F.ceil(F.round(total * F.lit(share), 9)).alias("_val"),
    ).withColumn("_product", F.col("n").cast("decimal(18,0)") * F.col("_val").cast("decimal(18,0)"))
    sized = sized.withColumns({"_base": F.expr("_product div _total"), "_rest": F.expr("_product % _total")})
    rank = F.row_number().over(everything.orderBy(F.col("_rest").desc(), F.col(label)))
    extra = F.col("_val") - F.sum("_base").over(everything)
    return sized.select(label, "n", (F.col("_base") + F.when(rank <= extra, 1).otherwise(0)).alias("n_validation"))


def order_hash(seed: int, row_key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_key.cast("string")))


def stratified_split(df: DataFrame, label: str, row_key: Column | str, share: float = 0.2, seed: int = 42,
                     max_tied: int = MAX_TIED) -> DataFrame:
    """Adds ``is_validation``: exactly the quota of each class, picked in order of a seeded hash of the row key, then of the whole row.

    No class is sorted as a whole. A histogram over the first hex digits of the hash finds the
    bucket in which a class reaches its quota, and only the rows of that bucket are ranked. While
    a bucket holds more than ``max_tied`` rows, it is cut finer by the next digits. If that many
    rows share all digits they are equal in every column; then a stored row number cuts them, and it makes no difference which are
    picked. ``max_tied`` changes the plan, never the rows.
    """
    key = F.col(row_key) if isinstance(row_key, str) else row_key
    whole_row = F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")
    hashed = df.withColumn("_h", F.concat(order_hash(seed, key), whole_row))
    done = None
    digits = DIGITS[0]
    bucket = F.substring("_h", 1, digits)
    cuts = _cuts(hashed.withColumn("_b", bucket), label, _quota(hashed, label, share))
    for finer in DIGITS[1:]:
        if cuts.largest <= max_tied:
            break
        inside = cuts.mark(hashed, label).filter(F.substring("_h", 1, digits) == F.col("_cut"))
        cuts = _cuts(inside.withColumn("_b", F.substring("_h", 1, finer)).drop("_cut", "_need"), label, cuts.quota())
        digits = finer
    placed = cuts.mark(hashed, label).withColumn("_b", F.substring("_h", 1, digits))
    clear = placed.filter(F.col("_b") != F.col("_cut")).withColumn("is_validation", F.col("_b") < F.col("_cut"))
    tied = placed.filter(F.col("_b") == F.col("_cut"))
    if cuts.largest > max_tied:
        done, tied = _split_copies(tied, label, cuts)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h"))
    tied = tied.withColumn("is_validation", rank <= F.col("_need"))
    parts = [clear, tied] + ([done] if done is not None else [])
    return reduce(DataFrame.unionByName, [p.select(*df.columns, "is_validation") for p in parts])


def _quota(hashed: DataFrame, label: str, share: float) -> DataFrame:
    return validation_quota(class_counts(hashed, label), label, share).select(
        F.col(label).alias("_l"), F.col("n_validation").alias("_quota"))


@dataclass(frozen=True)
class _Cuts:
    """Per class (``_l``): the bucket ``_cut`` in which the quota is reached and the rows ``_need``ed from it."""

    table: DataFrame
    largest: int

    def mark(self, rows: DataFrame, label: str) -> DataFrame:
        return rows.join(self.table, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")

    def quota(self) -> DataFrame:
        return self.table.select("_l", F.col("_need").alias("_quota"))


def _cuts(rows: DataFrame, label: str, quota: DataFrame) -> _Cuts:
    """One histogram over ``_b`` per class."""
    histogram = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("n"))
    upto = (Window.partitionBy(label).orderBy("_b")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = histogram.withColumn("_upto", F.sum("n").over(upto)).join(
        quota, F.col(label).eqNullSafe(F.col("_l")))
    need = F.col("_quota") - (F.col("_upto") - F.col("n"))
    first = filled.filter(F.col("_upto") >= F.col("_quota")).groupBy("_l").agg(
        F.min(F.struct("_b", need.alias("need"), "n")).alias("_first"))
    cuts = first.select("_l", F.col("_first._b").alias("_cut"), F.col("_first.need").alias("_need"),
                        F.col("_first.n").alias("_n"))
    # One row per class, written once; Spark knows its size and picks the join.
    spark = rows.sparkSession
    folder = work_dir(spark, "cuts")
    cuts.write.parquet(folder)
    cuts = spark.read.parquet(folder)
    largest = cuts.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    return _Cuts(cuts.drop("_n"), largest)


def _split_copies(tied: DataFrame, label: str, cuts: _Cuts) -> tuple[DataFrame, DataFrame]:
    """Rows of one hash, cut by a row number that is stored first, so that every pass sees the same numbers."""
    spark = tied.sparkSession
    folder = work_dir(spark, "copies")
    (tied.drop("_need", "_cut", "_b")
     .withColumn("_r", F.md5(F.monotonically_increasing_id().cast("string"))).write.parquet(folder))
    numbered = spark.read.parquet(folder)
    finer = numbered.withColumn("_b", F.substring("_r", 1, DIGITS[0]))
    cuts = _cuts(finer, label, cuts.quota())
    placed = cuts.mark(finer, label)
    clear = placed.filter(F.col("_b") != F.col("_cut")).withColumn("is_validation", F.col("_b") < F.col("_cut"))
    return clear, placed.filter(F.col("_b") == F.col("_cut"))
