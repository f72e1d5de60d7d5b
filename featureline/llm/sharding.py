"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking.

Rows get gapless numbers in the order of their key. A keyed Feistel network permutes a domain ``a * b`` just above the
number of rows N; a number that lands at N or beyond is permuted again until it lands below. Row number p then lies in
shard ``p % shards`` at slot ``p // shards``, so shard sizes are at most one apart, slots have no gaps, and both can be
computed for a row number without the data.

Numbering needs no global window: rows are sorted in key ranges and written to the shared folder with their place in
their range, and the ranges' sizes (one row per range) give the offsets. Equal keys are ordered by a hash of the whole
row; rows equal in every column are interchangeable. Null keys come first. Null texts have no bytes and checksum 0.
Empty tables give empty ones.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from featureline.llm.frames import others
from featureline.session import work_dir

ROUNDS = 6
#: The column of row numbers.
NUMBER = "__featureline_number"
#: Most passes a number walks. A pass ends outside with a chance below 1 / sqrt(N), and small domains have fewer outside
#: places than this; a row that were still outside stops the job.
WALK = 64


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of each row number below ``n`` in the permutation that ``seed`` names."""
    a = isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)

    def rounds(x: Column) -> Column:
        def one(state: Column, i: Column) -> Column:
            left, right = state["l"], state["r"]
            mixed = F.xxhash64(F.lit(seed), i, F.when(i % 2 == 0, right).otherwise(left))
            return F.when(i % 2 == 0, F.struct(F.pmod(left + F.pmod(mixed, F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))) \
                .otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(mixed, F.lit(b)), F.lit(b)).alias("r")))

        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one,
                           lambda s: s["l"] * F.lit(b) + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(number), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a row number stayed outside of the table")).cast("long"))


def _hashable(field: T.StructField):
    """A column as ``xxhash64`` takes it: maps and variants, also inside other types, as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if any(kind in field.dataType.simpleString() for kind in ("map<", "variant")) else column


def numbered(rows: DataFrame, *keys: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """The rows with gapless numbers (``NUMBER``) in the order of the keys, and how many there are."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*map(_hashable, rows.schema.fields))
    # The last key only deals rows that are equal in everything over several ranges.
    by = [*(F.col(f"`{k}`") for k in keys), F.col("__featureline_tie"), F.col("__featureline_spread")]
    placed = rows.withColumns({"__featureline_tie": tie, "__featureline_spread": F.monotonically_increasing_id()}) \
        .repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("__featureline_tie", "__featureline_spread") \
        .withColumn("__featureline_place", F.monotonically_increasing_id())
    path = work_dir(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    places = 1 << 33  # a range's number is above this bit of the place, the place in the range below
    sizes = placed.groupBy(F.floor(F.col("__featureline_place") / places).alias("__featureline_range")).agg(F.count("*").alias("__featureline_n"))
    before = F.sum("__featureline_n").over(Window.orderBy("__featureline_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__featureline_range", F.coalesce(before, F.lit(0)).alias("__featureline_before"))  # one row per range
    out = placed.withColumn("__featureline_range", F.floor(F.col("__featureline_place") / places)).join(F.broadcast(offsets), "__featureline_range") \
        .withColumn(NUMBER, F.col("__featureline_before") + F.pmod("__featureline_place", F.lit(places)))
    return out.drop("__featureline_range", "__featureline_before", "__featureline_place"), placed.count()


def feistel_shards(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds size (UTF-8 bytes plus 16), text_crc32, shard and slot to every row; ``text`` stays behind."""
    bare = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = others(docs, text, "size", "text_crc32", "shard", "slot")
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), (F.octet_length(bare) + 16).cast("long").alias("size"),
                       F.crc32(bare.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, key)
    place = rows.withColumn("__featureline_p", permuted(F.col(NUMBER), n, seed) if n else F.lit(0).cast("long"))
    return place.withColumns({"shard": F.pmod("__featureline_p", F.lit(shards)).cast("int"),
                              "slot": F.floor(F.col("__featureline_p") / shards).cast("long")}).drop("__featureline_p", NUMBER)
