"""Exact deduplication over an extendible-hash index on shared files.

The index maps a 64-bit hash of the normalised text to a bucket. Its directory has ``2 ** depth`` slots, one for each
prefix of the hash; a bucket owns all slots that share its own, shorter prefix. While a bucket with more than one key
holds more than ``bucket_bytes``, it is split in two, and the directory doubles where a split needs a longer prefix. One
byte for each slot (the length of its bucket's prefix) describes it all; ``MAX_DEPTH`` bounds it to 16 MB, and buckets
that are overfull there just grow on.

Texts reach the index once for every ``SLICE`` rows and distinct text (copies among them are joined before the shuffle,
so a large group of copies shrinks by that much). Owner tasks take ranges of keys, read them in key order, and keep the
texts of one key as a chain: equal bytes join an entry, other bytes with the same hash begin the next one. Every bucket
is a folder of Parquet files.

Normalising deletes the characters ``[\\x20\\x09-\\x0D]``. Null texts count as empty, so null, empty and blank texts are
one group. Of equal texts the row with the most code points stays, then the smallest id (null ids last), then any one of
the rows repeated in both. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from featureline.llm.frames import fields, record
from featureline.session import work_dir

BUCKET_BYTES = 64 << 20
MAX_DEPTH = 24
#: Ranges of keys for each shuffle partition.
OWNERS = 4
#: Rows that are handled at once; copies among them are joined before the shuffle.
SLICE = 512
_BLANKS = b" \t\n\v\f\r"
_ROWS = T.StructType(fields("id long, key long, size long, n_cp long, text_sha256 string"))
_ENTRIES = T.StructType(fields("key long, owner int, body binary, n long, n_cp long, id long"))
_INDEX = T.StructType(fields("bucket long, key long, chain int, text_sha256 string, n long, n_cp long, id long, body binary"))
_TOP = 1 << 63


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _BLANKS)


def _key(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - _TOP


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, id) the one that stays."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``SLICE`` rows, so that a worker never holds a whole batch of texts twice."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows = []
        for t in batch.column("text"):
            t = t.as_py() or ""
            body = normalised(t)
            rows.append((_key(body), len(body), len(t), sha256(body).hexdigest()))
        key, size, n_cp, digest = zip(*rows)
        yield record(_ROWS, {"id": batch.column("id"), "key": pa.array(key, pa.int64()), "size": pa.array(size, pa.int64()),
                             "n_cp": pa.array(n_cp, pa.int64()), "text_sha256": pa.array(digest, pa.string())})


def _chained(found: dict[int, list], key: int, body: bytes, n: int, best: tuple) -> None:
    chain = found.setdefault(key, [])
    for entry in chain:
        if entry[0] == body:
            entry[1] += n
            entry[2] = _better(entry[2], best)
            return
    chain.append([body, n, best])


def _entries(owner_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found: dict[int, list] = {}
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                t = t.as_py()
                body = normalised(t)
                _chained(found, _key(body), body, 1, (len(t or ""), i))
            flat = [(k, (k + _TOP) >> (64 - owner_bits), *e[:2], *e[2]) for k, chain in found.items() for e in chain]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(
                zip(*flat) if flat else [()] * 6, pa.schema([("key", pa.int64()), ("owner", pa.int32()), ("body", pa.binary()),
                                                            ("n", pa.int64()), ("n_cp", pa.int64()), ("id", pa.int64())]))],
                names=_ENTRIES.names)

    return run


def _owners(directory):
    """Entries in key order become index entries; only one key's chain and one batch are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = np.frombuffer(directory.value, np.int8)
        bits = len(depths).bit_length() - 1

        def rows(key: int, chain: list) -> Iterator[tuple]:
            place = key + _TOP
            prefix = int(depths[place >> (64 - bits)])
            bucket = (1 << prefix) | (place >> (64 - prefix))  # the leading one tells prefixes of other lengths apart
            for k, (body, n, (n_cp, i)) in enumerate(chain):
                yield bucket, key, k, sha256(body).hexdigest(), n, n_cp, i, body

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=_INDEX.names)

        last, found, out, held = None, {}, [], 0
        for batch in _slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "n", "n_cp", "id"))):
                key, body, n, n_cp, i = row
                if key != last and last is not None:
                    out += rows(last, found.pop(last))
                    held += len(out[-1][-1])
                    if held > 1 << 20 or len(out) >= SLICE:
                        yield batch_of(out)
                        out, held = [], 0
                last = key
                _chained(found, key, body, n, (n_cp, i))
        if last is not None:
            out += rows(last, found.pop(last))
        if out:
            yield batch_of(out)

    return run


@dataclass(frozen=True)
class Index:
    """Where an index lies: rows (every document's key), and buckets (one folder each)."""

    rows: str
    buckets: str
    depths: np.ndarray

    def entries(self, spark: SparkSession) -> DataFrame:
        """Distinct texts: key, place in the chain, digest, number of copies, and what stays."""
        return spark.read.schema(_INDEX).parquet(self.buckets).drop("body")


def _directory(rows: DataFrame, bucket_bytes: int) -> np.ndarray:
    """For each slot the length of its bucket's prefix."""
    keys = rows.groupBy("key").agg(F.max("size").alias("size"))  # copies take room once
    total = keys.agg(F.sum("size")).first()[0] or 0
    depth = min(MAX_DEPTH, max(1, int(np.ceil(np.log2(max(total, 1) / bucket_bytes)))))
    while True:
        slot = F.shiftrightunsigned("key", 64 - depth).bitwiseXOR(F.lit(1 << (depth - 1)))  # signed keys in unsigned order
        loads, counts = np.zeros(1 << depth, np.int64), np.zeros(1 << depth, np.int64)
        for s, load, n in keys.groupBy(slot.alias("slot")).agg(F.sum("size"), F.count("*")).collect():
            loads[s], counts[s] = load, n
        if depth >= MAX_DEPTH or not ((loads > bucket_bytes) & (counts > 1)).any():
            break
        depth += 1  # the directory doubles
    depths = np.full(1 << depth, depth, np.int8)
    for prefix in range(depth - 1, -1, -1):  # slots share a bucket as long as it holds them
        loads = loads.reshape(-1, 2).sum(1)
        width = 1 << (depth - prefix)
        fits = np.repeat(loads <= bucket_bytes, width)
        depths[fits] = np.minimum(depths[fits], prefix)
    return depths


def build_index(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> Index:
    spark = docs.sparkSession
    folder = work_dir(spark, "exact")
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bare.mapInArrow(_describe, _ROWS).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    depths = _directory(spark.read.parquet(f"{folder}/rows"), bucket_bytes)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = max(1, (partitions * OWNERS - 1).bit_length())
    shared = spark.sparkContext.broadcast(depths.tobytes())
    bare.mapInArrow(_entries(owner_bits), _ENTRIES).repartition(partitions, "owner").sortWithinPartitions("key") \
        .mapInArrow(_owners(shared), _INDEX).write.partitionBy("bucket").parquet(f"{folder}/buckets")
    return Index(f"{folder}/rows", f"{folder}/buckets", depths)


def exact_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    index = build_index(docs, id=id, text=text, bucket_bytes=bucket_bytes)
    rows = spark.read.parquet(index.rows)
    copied = index.entries(spark).where("n > 1").select("key", "text_sha256", "n", F.col("n_cp").alias("_cp"),
                                                        F.col("id").alias("_keep"))
    # Rows repeated with their id: one of them stays.
    stays = rows.join(copied, ["key", "text_sha256"]).where(F.col("id").eqNullSafe(F.col("_keep")) & (F.col("n_cp") == F.col("_cp"))) \
        .groupBy("key", "text_sha256").agg(F.min("row").alias("_row"), F.first("n").alias("n"), F.first("_keep").alias("_keep"))
    joined = rows.join(stays, ["key", "text_sha256"], "left")
    alone = F.col("n").isNull()
    return joined.select(F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("_keep")).alias("keep_id"),
                         F.coalesce("n", F.lit(1)).alias("group_size"),
                         (alone | (F.col("row") == F.col("_row"))).alias("kept"), "text_sha256")


def remove_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows that stay; all columns stay."""
    spark, path = docs.sparkSession, work_dir(docs.sparkSession, "groups")
    exact_groups(docs, id=id, text=text, bucket_bytes=bucket_bytes).write.parquet(path)
    key, digest, place = "__featureline_id", "__featureline_sha", "__featureline_k"
    groups = spark.read.parquet(path).select(F.col(id).alias(key), F.col("text_sha256").alias(digest), "kept")
    gone = groups.where("NOT kept").select(key).distinct()
    same_id = docs[id].eqNullSafe(F.col(key))
    sure = docs.join(gone, same_id, "left_anti")
    # Where an id has rows that stay and rows that go, its rows are told apart by their texts, and one of those repeated in both stays.
    both = groups.groupBy(key).agg(F.bool_and("kept").alias("_all"), F.bool_or("kept").alias("_some")).where("_some AND NOT _all")
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")
    doubtful = docs.join(both.select(key), same_id, "left_semi").withColumn(digest, F.sha2(norm.cast("binary"), 256))
    stays = groups.where("kept").select(key, F.col(digest).alias("__featureline_stays"))
    same_text = doubtful[id].eqNullSafe(F.col(key)) & (F.col(digest) == F.col("__featureline_stays"))
    first = Window.partitionBy(id, digest).orderBy(F.desc(F.length(text)), text)
    kept = doubtful.join(stays, same_text, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return sure.unionByName(kept.drop(place, digest))
