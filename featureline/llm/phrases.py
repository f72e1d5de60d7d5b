"""Phrase mining by dynamic itemset counting: phrases of all lengths are counted in the same scans.

The corpus is dealt into ``shards`` parts, which are scanned in turn, again and again. Words are counted from the first scan
on. As soon as a phrase has ``threshold`` occurrences in the scans so far, it is *frequent*; a longer phrase is counted from
the scan after the one in which both of its subphrases (without the last word, without the first) became frequent, for one
full cycle, so each shard is scanned once for it. A phrase can't occur more often than its subphrases, so none is missed.
The work ends when no phrase is being counted any more, after 5 cycles at most and usually after far fewer.

What tasks must know to do so is for every frequent phrase the scan after which it became so. That is broadcast as a table of
``2 ** table_bits`` bytes, by hash, whatever the corpus's size. Where phrases meet in a slot, the earliest scan counts, but for a
phrase none before those of its subphrases: it may then be counted earlier than needed, or without need. It is still counted in
each shard exactly once, because its first scan follows from the tables alone, and tables only grow. So counts are exact; a full
table costs work only.

Tasks count within blocks, by the words themselves and not by their hashes. Counts are summed up by Spark, with partial sums
before the shuffle; after each scan the phrases in their cycle are written as a table, and what has ended its cycle below the
threshold is left out.

Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and those into words at spaces and tabs. Null
texts are empty, null languages are ``und``. Rows need no ids; repeated rows count as often as they occur. An empty table gives
an empty result. Other columns are not looked at. Ties are broken by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from featureline.llm.frames import fields, parts, record, utf8
from featureline.llm.words import U64, letters, lowered, mixed, numbers
from featureline.session import remove_folder, work_dir

LONGEST = 5
#: Bytes of text that a task counts at once.
BLOCK_BYTES = 1 << 23
#: Parts of a language whose best phrases are found apart.
PARTS = 256
#: In the table: no frequent phrase has this hash.
NEVER = 255
_PIECE_ENDS = letters((0x0A, 0x0D), *((ord(c),) * 2 for c in ".,;:!?"))
_WORD = _PIECE_ENDS & letters((0x20, 0x20), (0x09, 0x09))
_LOWER = lowered()
_LETTER, _NEXT = numbers(256, 11), numbers(1, 12)[0] | U64(1)
_POWERS = numbers(4096, 13)
_COUNTS = T.StructType(fields("lang string, phrase string, size int, began int, n long"))
_SLOTS = T.StructType(fields("slot long"))


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word of a binary array."""
    data, offsets = utf8(words)
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, U64)
    raw = data[offsets[0]:offsets[-1]]
    place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    factors = _POWERS[place] if sizes.max() <= len(_POWERS) else numbers(int(sizes.max()), 13)[place]
    with np.errstate(over="ignore"):
        total = np.concatenate([[U64(0)], np.cumsum(_LETTER[raw] * factors, dtype=U64)])
        return mixed(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]] + sizes.astype(U64))


def _longer(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases out of those without the last word."""
    with np.errstate(over="ignore"):
        return mixed(shorter * _NEXT + last)


def _first_words(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(words + mixed(langs ^ _NEXT))


def _texts(words: pa.Array, at: list[np.ndarray]) -> pa.Array:
    """Phrases out of the places of their words in ``words``."""
    columns = [words.take(pa.array(x)).cast(pa.string()) for x in at]
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")


def _distinct(ids: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of numbers below ``most``, and how many there are of each."""
    if most ** len(ids) < 1 << 62:
        key = ids[0].astype(np.int64)
        for column in ids[1:]:
            key = key * most + column
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        n, key, out = np.diff(np.append(heads, len(key))), key[heads], []
        for _ in ids[1:]:
            key, last = np.divmod(key, most)
            out.insert(0, last)
        return [key, *out], n
    key = ids[0].astype(np.int64)
    for k, column in enumerate(ids[1:]):
        if k:  # numbered anew, so that numbers put together stay below 2 ** 63
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * most + column
    _, one, n = np.unique(key, return_index=True, return_counts=True)
    return [x[one] for x in ids], n


def split(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of texts in lower case: where words begin, each word's text, whether the next word stands in the same piece, and the words."""
    inside = _WORD[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]  # a word that ends a text doesn't go on in the next
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=bounds[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    piece = np.cumsum(~_PIECE_ENDS[low], dtype=np.int32)[starts]
    return starts, text, (text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), words.dictionary_encode()


def counted(langs: pa.Array, texts: pa.Array, table: np.ndarray, scan: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are in their cycle in this scan. A phrase of size 0 stands for all words of its language."""
    data, offsets = utf8(texts)
    starts, text, goes_on, words = split(_LOWER[data[offsets[0]:offsets[-1]]], offsets - offsets[0])
    if not len(starts):
        return
    langs = langs.dictionary_encode()
    names, lang = langs.dictionary, langs.indices.to_numpy()[text]
    spelt, word = words.dictionary, words.indices.to_numpy()
    most = max(len(spelt), len(names))

    def rows(size: int, at, began) -> Iterator[pa.RecordBatch]:
        """Phrases of one size at places, by the scan in which they began."""
        for scan_of in np.unique(began).tolist() if size > 1 else [0]:
            here = at[began == scan_of] if size > 1 else at
            (lang_of, *ids), n = _distinct([lang[here], *(word[k:][here] for k in range(size))], most)
            yield record(_COUNTS, {
                "lang": names.take(pa.array(lang_of)).cast(pa.string()), "phrase": _texts(spelt, ids) if size else pa.array([""] * len(n)),
                "size": pa.array(np.full(len(n), size, np.int32)), "began": pa.array(np.full(len(n), scan_of, np.int32)), "n": pa.array(n)})

    if scan < shards:
        yield from rows(0, slice(None), None)
        yield from rows(1, slice(None), None)
    # Phrases of growing size: the places where frequent ones begin, their hashes, and the scan from which longer ones count.
    spelling = _hashes(spelt)[word]
    shift = U64(64 - (len(table) - 1).bit_length())
    at = np.arange(len(word))
    hashes = _first_words(spelling, _hashes(names)[lang])
    since = table[hashes >> shift]
    for size in range(2, LONGEST + 1):
        often = since != NEVER
        at, hashes, since = at[often], hashes[often], since[often]
        follows = np.flatnonzero(goes_on[at[:-1]] & (at[1:] == at[:-1] + 1) if size == 2 else at[1:] == at[:-1] + 1)
        at, hashes, since = at[follows], hashes[follows], np.maximum(since[follows], since[follows + 1])
        counts = since.astype(np.int64) + shards > scan
        if counts.any():
            yield from rows(size, at[counts], since[counts])
        hashes = _longer(hashes, spelling[at + size - 1])
        since = np.maximum(table[hashes >> shift], since)  # a slot shared with another phrase may be older than the phrase's parts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Batches of about BLOCK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, b in parts(offsets, BLOCK_BYTES):
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= BLOCK_BYTES // 2:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield from zip(whole["lang"].chunks, whole["text"].chunks)
                held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from zip(whole["lang"].chunks, whole["text"].chunks)


def _scanned(shard: DataFrame, table, scan: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches):
            yield from counted(langs, texts, table.value, scan, shards)

    return shard.mapInArrow(run, _COUNTS)


def _slots(phrases: DataFrame, bits: int) -> DataFrame:
    """The table's slots of phrases, as the tasks compute them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parted = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            sizes = np.array([len(s) for s in parted], np.int64)
            if not len(sizes):
                continue
            words = _hashes(pa.array([w.encode() for s in parted for w in s], pa.binary()))
            first = np.cumsum(sizes) - sizes
            hashes = _first_words(words[first], _hashes(batch.column("lang").cast(pa.binary())))
            for k in range(1, int(sizes.max())):
                more = sizes > k
                hashes[more] = _longer(hashes[more], words[first[more] + k])
            yield record(_SLOTS, {"slot": pa.array((hashes >> U64(64 - bits)).astype(np.int64))})

    return phrases.select("lang", "phrase").mapInArrow(run, _SLOTS)


def _marked(slots: DataFrame, table: np.ndarray, scan: int) -> bool:
    """Notes in the table from which scan on its frequent phrases count, and says whether that is news. Bits reach the driver
    32,768 at a time."""
    news = False
    found = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    for row in found:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little")) + 32768 * (row.bucket - 1)
        at = at[table[at] == NEVER]
        table[at] = scan
        news |= bool(len(at))
    return news


def _stored(spark, path: str) -> DataFrame:
    """The table of a scan; ``over`` says whether a phrase's cycle has ended."""
    return spark.read.schema(T.StructType([*_COUNTS, *fields("over boolean")])).parquet(path)


def phrase_counts(docs: DataFrame, *, threshold: int = 100, shards: int = 3, text: str = "text", lang: str = "lang",
                  table_bits: int = 24) -> DataFrame:
    """lang, phrase, size and n of all phrases of at most five words that occur ``threshold`` times in a language, and for each
    language a row of size 0 with the number of all words. The rows are a written table."""
    if not 1 <= shards <= 40:
        raise ValueError("1 to 40 shards")
    spark = docs.sparkSession
    folder = work_dir(spark, "phrases")
    schema = T.StructType(fields("lang string, text string, shard int"))
    docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")) \
        .write.partitionBy("shard").parquet(f"{folder}/shards")
    corpus = spark.read.schema(schema).parquet(f"{folder}/shards")
    table = np.full(1 << table_bits, NEVER, np.uint8)
    ended, scan, last = [], 0, shards - 1
    while scan <= last:
        shared = spark.sparkContext.broadcast(table.copy())
        counts = _scanned(corpus.where(F.col("shard") == scan % shards).select("lang", "text"), shared, scan, shards)
        if scan:
            counts = counts.unionByName(_stored(spark, f"{folder}/{scan - 1}").where("NOT over").drop("over"))
        summed = counts.groupBy("lang", "phrase", "size", "began").agg(F.sum("n").alias("n"))
        over = F.col("began") == scan - shards + 1
        summed.where(~over | (F.col("n") >= threshold) | (F.col("size") == 0)).withColumn("over", over) \
            .write.option("compression", "zstd").partitionBy("over").parquet(f"{folder}/{scan}")
        if scan:  # what went on from the scan before is in this one's table
            remove_folder(spark, f"{folder}/{scan - 1}/over=false")
        frequent = _stored(spark, f"{folder}/{scan}").where((F.col("n") >= threshold) & F.col("size").between(1, LONGEST - 1))
        if _marked(_slots(frequent, table_bits), table, scan + 1):
            last = scan + shards
        shared.destroy()  # what was computed with it is written
        ended.append(f"{folder}/{scan}")
        scan += 1
    finished = [_stored(spark, path).where("over").select("lang", "phrase", "size", "n") for path in ended]
    reduce(DataFrame.unionByName, finished).write.parquet(f"{folder}/counts")
    for path in [f"{folder}/shards", *ended]:
        remove_folder(spark, path)
    return spark.read.schema(T.StructType(fields("lang string, phrase string, size int, n long"))).parquet(f"{folder}/counts")


def _part(first, words):
    return F.array_join(F.slice(F.split("phrase", " "), first, words), " ")


def collocations(docs: DataFrame, *, threshold: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The ``top`` phrases of two to five words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its worst cut in two: ``floor(1000 * a * n / (l * r))``, where a, l and r count the phrase and its two
    parts and n all words. A phrase inside a longer one that is as frequent is left out.
    """
    counts = phrase_counts(docs, threshold=threshold, text=text, lang=lang, **options)
    long = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.col("size"))})
    known = counts.where("size >= 1")
    total = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]) \
        .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]) \
        .join(total, "lang") \
        .withColumns({"above": exact("a") * exact("total") * F.lit(1000), "below": exact("l") * exact("r")}) \
        .withColumn("score", F.expr("above div below"))
    worst = scored.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r", "total")).alias("cut"))
    inner = long.where("size >= 3").withColumn("words", F.explode(F.sequence(F.lit(2), F.col("size") - 1))) \
        .withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("words") + 1))) \
        .select("lang", _part(F.col("from"), F.col("words")).alias("phrase"), F.col("a").alias("around"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where("around IS NULL OR around < a")
    # The best of each of many parts of a language, then of the language, so that no task sorts all of a language's phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(order))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score", part.alias("part")) \
        .withColumn("rank", first).where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order))).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
