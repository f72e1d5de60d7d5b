"""Jaccard self-join of documents' word n-grams with adaptive multi-match prefixes, and the classes its links make.

A document is the set of its distinct shingles (``size`` words; a shorter text is one shingle). All sets are sorted in
one order, rare shingles first. Let n be a set's size and t the least overlap a partner needs. Then two linked documents
share at least l of their first ``n - t + l`` shingles, whatever l: a longer prefix has more rows, but a partner must
share more of it. Each document takes the l with the lowest estimated cost, from the estimated frequencies of its own
shingles; a pair must share the smaller l of the two.

1. One pass makes a key of each set (equal sets are one node from here on) and counts every shingle of every document
   exactly, through one shuffle of short keys. A table of ``1 << SKETCH_BITS`` slots, whatever the corpus, holds the
   count of the most frequent shingle of each slot, as a level. The order is (level of the slot, shingle hash).
2. A second pass cuts the prefixes. Prefix shingles are dealt and sorted, and those of one document only go. Each
   carries its place: two sets that share one have at most what lies before it in both, and behind it in both, in common.
3. Stars: in each posting list every document is paired with the list's most central one, whose prefix has the most
   common shingles. Of its centres, a document is verified with the one it shares most with. Documents that are
   connected then are not looked at again: a large group of near copies costs a number of pairs in proportion to it.
4. Of all remaining pairs of a posting list those are candidates whose documents are not connected yet and for which the
   shingle can be the first that linked sets share: what lies behind it in both must make the overlap that both sizes
   ask for. Candidates whose prefixes share enough are verified. Enough is l, and what is missing to that overlap after
   all that lies behind the prefix. No candidate is capped or sampled.
5. Classes are the connected components of the verified links, by alternating large and small stars on tables in the
   shared folder.

Verifying compares the whole sets, with 40 bits of each shingle's hash. They are computed again from the texts of the
documents that a bit table of fixed size lets through (it lets through all that are needed, and some more).

Null and empty texts, and texts without words, have empty sets, which link with nothing. Rows that share an id are one
document with the links of all its rows; null ids are left out of links. An empty table gives an empty one. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureline.llm.frames import fields, parts, release, utf8
from featureline.llm.words import U64, letters, lowered, mixed, split_words
from featureline.session import work_dir

SHINGLE = 4
SHARE = (85, 100)
#: Slots of the table of levels: 16 MB.
SKETCH_BITS = 24
#: Shingles are counted in so many ranges of their hashes, by the 24 bits that follow those of the range.
_RANGE_BITS = 12
#: A task counts so many shingles before it sends them on.
_FLUSH = 1 << 19
#: Bits of the table that lets documents through to be verified: 8 MB.
FILTER_BITS = 26
#: Longest lengthening of a prefix that is weighed.
MOST_EXTRA = 8
#: Estimated cost of a prefix row, and of comparing one shingle, in units of looking at one candidate.
ROW_COST, COMPARE_COST = 4.0, 0.05
#: Shingles estimated to be more frequent than this are dealt out to several tasks by document.
SPREAD = 1 << 16

_LETTERS = letters((0x20, 0x20), (0x09, 0x0D))
_LOWER = lowered()
_DOCS = T.StructType(fields("id long, n long, key1 long, key2 long, chunk int, shingles binary, times binary"))
_PREFIXES = T.StructType(fields("id long, n int, extra int, own int, prefix longs, spread ints"))
_SETS = T.StructType(fields("id long, shingles binary"))


def _sets(column: pa.Array, size: int, take: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    data, offsets = utf8(column)
    for a, b in parts(offsets):
        if take is not None and not take[a:b].any():
            continue
        base = offsets[a]
        words = split_words(_LOWER[data[base:offsets[b]]], offsets[a:b + 1] - base, _LETTERS)
        got, _ = words.windows(size)
        for k in range(b - a):
            if take is not None and not take[a + k]:
                continue
            first, last = int(words.first[k]), int(words.first[k + 1])
            if last - first >= size:
                yield a + k, np.unique(got[first:last - size + 1])
            elif last > first:
                with np.errstate(over="ignore"):
                    whole = mixed((words.hashes[first:last] * mixed(np.arange(last - first, dtype=U64) + U64(77))).sum(dtype=U64)[None])
                yield a + k, whole
            else:
                yield a + k, np.zeros(0, U64)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _counted(shingles: list[np.ndarray]) -> pa.RecordBatch:
    """For each range of hashes, the 24 bits that tell its shingles apart and how often each is there."""
    keys, times = np.unique(np.concatenate(shingles) >> U64(40 - _RANGE_BITS), return_counts=True)
    chunk = (keys >> U64(24)).astype(np.int32)
    chunks, first = np.unique(chunk, return_index=True)
    bounds = np.append(first, len(keys))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].ravel()
    none = [pa.nulls(len(chunks), pa.int64())] * 4
    return pa.RecordBatch.from_arrays(
        [*none, pa.array(chunks),
         pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer((bounds * 3).astype(np.int32)), pa.py_buffer(low.tobytes())]),
         pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer((bounds * 4).astype(np.int32)),
                                                          pa.py_buffer(times.astype("<u4").tobytes())])], names=_DOCS.names)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting, held = [], 0
        none = pa.nulls
        for batch in batches:
            n, keys = np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64)
            for k, shingles in _sets(batch.column("text"), size):
                n[k] = len(shingles)
                keys[k] = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                waiting.append(shingles)
                held += len(shingles)
                if held >= _FLUSH:
                    yield _counted(waiting)
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()),
                 none(len(batch), pa.int32()), none(len(batch), pa.binary()), none(len(batch), pa.binary())], names=_DOCS.names)
        if held:
            yield _counted(waiting)

    return run


def _slice(keys: list[np.ndarray], times: list[np.ndarray]) -> bytes:
    """The levels of a range: twice the binary logarithm of the count of each slot's most frequent shingle."""
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(times[order].astype(np.int64), first)
    out = np.zeros(1 << (SKETCH_BITS - _RANGE_BITS), np.uint8)
    np.maximum.at(out, (keys[first] >> (24 + _RANGE_BITS - SKETCH_BITS)).astype(np.int64), np.floor(2 * np.log2(total)).astype(np.uint8))
    return out.tobytes()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their range; one range is held."""
    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([_slice(keys, times)], pa.binary())], names=["chunk", "levels"])

    last, keys, times = None, [], []
    for batch in batches:
        for c, k, t in zip(batch.column("chunk").to_pylist(), batch.column("shingles"), batch.column("times")):
            if c != last and keys:
                yield done()
                keys, times = [], []
            last = c
            raw = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, 3).astype(np.uint32)
            keys.append(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16)
            times.append(np.frombuffer(t.as_buffer(), "<u4"))
    if keys:
        yield done()


def _levels(described: DataFrame) -> np.ndarray:
    """The level of each slot; the driver gets the table, whose size is fixed."""
    own = described.where(F.col("chunk").isNotNull()).select("chunk", "shingles", "times")
    parts = own.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add, T.StructType(fields("chunk int, levels binary")))
    levels = np.zeros((1 << _RANGE_BITS, 1 << (SKETCH_BITS - _RANGE_BITS)), np.uint8)
    for r in parts.collect():
        levels[r.chunk] = np.frombuffer(r.levels, np.uint8)
    return levels.ravel()


def least_overlap(n: int, share: tuple[int, int] = SHARE) -> int:
    """The least overlap that a partner of a set of size n has."""
    return -(-share[0] * n // share[1])


def prefix_of(shingles: np.ndarray, levels: np.ndarray, share: tuple[int, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, prefix, level of each of its shingles) of the lowest estimated cost."""
    n = len(shingles)
    t = least_overlap(n, share)
    level = levels[_slot(shingles)]
    most = min(n, n - t + MOST_EXTRA)
    order = np.argsort(level, kind="stable")[:most]
    frequency = np.exp2(level[order] / 2) - 1
    extra = np.arange(1, most - (n - t) + 1)
    candidates = np.cumsum(frequency)[n - t + extra - 1]
    cost = ROW_COST * (n - t + extra) + candidates * (1 + COMPARE_COST * n / extra)
    extra = int(extra[np.argmin(cost)])
    order = order[:n - t + extra]
    return extra, shingles[order], level[order]


def _prefixes(size: int, share: tuple[int, int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out, prefixes, spreads = [], [], []
            for k, shingles in _sets(batch.column("text"), size):
                if len(shingles) and ids[k] is not None:
                    extra, prefix, level = prefix_of(shingles, levels, share)
                    # Common ones are dealt by document: as many ways as lists of SPREAD need.
                    ways = np.left_shift(1, np.maximum(level.astype(np.int64) // 2 - int(np.log2(SPREAD)), 0))
                    out.append((ids[k], len(shingles), extra, -int(level.sum())))
                    prefixes.append(prefix.view(np.int64))
                    spreads.append(np.where(ways > 1, 1 + xxhash.xxh32_intdigest(str(ids[k])) % ways, 0).astype(np.int32))
            if out:
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
                    + [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(prefixes))),
                       pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(spreads)))], names=_PREFIXES.names)

    return run


_POSTINGS = T.StructType(fields("token long, id long, n int, extra int, pos int, centre long, centre_n int, centre_pos int"))


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in the order of (token, spread, most central first) those of several documents, each with its list's first document.

    One batch and one waiting row are held, however long a list is.
    """
    last, centre, waiting = None, None, None
    for batch in batches:
        if not len(batch):
            continue
        token, spread, ids, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "spread", "id", "n", "pos"))
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (spread[1:] != spread[:-1])
        goes_on = last == (token[0], spread[0])
        first[0] = not goes_on
        group = np.cumsum(first) - 1 + goes_on  # 0 is the list of the batch before, if it goes on
        heads = np.flatnonzero(first)
        of_list = [np.concatenate([[centre[k]] if goes_on else [], x[heads]]).astype(x.dtype)[group] for k, x in enumerate((ids, n, pos))]
        # A list's first row goes out once a second one is there; lists dealt out by document always do.
        follows = np.zeros(len(token), bool)
        follows[:-1] = ~first[1:]
        keep = ~first | follows | (spread > 0)
        if goes_on and waiting is not None:
            yield waiting
        waiting = None
        whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in _POSTINGS.names[:5]), *map(pa.array, of_list)], names=_POSTINGS.names)
        if keep.any():
            yield whole.filter(pa.array(keep))
        last, centre = (token[-1], spread[-1]), [x[-1] for x in of_list]
        if first[-1] and not spread[-1]:
            waiting = whole.slice(len(whole) - 1)


def _short(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: what two sets don't share agrees by chance in one of some 10 ** 9 pairs."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: pa.Scalar) -> np.ndarray:
    out = np.zeros((len(raw.as_buffer()) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel()


def _bit(id_column):
    return F.pmod(F.xxhash64(id_column), F.lit(1 << FILTER_BITS))


def _needed_sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The sets of (at least) the documents in the pairs."""
    spark = docs.sparkSession
    bit = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(_bit(F.col("id")).alias("bit"))
    words = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64))))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)  # its size is fixed, so the driver gets no more than that
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            take = (bits[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            found = [(k, _short(s)) for k, s in _sets(batch.column("text"), size, take)]
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([k for k, _ in found], pa.int64())),
                                              pa.array([s for _, s in found], pa.binary())], names=_SETS.names)

    return docs.where("id IS NOT NULL").withColumn("bit", _bit(F.col("id"))).mapInArrow(run, _SETS)


def _verified(docs: DataFrame, pairs: DataFrame, size: int, share: tuple[int, int], folder: str) -> DataFrame:
    """Of the pairs (a, b) the linked ones, written to ``folder``."""
    spark = docs.sparkSession
    pairs.select("a", "b").write.parquet(f"{folder}-pairs")
    pairs = spark.read.parquet(f"{folder}-pairs")
    sets = f"{folder}-sets"
    _needed_sets(docs, pairs, size).write.parquet(sets)
    own = spark.read.parquet(sets)
    # The larger part goes first: most documents are the second one of one pair.
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b") \
        .join(own.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = _long(x), _long(y)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                linked.append(common > 0 and share[1] * common >= share[0] * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both.select("a", "b", "x", "y").mapInArrow(run, T.StructType(fields("a long, b long"))).write.parquet(folder)
    return spark.read.parquet(folder)


def links(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, size: int, share: tuple[int, int], folder: str) -> DataFrame:
    """Verified links (a, b) between the nodes' documents: enough of them that linked documents are connected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels.tobytes())
    cut = docs.mapInArrow(_prefixes(size, share, shared), _PREFIXES).join(nodes.select("id"), "id", "left_semi")
    rows = cut.select("id", "n", "extra", "own", F.posexplode(F.arrays_zip("prefix", "spread")).alias("pos", "p")) \
        .select(F.col("p.prefix").alias("token"), F.col("p.spread").alias("spread"), "id", "n", "extra", "own", "pos")
    by = ["token", "spread"]
    rows.repartition(*by).sortWithinPartitions(*by, "own", "id").mapInArrow(_shared_only, _POSTINGS).write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")

    up, down = share

    def least(a: str, b: str) -> str:
        """The overlap that two sizes ask for."""
        return f"({up} * ({a} + {b}) + {up + down - 1}) div {up + down}"

    stars = postings.where("id <> centre") \
        .where(f"least(pos, centre_pos) + least(n - pos, centre_n - centre_pos) >= {least('n', 'centre_n')}") \
        .groupBy("centre", "id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    # Half of a shorter prefix in common is likely enough; what is left out here is looked at below.
    likely = F.col("shared") * 2 * share[1] >= F.col("n") * (share[1] - share[0])
    closest = stars.where(likely).groupBy(F.col("id").alias("b")).agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("a"))
    starred = _verified(docs, closest, size, share, f"{folder}/stars")

    joined = components(starred, f"{folder}/joined").withColumnRenamed("component", "c")
    placed = postings.select("token", "id", "n", "extra", "pos").join(joined, "id", "left").withColumn("c", F.coalesce("c", "id"))
    # Lists with documents of one class only are done.
    open_tokens = placed.groupBy("token").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("token")
    placed.join(open_tokens, "token", "left_semi").write.parquet(f"{folder}/open")
    left = spark.read.parquet(f"{folder}/open")
    x, y = left.alias("x"), left.alias("y")
    fits = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) \
        & F.expr(f"least(x.n - x.pos, y.n - y.pos) >= {least('x.n', 'y.n')}")
    pairs = x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    # A document's row is its prefix, which is shorter than its text.
    own = left.groupBy("id").agg(F.collect_set("token").alias("tokens"), F.first("n").alias("n"), F.first("extra").alias("x"))
    both = pairs.join(own.toDF("b", "bt", "bn", "bx"), "b").join(own.toDF("a", "at", "an", "ax"), "a") \
        .withColumn("shared", F.size(F.array_intersect("at", "bt")))
    # Of the set whose prefix ends first, what lies behind the prefix is all that can be common besides; the overlap must reach
    # what the two sizes ask for.
    behind = f"greatest(({up} * an + {down - 1}) div {down} - ax, ({up} * bn + {down - 1}) div {down} - bx)"
    enough = both.where(f"shared >= greatest(least(ax, bx), {least('an', 'bn')} - {behind})")
    others = _verified(docs, enough.select("a", "b"), size, share, f"{folder}/others")
    return starred.unionByName(others)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component) for every id in the edges (a, b); the component is its smallest id."""
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # Each edge goes from the larger id to the smaller one.
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    before, k = mark(edges), 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"large-{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = kept(small, f"edges-{k}")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def ngram_classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                  share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links).

    Documents link when ``share[1] * |x & y| >= share[0] * |x | y|``.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "ngrams")
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bare.mapInArrow(_describe(size), _DOCS).write.parquet(f"{folder}/described")
    described = spark.read.parquet(f"{folder}/described")
    rows = described.where("chunk IS NULL").drop("chunk", "counts")
    full = rows.where("n > 0 AND id IS NOT NULL")
    sets = full.groupBy("key1", "key2").agg(F.min("id").alias("id"))
    sets.write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    found = links(bare, nodes, _levels(described), size, share, folder)
    placed = full.join(nodes.withColumnRenamed("id", "node"), ["key1", "key2"]).select("id", "node")
    # Rows of one id with different texts belong together.
    several = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).where("a <> _hi").select("id", "a")
    same = placed.join(several, "id").select("a", F.col("node").alias("b"))
    classes = components(found.unionByName(same), f"{folder}/components").withColumnRenamed("id", "node")
    whole = rows.join(nodes.withColumnRenamed("id", "node"), ["key1", "key2"], "left").join(classes, "node", "left")
    return whole.select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "node")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5,
                share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents with the smallest id of each class; all columns stay."""
    classes = ngram_classes(docs, id=id, text=text, size=size, share=share)
    gone = classes.where(F.col(id) != F.col("component_id")).select(id).distinct()
    return docs.join(gone, id, "left_anti").select(*docs.columns)
