"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, looked up for every window of every
document.

Words are runs of digits, letters and bytes beyond ASCII of the lower-cased text (only A-Z are lowered). A window is
``size`` consecutive words of an item; an item with fewer words is one window. The windows' 64-bit hashes go to the
tasks as a sorted array behind a bit table; a document position that hits is verified by comparing the words themselves.
Every document word inside a verified occurrence is hit.

The hash set is bounded: the benchmark is read in blocks of at most ``block_windows`` windows, one pass over the
documents for each block (a usual benchmark is one block). Null texts have no words; items without words have no
windows; repeated items count each by its id, items with a null id have windows that hit but are not listed; an empty
benchmark hits nothing; an empty table gives an empty one. Columns of the documents with names of results are replaced;
other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import ROW, TEXT, columns_of, fields, others, parts, record, text_of, utf8, whole_rows
from featureline.llm.words import U64, letters, lowered, split_words
from featureline.session import work_dir

WINDOW = 10
#: Windows of the benchmark in a broadcast block: 16 MB of hashes and some 200 MB of words at most.
BLOCK_WINDOWS = 1 << 20
_LETTERS = letters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = lowered()
RESULT = fields("n_words long, n_hit long, n_items long, item_ids longs, hit_starts ints, hit_ends ints")
_BITS = 22
#: A row's own key, where several passes are put together.
_KEY = "__featureline_key"
_KEYED = fields(f"{_KEY} long")


def _words(text: str | None) -> list[bytes]:
    kept = bytes(c if _LETTERS[c] else 32 for c in range(256))
    return (text or "").encode().lower().translate(kept).split()


def _window_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(i, b" ".join(w[k:k + size])) for i, t in zip(*(c.to_pylist() for c in batch.columns))
                     if (w := _words(t)) for k in range(max(1, len(w) - size + 1))}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()),
                                              pa.array([w for _, w in found], pa.binary())], names=["item", "words"])

    return run


def _blocks(benchmark: DataFrame, size: int, block_windows: int, id: str, text: str) -> Iterator[dict[bytes, list[int]]]:
    """The benchmark's distinct windows with their items, in blocks."""
    windows = benchmark.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(
        _window_rows(size), T.StructType(fields("item long, words binary"))).groupBy("words").agg(F.collect_set("item").alias("items"))
    block: dict[bytes, list[int]] = {}
    for row in windows.toLocalIterator():
        block[bytes(row.words)] = list(row["items"])
        if len(block) >= block_windows:
            yield block
            block = {}
    yield block


class _Table:
    """The hash set of a block."""

    def __init__(self, block: dict[bytes, list[int]]):
        self.block = block
        by_size: dict[int, list[int]] = {}
        for words in block:
            found = split_words(np.frombuffer(words, np.uint8), np.array([0, len(words)]), _LETTERS)
            n = len(found.hashes)
            by_size.setdefault(n, []).append(int(found.windows(n)[0][0]))
        self.by_size = {}
        for n, hashes in by_size.items():
            hashes = np.unique(np.array(hashes, U64))
            bits = np.zeros(1 << _BITS, bool)
            bits[(hashes >> U64(64 - _BITS)).astype(np.int64)] = True
            self.by_size[n] = hashes, bits

    def hits(self, low: np.ndarray, words, n_texts: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, first word, window size, items) of every occurrence."""
        for n, (hashes, bits) in self.by_size.items():
            got, whole = words.windows(n)
            likely = np.flatnonzero(bits[(got >> U64(64 - _BITS)).astype(np.int64)] & whole)
            place = np.searchsorted(hashes, got[likely])
            likely = likely[(place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == got[likely])]
            texts = np.searchsorted(words.first, likely, side="right") - 1
            for w, d in zip(likely.tolist(), texts.tolist()):
                own = b" ".join(low[words.starts[k]:words.ends[k]].tobytes() for k in range(w, w + n))
                if (items := self.block.get(own)) is not None:
                    yield d, w, n, items


def _scan(schema: T.StructType, kept: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shared.value)
        for batch in batches:
            data, offsets = utf8(text_of(batch))
            n_words, marks, items = np.zeros(len(batch), np.int64), {}, {}
            for a, b in parts(offsets):
                low = _LOWER[data[offsets[a]:offsets[b]]]
                words = split_words(low, offsets[a:b + 1] - offsets[a], _LETTERS)
                n_words[a:b] = np.diff(words.first)
                for d, w, n, found in table.hits(low, words, b - a):
                    first = int(words.first[d])
                    marks.setdefault(a + d, set()).update(range(w - first, w - first + n))
                    items.setdefault(a + d, set()).update(found)
            spans = [_spans(sorted(marks.get(k, ()))) for k in range(len(batch))]
            columns = {c: batch.column(c) for c in kept}
            columns |= {"n_words": pa.array(n_words), "n_hit": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                        "item_ids": pa.array([sorted(items.get(k, ())) for k in range(len(batch))], pa.list_(pa.int64())),
                        "n_items": pa.array([len(items.get(k, ())) for k in range(len(batch))], pa.int64()),
                        "hit_starts": pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32())),
                        "hit_ends": pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32()))}
            yield record(schema, columns)

    return run


def _spans(marked: list[int]) -> list[tuple[int, int]]:
    """Word positions as runs (from, to)."""
    out: list[list[int]] = []
    for k in marked:
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [tuple(x) for x in out]


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id: str = "doc_id", item: str = "item_id",
                  item_text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit, n_items, item_ids, and the hit runs of words (hit_starts, hit_ends); ``text`` stays behind.

    With several blocks the rows are written with a key of their own first, and each block's findings are put together by it.
    """
    kept = others(docs, text, *(f.name for f in RESULT))
    schema = T.StructType([docs.schema[c] for c in kept] + RESULT)
    bare = docs.select(*kept) if ROW in kept else docs.select(*kept, F.col(text).cast("string").alias(TEXT))
    blocks = _blocks(benchmark, size, block_windows, item, item_text)
    block, later = next(blocks), next(blocks, None)
    scan = lambda rows, kept, schema, block: rows.mapInArrow(
        _scan(schema, kept, docs.sparkSession.sparkContext.broadcast(block)), schema)
    if later is None:
        return scan(bare, kept, schema, block)
    folder = work_dir(docs.sparkSession, "blocks")
    bare.select("*", F.monotonically_increasing_id().alias(_KEY)).write.parquet(folder)
    keyed = docs.sparkSession.read.schema(T.StructType([*bare.schema, *_KEYED])).parquet(folder)
    schema = T.StructType(_KEYED + RESULT)
    texts = keyed.select(_KEY, F.col(f"{ROW}.{TEXT}" if ROW in kept else TEXT).alias(TEXT))
    every = scan(texts, [_KEY], schema, block)
    for block in chain([later], blocks):
        every = every.unionByName(scan(texts, [_KEY], schema, block))
    merged = every.groupBy(_KEY).agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform(
            F.arrays_zip("hit_starts", "hit_ends"), lambda x: F.sequence(x["hit_starts"], x["hit_ends"] - 1))))))).alias("_hit"))
    begins = F.filter("_hit", lambda x: ~F.array_contains("_hit", x - 1))
    ends = F.transform(F.filter("_hit", lambda x: ~F.array_contains("_hit", x + 1)), lambda x: x + 1)
    merged = merged.select(_KEY, "n_words", F.size("_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                           "item_ids", begins.alias("hit_starts"), ends.alias("hit_ends"))
    return keyed.select(_KEY, *kept).join(merged, _KEY).select(*kept, *(f.name for f in RESULT))


def items_digest(items: list[int]) -> str:
    """Lower-case hex SHA-256 of the ids, sorted as text, with commas between."""
    return sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the runs and what stands between them."""
    raw = text.encode()
    low = _LOWER[np.frombuffer(raw, np.uint8)]
    words = split_words(low, np.array([0, len(raw)]), _LETTERS)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:words.starts[s]])
        at = words.ends[e - 1]
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with hit words cut out of their texts; all columns stay."""
    found = contamination(whole_rows(docs, id, text), benchmark, id=id, text=text, **options).select(
        ROW, "hit_starts", "hit_ends")
    schema = T.StructType([found.schema[ROW], *fields("text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = (batch.column(c).to_pylist() for c in ("hit_starts", "hit_ends"))
            clean = [t.as_py() if not s else _cut(t.as_py(), list(zip(s, e))) for t, s, e in zip(text_of(batch), starts, ends)]
            yield record(schema, {ROW: batch.column(ROW), "text": pa.array(clean, pa.string())})

    cut = found.mapInArrow(run, schema)
    return cut.select(*(F.col("text").alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns))


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any hit; all columns stay."""
    found = contamination(whole_rows(docs, id, text), benchmark, id=id, text=text, **options)
    return found.where("n_hit = 0").select(*columns_of(docs, text))
