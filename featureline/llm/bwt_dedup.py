"""Byte-level substring deduplication by merged Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``window`` bytes that also starts in a document with a smaller id. The
distinct contexts (see :mod:`featureline.llm.repeats`) of several anchors make a block; each anchor's contexts are dealt
over shards, so that equal strings meet in different ones. Each shard is sorted on its own and gives its transform. Two
transforms are merged without looking at their suffixes again: the interleave (which shard each merged row comes from)
starts as "all of the first, then all of the second", and every step sorts it, stably, by the symbols that the
transforms hold, which refines it by one symbol. Rows that a step tells apart for the first time have a common prefix of
as many symbols as there were steps before; after ``window`` steps, rows that no step told apart are the repeated
intervals. The smallest document of an interval decides for all of its rows.

Merging goes on in pairs until the block is one transform. Blocks hold about ``BLOCK`` bytes (a crowded anchor makes a
larger one), so a task's memory doesn't grow with the corpus.

Texts are their UTF-8 bytes; null and empty texts have none. Matches never cross documents: every context ends with a
separator, which is no byte. Strings are judged on the input; repeats within a document, and between rows that share an
id, stay. Rows with a null id stay as they are. An empty table gives an empty one. Columns other than id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import fields, utf8
from featureline.llm.repeats import Kind, contexts_of, covered, repeated, spans
from featureline.session import work_dir

WINDOW = 50
#: Bytes of an anchor.
GRAM = 24
#: Bytes of a block, and shards that it is cut into.
BLOCK = 1 << 18
SHARDS = 2
RESULT = T.StructType(fields("id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))


@dataclass
class Transform:
    """A Burrows-Wheeler transform: the symbol before each row's suffix, and the place where the suffix starts."""

    symbols: np.ndarray
    places: np.ndarray


def shard_transform(text: np.ndarray, places: np.ndarray, depth: int, kind: type) -> Transform:
    """Of the rotations of a text (symbols below 512), sorted by at least ``depth`` symbols."""
    n = len(text)
    # Seven symbols of nine bits are sorted at once, then twice as many each time.
    key, done = np.zeros(n, np.int64), 7
    for k in range(done):
        key = (key << 9) | np.roll(text, -k)
    rank = np.unique(key, return_inverse=True)[1].ravel()
    while done < depth:
        key = rank * n + np.roll(rank, -done)
        rank = np.unique(key, return_inverse=True)[1].ravel()
        done *= 2
    order = np.argsort(rank, kind="stable")
    return Transform(text[order - 1].astype(kind), places[order])


def merged(x: Transform, y: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """Both transforms as one, and the length of the prefix (up to ``depth``) that each row shares with the row before."""
    n = len(x.symbols) + len(y.symbols)
    second = np.zeros(n, bool)  # the interleave
    second[len(x.symbols):] = True
    both = np.concatenate([x.symbols, y.symbols])
    interval = np.zeros(n, np.int32)  # which rows no step has told apart
    prefix = np.full(n, depth, np.int32)
    prefix[0] = 0
    for step in range(depth):
        rows = np.empty(n, np.int64)
        rows[~second] = np.arange(len(x.symbols))
        rows[second] = np.arange(len(x.symbols), n)
        symbols = both[rows]
        order = np.argsort(symbols, kind="stable")
        second = second[order]
        symbols, interval = symbols[order], interval[order]
        apart = np.empty(n, bool)
        apart[0] = True
        apart[1:] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        np.minimum(prefix, step, out=prefix, where=apart)
        interval = np.cumsum(apart, dtype=np.int32)
    rows = np.empty(n, np.int64)
    rows[~second] = np.arange(len(x.symbols))
    rows[second] = np.arange(len(x.symbols), n)
    return Transform(both[rows], np.concatenate([x.places, y.places])[rows]), prefix


def block_repeats(contexts: list[tuple[int, bytes]], window: int) -> Iterator[tuple[int, int]]:
    """(context, offset) of every window whose bytes also start in a context of a smaller document; contexts are (document, bytes)."""
    if len(contexts) < 2:
        return
    sizes = np.array([len(c) + 1 for _, c in contexts])
    begins = np.cumsum(sizes) - sizes
    whole = np.frombuffer(b"".join(c + b"\0" for _, c in contexts), np.uint8).astype(np.int64) + 1
    whole[begins + sizes - 1] = 0
    whole = np.unique(whole, return_inverse=True)[1].ravel()  # few symbols, in the same order
    owner = np.repeat(np.arange(len(contexts)), sizes)
    place = np.arange(len(whole))
    kind = np.uint8 if whole.max() < 256 else np.uint16
    shards = [shard_transform(whole[k], place[k], window, kind) for s in range(SHARDS)
              if (k := owner % SHARDS == s).any()]
    while len(shards) > 1:
        pairs = [merged(a, b, window) for a, b in zip(shards[::2], shards[1::2])]
        prefix = pairs[0][1]
        shards = [t for t, _ in pairs] + shards[len(pairs) * 2:]
    rows = shards[0].places
    heads = np.flatnonzero(prefix < window)
    # Windows that reach a separator aren't windows of a document.
    inside = (begins + sizes - 1)[owner[rows]] - rows >= window
    document = np.array([d for d, _ in contexts])[owner[rows]]
    smallest = np.minimum.reduceat(np.where(inside, document, np.iinfo(np.int64).max), heads)
    later = inside & (np.repeat(smallest, np.diff(np.append(heads, len(rows)))) < document)
    found = rows[later]
    yield from zip(owner[found].tolist(), (found - begins[owner[found]]).tolist())


def _resolve(kind: Kind):
    def found(rows: list[tuple]) -> list[tuple]:
        starts: dict[int, list[int]] = {}
        for k, offset in block_repeats([(i, c) for i, _, _, c in rows], kind.window):
            starts.setdefault(k, []).append(rows[k][2] + offset)
        return [(*rows[k][:2], s) for k, s in starts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, out = [], 0, []
        for rows, known in contexts_of(batches, kind):
            out += known
            if len(rows) > 1:
                block += rows
                size += sum(len(c) for *_, c in rows)
            if size >= BLOCK or len(out) >= 10_000:
                yield spans(out + found(block))
                block, size, out = [], 0, []
        yield spans(out + found(block))

    return run


def _finish(kind: Kind, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_removed, n_spans, kept = [], [], []
            for k, (pos, starts) in enumerate(zip(batch.column("pos").to_pylist(), batch.column("starts").to_pylist())):
                raw = data[offsets[k]:offsets[k + 1]]
                removed = runs = 0
                if pos or starts:
                    gone = covered(len(raw), pos, starts, kind)
                    removed = int(gone.sum())
                    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    raw = raw[~gone]
                n_removed.append(removed)
                n_spans.append(runs)
                kept.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array([x if keep else None for x in kept], pa.binary()),
                 pa.array([sha256(x).hexdigest() for x in kept], pa.string())], names=RESULT.names)

    return run


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   keep_bytes: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256."""
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = Kind(False, window, gram)
    out = repeated(bare, kind, _resolve(kind), work_dir(docs.sparkSession, "bytes"), _finish(kind, keep_bytes), RESULT)
    out = out.withColumnRenamed("id", id)
    return out if keep_bytes else out.drop("kept")
