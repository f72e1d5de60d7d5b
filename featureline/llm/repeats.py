"""Windows of ``window`` symbols (words or bytes) that also start in a document with a smaller id.

Finding what can repeat. In each window the ``gram`` of the smallest hash is its anchor, so equal windows have equal
anchors. A window lies in the *context* of its anchor: the anchor with ``window - gram`` symbols on each side. Each task
joins its own anchors first: of documents with equal contexts only the first is sent, and all windows of that context
repeat in the others. What is sent is packed in byte strings, one for each bucket of anchors, so that sorting and
comparing are array operations. Contexts are compared by 64-bit hashes here: an anchor with m distinct contexts has
about m * m / 2 ** 65 false matches.

A bucket's task joins equal contexts in the same way. Anchors of one document only, and anchors with one context only,
are done then. Where an anchor has several contexts (at the ends of repeated passages, and around edits), the contexts'
contents are fetched from the first document of each, dealt by anchor, and handed to ``resolve``, which says which of
their windows start in a smaller document.

Documents are told apart by (id, 31 bits of a hash of the text), so rows that share an id may have different texts;
windows of rows with the same id never count against each other. Rows with a null id are neither changed nor looked up.
What one task holds is a batch, a bucket (a ``1 / buckets`` share of all anchors) or the distinct contexts of one
anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import fields, parts, utf8
from featureline.llm.words import U64, letters, mixed, numbers, split_words

#: Anchors that a task gathers before it sends them.
GATHERED = 1 << 18
#: Bits of the table that tells which documents have findings: 8 MB.
FILTER_BITS = 26
_BYTE = numbers(256, 5)
_STEP = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}
LETTERS = letters((0x20, 0x20), (0x09, 0x0D))

_FOUND = T.StructType(fields("bucket int, packed binary, id long, mark int, pos ints, asked ints, anchors longs"))
_CONTEXTS = T.StructType(fields("anchor long, id long, mark int, start int, at int, content binary"))
SPANS = T.StructType(fields("id long, mark int, starts ints"))


@dataclass(frozen=True)
class Kind:
    """What symbols are, and how long windows and anchors are."""

    words: bool
    window: int
    gram: int

    @property
    def reach(self) -> int:
        return self.window - self.gram

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of several texts, and where each text's begin."""
        if self.words:
            found = split_words(data, offsets, LETTERS)
            return found.hashes, found.first
        return _BYTE[data[offsets[0]:offsets[-1]]], offsets - offsets[0]

    def around(self, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of anchors at ``pos`` in a text of n symbols."""
        return np.maximum(pos - self.reach, 0), np.minimum(pos + self.gram + self.reach, n)


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known, size = np.ones(1 << max(16, (n - 1).bit_length()), U64), 1
        with np.errstate(over="ignore"):
            while size < len(known):
                known[size:2 * size] = known[:size] * U64(pow(base, size, 1 << 64))
                size *= 2
        _powers[base] = known
    return known[:n]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(symbols: np.ndarray, first: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all windows, the anchors' hashes, and hashes of their contexts."""
    n, k, w = len(symbols), kind.gram, kind.window
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none.astype(U64), none.astype(U64)
    back = _power(pow(_STEP, -1, 1 << 64), n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(symbols * _power(_STEP, n), out=total[1:])
        gram = mixed((total[k:] - total[:-k]) * back[:n - k + 1])
    sizes = np.diff(first)
    end, start = np.repeat(first[1:], sizes), np.repeat(first[:-1], sizes)
    at = np.arange(n - k + 1)
    # Grams that leave their text are never the smallest, and windows that do have none; hashes are cut to 1 ... 2 ** 32 - 2.
    order = np.clip(gram >> U64(32), 1, (1 << 32) - 2).astype(np.uint32)
    order[at + k > end[:n - k + 1]] = (1 << 32) - 1
    least = _slide(order, kind.reach + 1, np.minimum)
    least[at[:n - w + 1] + w > end[:n - w + 1]] = 0
    edge = np.zeros(kind.reach, np.uint32)
    own = _slide(np.concatenate([edge, least, edge]), kind.reach + 1, np.maximum)
    p = np.flatnonzero(own == order)
    a, b = np.maximum(start[p], p - kind.reach), np.minimum(end[p], p + k + kind.reach)
    with np.errstate(over="ignore"):
        shape = (p - a).astype(U64) * U64(0xD6E8FEB86659FD93) + (b - p).astype(U64) * U64(0xA0761D6478BD642F)
        context = mixed((total[b] - total[a]) * back[a] + shape)
    return p, gram[p], context


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _by_document(ids: np.ndarray, marks: np.ndarray, pos: np.ndarray, anchor: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    """One row for each document: places of anchors whose context repeats, and, where ``asks``, places to be looked at with their anchors."""
    o = np.lexsort((pos, marks, ids))
    ids, marks, pos, anchor, asks = (x[o] for x in (ids, marks, pos, anchor, asks))
    head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]))
    before = np.concatenate([[0], np.cumsum(asks)])[np.append(head, len(ids))]  # questions before each document
    bounds = np.append(head, len(ids)) - before
    # Findings go through the exchange with the anchors; the bucket only spreads them.
    return pa.RecordBatch.from_arrays(
        [pa.array((ids[head] % (1 << 30)).astype(np.int32)), pa.nulls(len(head), pa.binary()), pa.array(ids[head]), pa.array(marks[head]),
         _lists(pos[~asks], bounds, pa.int32()), _lists(pos[asks], before, pa.int32()),
         _lists(anchor[asks].view(np.int64), before, pa.int64())], names=_FOUND.names)


def _joined(anchor, context, ids, marks, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the occurrences of equal anchors: an order of those that aren't alone, and in it which repeat a smaller document's
    context, and where each anchor begins."""
    o = np.argsort(anchor, kind="stable")
    same = anchor[o][1:] == anchor[o][:-1]
    several = np.zeros(len(o), bool)
    several[1:] |= same
    several[:-1] |= same
    o = o[several]
    o = o[np.lexsort((pos[o], marks[o], ids[o], context[o], anchor[o]))]
    a, c, i = anchor[o], context[o], ids[o]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])[:len(o)]
    new_context = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])[:len(o)]
    heads = np.flatnonzero(new_context)
    smallest = np.repeat(i[heads], np.diff(np.append(heads, len(o)))) if len(o) else i
    return o, i > smallest, new_anchor


def _packed(bucket_bits: int, anchor, context, ids, marks, pos) -> Iterator[pa.RecordBatch]:
    """The occurrences as a byte string for each bucket."""
    o = np.argsort(anchor, kind="stable")
    anchor, context, ids, marks, pos = (x[o] for x in (anchor, context, ids, marks, pos))
    bounds = np.searchsorted(anchor >> U64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1).astype(U64))
    for b in range(1 << bucket_bits):
        k = slice(bounds[b], bounds[b + 1])
        if k.start == k.stop:
            continue
        docs, place = np.unique(np.stack([ids[k], marks[k].astype(np.int64)]), axis=1, return_inverse=True)
        steps = np.diff(docs[0], prepend=0)
        low = (anchor[k] << U64(bucket_bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
        planes = lambda x, kind: x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
        body = b"".join([low.T.tobytes(), planes(context[k], "<u8"), planes(place.ravel(), "<u4"), planes(pos[k], "<u4"),
                         steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), docs[1].astype("<i4").tobytes()])
        head = np.array([k.stop - k.start, docs.shape[1]], "<i8").tobytes()
        one = [pa.array([b], pa.int32()), pa.array([head + body], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
               *(pa.nulls(1, pa.list_(pa.int32())) for _ in range(2)), pa.nulls(1, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(one, names=_FOUND.names)


def _unpacked(raw: bytes, bucket: int, bucket_bits: int) -> tuple[np.ndarray, ...]:
    n, n_docs = np.frombuffer(raw, "<i8", 2)
    at = 16

    def planes(width: int, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count).T
        at += width * count
        return got

    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = planes(5, n)
    anchor = (low.view(">u8").ravel().astype(U64) >> U64(bucket_bits)) | (U64(bucket) << U64(64 - bucket_bits))
    context, place, pos = (np.ascontiguousarray(planes(width, n)).view(f"<u{width}").ravel() for width in (8, 4, 4))
    ids = np.cumsum(np.ascontiguousarray(planes(8, n_docs)).view("<i8").ravel())
    marks = np.frombuffer(raw, "<i4", n_docs, at)
    return anchor, context, ids[place], marks[place], pos.astype(np.int32)


def _send(kind: Kind, bucket_bits: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        anchor, context, ids, marks, pos = (np.concatenate(x) for x in zip(*held))
        o, repeats, _ = _joined(anchor, context, ids, marks, pos)
        done = o[repeats]
        if len(done):
            yield _by_document(ids[done], marks[done], pos[done], anchor[done], np.zeros(len(done), bool))
        left = np.ones(len(anchor), bool)
        left[done] = False
        yield from _packed(bucket_bits, *(x[left] for x in (anchor, context, ids, marks, pos)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for a, b in parts(offsets):
                symbols, first = kind.symbols(data, offsets[a:b + 1])
                p, anchor, context = anchors(symbols, first, kind)
                d = np.searchsorted(first, p, side="right") - 1
                # An anchor's hash is a small one, so it is mixed again: buckets are ranges of equal shares.
                held.append((mixed(anchor), context, ids[a + d], marks[a + d], (p - first[d]).astype(np.int32)))
                n += len(p)
                if n >= GATHERED:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _join(bucket_bits: int):
    def bucket_of(held: list) -> Iterator[pa.RecordBatch]:
        anchor, context, ids, marks, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        o, repeats, new_anchor = _joined(anchor, context, ids, marks, pos)
        if not len(o):
            return
        # Anchors with several contexts and several documents: of each context, the occurrences in its first document.
        heads = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        several = (np.maximum.reduceat(ids[o], heads) > np.minimum.reduceat(ids[o], heads)) \
            & (np.maximum.reduceat(context[o], heads) > np.minimum.reduceat(context[o], heads))
        asks = several[group] & ~repeats
        told = asks | repeats
        if told.any():
            k = o[told]
            yield _by_document(ids[k], marks[k], pos[k], anchor[k], asks[told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            packed = batch.column("packed")
            ready = batch.filter(packed.is_null())
            if len(ready):
                yield ready
            for b, raw in zip(batch.column("bucket").to_pylist(), packed):
                if not raw.is_valid:
                    continue
                if b != bucket and held:
                    yield from bucket_of(held)
                bucket = b
                held.append(_unpacked(raw.as_buffer().to_pybytes(), b, bucket_bits))
        if held:
            yield from bucket_of(held)

    return run


def _fetch(kind: Kind):
    """Contents of the contexts asked for, in rows dealt by anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows: list[tuple] = []
            for k, (i, mark, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "asked")))):
                raw = data[offsets[k]:offsets[k + 1]]
                words = split_words(raw, np.array([0, len(raw)]), LETTERS) if kind.words else None
                n = len(words.starts) if kind.words else len(raw)
                for each in asked:
                    pos = np.array(each["pos"])
                    for p, s, e, anchor in zip(each["pos"], *(x.tolist() for x in kind.around(pos, n)), each["anchors"]):
                        got = raw[words.starts[s]:words.ends[e - 1]] if kind.words else raw[s:e]
                        rows.append((anchor, i, mark, s, p - s, got.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                    names=_CONTEXTS.names)

    return run


def _agreeing(sides: list) -> list[int]:
    """How much of each side begins like some other side: what it shares with a neighbour in sorted order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    most = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        x, y, n = sides[i], sides[j], 0
        for a, b in zip(x, y):
            if a != b:
                break
            n += 1
        most[i], most[j] = max(most[i], n), max(most[j], n)
    return most


def contexts_of(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """For each anchor, from rows in the order of anchors: its distinct contexts (id, mark, start, symbols) in the order of ids, and
    the windows (id, mark, starts) that are known to repeat.

    The ends of a context that agree with no other one can't be in a repeat, so they are cut off. Contexts that become equal are joined:
    the first document's goes on, in the others all of its windows repeat.
    """
    def joined(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        symbols = [c.split() if kind.words else c for *_, c in rows]
        left = _agreeing([s[:at][::-1] for s, (*_, at, _) in zip(symbols, rows)])
        right = _agreeing([s[at + kind.gram:] for s, (*_, at, _) in zip(symbols, rows)])
        first, known = {}, []
        for s, (i, mark, start, at, _), a, b in zip(symbols, rows, left, right):
            s, start = s[at - a:at + kind.gram + b], start + at - a
            if len(s) < kind.window:
                continue
            key = tuple(s) if kind.words else s
            if (old := first.setdefault(key, (i, mark, start, s)))[0] < i:
                known.append((i, mark, list(range(start, start + len(s) - kind.window + 1))))
            elif old[1:3] != (mark, start):  # once more in the first document
                first[key, mark, start] = (i, mark, start, s)
        return sorted(first.values(), key=lambda x: x[0]), known

    last, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _CONTEXTS.names)):
            if row[0] != last and held:
                yield joined(held)
                held = []
            last = row[0]
            held.append(row[1:])
    if held:
        yield joined(held)


def spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=SPANS.names)


def _bit(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def _table(keys: DataFrame):
    """A broadcast bit table of the documents (id, mark); it lets through all of them, and few others."""
    words = keys.select(_bit("id", "mark").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64))))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def _through(shared, wanted: bool):
    """Rows that the table lets through, or the others. Without the column ``bit``, which only serves here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, U64)
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            take = ((bits[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(take if wanted else ~take)).select([n for n in batch.schema.names if n != "bit"])

    return run


def marked(docs: DataFrame) -> DataFrame:
    """(id, mark, text) of every row; null texts are empty."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("mark", F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int"))


def repeated(docs: DataFrame, kind: Kind, resolve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], folder: str,
             finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], results: T.StructType) -> DataFrame:
    """Runs ``finish`` over every row of docs (id, text), with ``pos`` (anchors whose context repeats) and ``starts`` (windows that do)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (partitions - 1).bit_length())
    docs = marked(docs).select("id", "mark", "text")
    docs.where("id IS NOT NULL").mapInArrow(_send(kind, bits), _FOUND).repartition(partitions, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_join(bits), _FOUND).drop("bucket", "packed").write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")

    questions = found.where("size(anchors) > 0")
    schema = T.StructType(fields("id long, mark int, text string"))
    tested = docs.withColumn("bit", _bit("id", "mark"))
    likely = tested.mapInArrow(_through(_table(questions), True), schema)
    questions = questions.groupBy("id", "mark").agg(F.collect_list(F.struct(F.col("asked").alias("pos"), "anchors")).alias("asked"))
    likely.join(questions, ["id", "mark"]).mapInArrow(_fetch(kind), _CONTEXTS).repartition(partitions, "anchor") \
        .sortWithinPartitions("anchor", "id", "mark", "start").mapInArrow(resolve, SPANS).write.parquet(f"{folder}/resolved")
    resolved = spark.read.parquet(f"{folder}/resolved")

    none = F.array().cast("array<int>")
    findings = found.where("size(pos) > 0").select("id", "mark", "pos", none.alias("starts")).unionByName(
        resolved.select("id", "mark", none.alias("pos"), "starts"))
    findings = findings.groupBy("id", "mark").agg(F.flatten(F.collect_list("pos")).alias("pos"),
                                                  F.flatten(F.collect_list("starts")).alias("starts"))
    findings.write.parquet(f"{folder}/findings")
    findings = spark.read.parquet(f"{folder}/findings")
    table = _table(findings)
    changed = tested.mapInArrow(_through(table, True), schema).join(findings, ["id", "mark"], "left").select("id", "text", "pos", "starts")
    others = _through(table, False)
    same = tested.withColumns({"pos": none, "starts": none}).mapInArrow(lambda batches: finish(others(batches)), results)
    return changed.mapInArrow(finish, results).unionByName(same)


def covered(n: int, pos: list[int] | None, starts: list[int] | None, kind: Kind) -> np.ndarray:
    """Which of a text's n symbols lie in repeated windows."""
    change = np.zeros(n + 1, np.int32)
    if pos:
        a, b = kind.around(np.array(pos), n)
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    if starts:
        a = np.array(starts)
        np.add.at(change, a, 1)
        np.add.at(change, a + kind.window, -1)
    return np.cumsum(change[:-1]) > 0
