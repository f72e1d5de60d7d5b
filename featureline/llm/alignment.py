"""Alignment of two tokenizers' tokens: a byte-level BPE (A) and a sentencepiece BPE (B).

Both encode every text whole. Where tokens of A and of B end at the same byte and the next token of each begins with a space,
there is an *anchor*; anchors split a document into windows of token ids. Windows repeat, so each worker keeps the alignment
of every pair of id tuples it has met: the groups between the byte offsets where tokens of A and B both end, their text form
and the id pairs they link. A batch looks up each distinct window once; windows are told apart by hash and then compared id
by id. The bytes of all tokens are compared with the text before, and a document where they differ has no tokens.

Corpus-wide counts: of each id pair, how many documents hold it linked. Every document's distinct pairs are written packed;
tasks sum up their own before Spark does. Pairs are then looked up in two tiers: the most frequent ones, ``hot_pairs`` at
most, in a broadcast table (12 bytes each); the others through a shuffle by pair, in which no pair is frequent. The highest
count of each A id is an array of the vocabulary's size.

Null and empty texts have no tokens. Rows are taken one by one, so repeated rows and ids, and null ids, are documents of
their own, and results are put together by a key that is written with the rows. An empty table gives an empty one. Other
columns stay, but for those with the names of results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.bpe import _byte_letters
from featureline.llm.frames import fields, others, parts, record, utf8
from featureline.llm.token_counts import _processor
from featureline.llm.words import U64, mixed, numbers
from featureline.session import work_dir

RESULT = T.StructType(fields("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
#: Windows that a worker keeps; it begins anew beyond that.
CACHE_ENTRIES = 200_000
#: The pattern of byte-level pre-tokenisation, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pairs that a task sums up before it sends them.
GATHERED = 1 << 20
_KEY = "__featureline_key"
_FIRST = T.StructType(fields("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"))
_PAIRS = T.StructType(fields("pair long, n long"))
_LOOKED = T.StructType([T.StructField(_KEY, T.LongType()), *fields("n_best long, count_sum long, rare_pairs longs, rare_times longs")])
_SEED = numbers(2, 21)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces as one string, and where each begins."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def _ragged(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[begin:begin + size]``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)]


def _gathered(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens, and where each token ends."""
    data, offsets = table
    sizes = offsets[ids + 1] - offsets[ids]
    return _ragged(data, offsets[ids], sizes), np.cumsum(sizes)


class Column:
    """An array that grows at its end."""

    def __init__(self):
        self._held, self.size = np.zeros(1024, np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self._held):
            self._held = np.concatenate([self.array, np.zeros(2 * len(self._held) + len(values), np.int64)])
        self._held[self.size:self.size + len(values)] = values
        self.size += len(values)

    @property
    def array(self) -> np.ndarray:
        return self._held[:self.size]


class Windows:
    """Alignments by id tuples: the place of each, and in that order their groups as text, numbers of groups and links, and links."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.groups, self.links, self.first, self.pairs = Column(), Column(), Column(), Column()

    def add(self, keys: list[bytes], texts: list[bytes], groups: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        self.place |= zip(keys, range(len(self.texts), len(self.texts) + len(keys)))
        self.texts += texts
        self.groups.extend(groups)
        self.links.extend(links)
        self.first.extend(self.pairs.size + np.cumsum(links) - links)
        self.pairs.extend(pairs)


def byte_level(definition: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE vocabulary, whose ids follow the order of merges."""
    spec = json.loads(definition)
    letters = _byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    vocabulary = spec["model"]["vocab"]
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") \
            or made != sorted(made):
        raise ValueError("a byte-level BPE vocabulary with ids in the order of merges is needed")
    return {raw(t): i for t, i in vocabulary.items() if all(c in letters for c in t)}


class Aligner:
    """Both tokenizers with their token bytes, and the windows aligned so far."""

    def __init__(self, vocabulary: str, model: bytes):
        import tiktoken

        ids = byte_level(vocabulary)
        # Without special tokens, whose strings are plain text.
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self._b = sp = _processor(model)
        bytes_of = {i: t for t, i in ids.items()}
        self.a = _table([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)])
        self.b = _table([bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                         for i in range(sp.get_piece_size())])
        self.sizes_a, self.sizes_b = np.diff(self.a[1]), np.diff(self.b[1])
        self.spaced_a, self.spaced_b = (self._spaced(t) for t in (self.a, self.b))
        self._decimals = _table([b"%d," % i for i in range(max(len(self.sizes_a), len(self.sizes_b)))])
        self.windows = Windows()

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: the ids of all texts, and where each text's begin. Empty texts have none."""
        out = []
        for each in ([self._a.encode_ordinary(" " + t) if t else [] for t in texts], self._b.encode(texts, num_threads=1) if texts else []):
            first = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            out.append((np.fromiter(chain.from_iterable(each), np.int64, int(first[-1])), first))
        return out

    @staticmethod
    def _spaced(table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        data, offsets = table
        return (np.diff(offsets) > 0) & (data[np.minimum(offsets[:-1], len(data) - 1)] == 0x20)

    def known(self, a: np.ndarray, b: np.ndarray, starts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The places in ``self.windows`` of windows of ids that stand for the same bytes."""
        (sizes_a, begin_a), (sizes_b, begin_b) = ((np.diff(np.append(at, len(ids))), at) for ids, at in ((a, starts[0]), (b, starts[1])))
        kind, one = self._distinct(a, b, starts)
        # Of each distinct window the number of A ids, the A ids and the B ids.
        na, nb = sizes_a[one], sizes_b[one]
        packed = _ragged(np.concatenate([na, a, b]), np.stack([np.arange(len(one)), len(one) + begin_a[one], len(one) + len(a) + begin_b[one]], 1).ravel(),
                         np.stack([np.ones(len(one), np.int64), na, nb], 1).ravel()).astype("<u4").tobytes()
        ends = (4 * np.cumsum(1 + na + nb)).tolist()
        keys = [packed[p:q] for p, q in zip([0, *ends], ends)]
        if len(self.windows.place) + len(keys) > CACHE_ENTRIES:
            self.windows = Windows()
        missing = np.array([k for k, key in enumerate(keys) if key not in self.windows.place], np.int64)
        if len(missing):
            w = one[missing]
            self.windows.add([keys[k] for k in missing.tolist()],
                             *self._aligned(_ragged(a, begin_a[w], sizes_a[w]), _ragged(b, begin_b[w], sizes_b[w]), sizes_a[w], sizes_b[w]))
        return np.array([self.windows.place[key] for key in keys], np.int64)[kind]

    def _aligned(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple:
        """Of windows one after the other: their groups as text and the number of groups, and the linked pairs and their number."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        last_a = np.flatnonzero(ends_b[at] == ends_a)  # of each group
        last_b = at[last_a]
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # Every A id of a group beside every B id of it.
        n = np.repeat(in_b, in_a)
        pairs = np.repeat(a, n) * len(self.sizes_b) + _ragged(b, np.repeat(last_b - in_b + 1, in_a), n)
        # The text: A ids and B ids of each group in turn, each with what stands behind it.
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)
        ids, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        behind[place_a[last_a]], behind[place_b[last_b]] = ord("|"), ord(";")
        text, ends = _gathered(self._decimals, ids)
        text[ends - 1] = behind
        text, cuts = text.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])].tolist()
        windows = np.cumsum(sizes_a)
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.searchsorted(last_a, windows - 1, "right")], prepend=0)
        return [text[p:q - 1] for p, q in zip(cuts, cuts[1:])], count(np.ones(len(last_a), np.int64)), pairs, count(in_a * in_b)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """The results for the texts ``data[offsets[i]:offsets[i + 1]]``."""
        n = len(offsets) - 1
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        ids, first = map(list, zip(*self.encoded(texts)))
        raw, ends = zip(*(_gathered(table, x) for table, x in zip((self.a, self.b), ids)))
        ends = list(ends)
        good = self._verified(data, offsets, texts, raw, ends, first)
        # From here on only tokens of verified documents; all of them lie one after the other in the same bytes.
        for s in (0, 1):
            keep = np.repeat(good, np.diff(first[s]))
            ids[s] = ids[s][keep]
            first[s] = np.concatenate([[0], np.cumsum(np.where(good, np.diff(first[s]), 0))])
            ends[s] = np.cumsum((self.sizes_a, self.sizes_b)[s][ids[s]])
        a, b = ids
        out = {"n_a": np.diff(first[0]), "n_b": np.diff(first[1])}
        starts = self._anchors(a, b, ends, first)
        bounds = np.searchsorted(starts[0], first[0])  # a document begins with a window, since documents end at shared ends
        place = self.known(a, b, starts) if len(a) else np.zeros(0, np.int64)
        groups, links = (x.array[place] for x in (self.windows.groups, self.windows.links))
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        said, order = self.windows.texts.__getitem__, place.tolist()
        out |= {"n_groups": summed(groups), "n_links": summed(links), "groups_sha256": [
            sha256(b";".join(map(said, order[p:q]))).hexdigest() if q > p else "" for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist())]}
        # The distinct pairs of each document, and how often each is linked.
        most = len(self.sizes_a) * len(self.sizes_b)
        key = np.repeat(np.arange(n), out["n_links"]) * most + _ragged(self.windows.pairs.array, self.windows.first.array[place], links)
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        times, key = np.diff(np.append(heads, len(key))).astype("<u4"), key[heads]
        edges = np.searchsorted(key, np.arange(n + 1) * most)
        pairs = (key % most).astype("<i8")
        # Two planes of 32 bits, of which the upper one is mostly zero.
        plane = lambda x: x.view("<u4").reshape(-1, 2).T.tobytes()
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return out | {"pairs": [plane(pairs[p:q]) for p, q in spans], "times": [times[p:q].tobytes() for p, q in spans]}

    @staticmethod
    def _verified(data, offsets, texts, raw, ends, first) -> np.ndarray:
        """Which documents have tokens whose bytes are, in A as in B, a space and the text."""
        n = len(texts)
        good = np.diff(offsets) > 0
        sizes = np.diff(offsets) + 1
        bounds = []
        for s in (0, 1):
            at = np.concatenate([[0], ends[s]])[first[s]]
            good &= np.diff(at) == sizes
            bounds.append(at)
        for k in np.flatnonzero(good).tolist():
            want = data[offsets[k]:offsets[k + 1]]
            for s in (0, 1):
                p, q = bounds[s][k], bounds[s][k + 1]
                if raw[s][p] != 0x20 or not np.array_equal(raw[s][p + 1:q], want):
                    good[k] = False
        assert len(good) == n
        return good

    def _anchors(self, a, b, ends, first) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin: documents, and spaced tokens of A and B behind a shared end."""
        begins = []
        for ids, end, spaced in ((a, ends[0], self.spaced_a), (b, ends[1], self.spaced_b)):
            start = np.concatenate([[0], end])[:-1]
            at = np.flatnonzero(spaced[ids])
            begins.append((start[at], at))
        _, i, j = np.intersect1d(begins[0][0], begins[1][0], assume_unique=True, return_indices=True)
        return begins[0][1][i], begins[1][1][j]  # a document's first tokens are spaced, and begin at the same byte

    @staticmethod
    def _distinct(a, b, starts) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window's kind, and a window of each kind."""
        if not len(starts[0]):
            return (np.zeros(0, np.int64),) * 2
        key = np.zeros(len(starts[0]), U64)
        sizes = []
        with np.errstate(over="ignore"):
            for ids, at, seed in ((a, starts[0], _SEED[0]), (b, starts[1], _SEED[1])):
                size = np.diff(np.append(at, len(ids)))
                place = np.arange(len(ids)) - np.repeat(at, size)
                key = mixed(key + np.add.reduceat(mixed(ids.astype(U64) + mixed(place.astype(U64) + seed)), at) + size.astype(U64))
                sizes.append(size)
        _, firsts, kind = np.unique(key, return_index=True, return_inverse=True)
        same = np.ones(len(kind), bool)
        for ids, at, size in ((a, starts[0], sizes[0]), (b, starts[1], sizes[1])):
            model = firsts[kind]
            same &= size == size[model]
            place = np.arange(len(ids)) - np.repeat(at, size)
            there = np.minimum(np.repeat(at[model], size) + place, len(ids) - 1)
            same &= np.logical_and.reduceat(ids == ids[there], at)
        other = np.flatnonzero(~same)  # of equal hash but unequal ids: kinds of their own
        kind[other] = len(firsts) + np.arange(len(other))
        return kind, np.concatenate([firsts, other])


def _unpacked(pairs: bytes) -> np.ndarray:
    """The pairs of one document: A id times the number of B ids, and B id."""
    return np.ascontiguousarray(np.frombuffer(pairs, "<u4").reshape(2, -1).T).view("<i8").ravel()


@lru_cache(maxsize=1)
def _aligner(vocabulary: str, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


def _summed(pairs: DataFrame) -> DataFrame:
    """How many documents hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda p, n: record(_PAIRS, {"pair": pa.array(p, pa.int64()), "n": pa.array(n, pa.int64())})

        def joined():
            p, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return p, np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

        for batch in batches:
            for x in batch.column(0):
                p = _unpacked(x.as_py())
                held.append((p, np.ones(len(p), np.int64)))
                size += len(p)
                if size >= 4 * GATHERED:
                    p, n = joined()
                    held, size = ([], 0) if len(p) > GATHERED else ([(p, n)], len(p))
                    if not held:
                        yield out(p, n)
        if held:
            yield out(*joined())

    return pairs.mapInArrow(run, _PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame, most: int) -> tuple[int, list]:
    """The least count such that at most ``most`` pairs have it or more, found in a histogram by powers of two eighths, and these pairs."""
    step = F.floor(F.log2("n") * 8).cast("long")
    shares = sorted(((r.step, r.pairs) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    total, border = 0, None
    for at, pairs in shares:
        if total + pairs > most:
            break
        total, border = total + pairs, at
    if border is None:
        return (1 << 62), []
    return border, counts.where(step >= border).collect()


def align(docs: DataFrame, vocabulary: str, model: str, *, text: str = "text", hot_pairs: int = 1 << 19) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to every row; ``text`` is dropped.

    ``vocabulary`` and ``model`` are paths of a byte-level BPE file and a sentencepiece model on the driver; their contents are broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    with open(model, "rb") as f:
        content = f.read()
    shared, pieces = spark.sparkContext.broadcast((definition, content)), _processor(content).get_piece_size()
    kept = others(docs, text, *RESULT.names)
    folder = work_dir(spark, "alignment")
    body = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(kept)]
    schema = T.StructType([T.StructField(_KEY, T.LongType()), *body, *_FIRST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column("__featureline_text"))
            for p, q in parts(offsets, 1 << 20):
                made = aligner.batch(data[offsets[p]:offsets[q]], offsets[p:q + 1] - offsets[p])
                columns = {f.name: batch.column(f.name).slice(p, q - p) for f in schema if f.name not in _FIRST.names}
                kinds = {"pairs": pa.binary(), "times": pa.binary(), "groups_sha256": pa.string()}
                yield record(schema, columns | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items()})

    whole = docs.select(F.monotonically_increasing_id().alias(_KEY), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__featureline_text"))
    whole.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{folder}/documents")
    aligned = spark.read.schema(schema).parquet(f"{folder}/documents")
    _summed(aligned.select("pairs")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema(_PAIRS).parquet(f"{folder}/counts")
    highest = np.zeros(1 << 16, np.int64)
    for r in counts.groupBy(F.expr(f"pair div {pieces}").alias("a")).agg(F.max("n").alias("n")).collect():  # one row for each A id
        if r.a >= len(highest):
            highest = np.pad(highest, (0, r.a + 1 - len(highest)))
        highest[r.a] = r.n
    border, hot = _hot(counts, hot_pairs)
    hot = np.array(sorted((r.pair, r.n) for r in hot), np.int64).reshape(-1, 2)
    table = spark.sparkContext.broadcast((hot[:, 0].copy(), hot[:, 1].copy(), highest))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, highest = table.value
        for batch in batches:
            best, total, rare_pairs, rare_times = [], [], [], []
            for p, t in zip(batch.column(1), batch.column(2)):
                p, t = _unpacked(p.as_py()), np.frombuffer(t.as_py(), "<u4").astype(np.int64)
                at = np.searchsorted(pairs, p)
                found = pairs[np.minimum(at, len(pairs) - 1)] == p if len(pairs) else np.zeros(len(p), bool)
                c = n[at[found]]
                best.append(int(t[found][c == highest[p[found] // pieces]].sum()))
                total.append(int((t[found] * c).sum()))
                rare_pairs.append(p[~found])
                rare_times.append(t[~found])
            yield record(_LOOKED, {_KEY: batch.column(0), "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()),
                                   "rare_pairs": pa.array(rare_pairs, pa.list_(pa.int64())), "rare_times": pa.array(rare_times, pa.list_(pa.int64()))})

    aligned.select(_KEY, "pairs", "times").mapInArrow(look_up, _LOOKED).write.option("compression", "zstd").parquet(f"{folder}/looked_up")
    looked = spark.read.schema(_LOOKED).parquet(f"{folder}/looked_up")
    tops = spark.createDataFrame([(int(a), int(highest[a])) for a in np.flatnonzero(highest)], "a long, top long")
    rare = looked.where(F.size("rare_pairs") > 0).select(_KEY, F.explode(F.arrays_zip("rare_pairs", "rare_times")).alias("x")) \
        .select(_KEY, F.col("x.rare_pairs").alias("pair"), F.col("x.rare_times").alias("times"))
    step = F.floor(F.log2("n") * 8).cast("long")
    known = counts.where(step < border).withColumn("a", F.expr(f"pair div {pieces}")).join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    added = rare.join(known, "pair").groupBy(_KEY).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                                       F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    rows = aligned.drop("pairs", "times").join(looked.select(_KEY, "n_best", "count_sum"), _KEY).join(added, _KEY, "left") \
        .withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *RESULT.names)
