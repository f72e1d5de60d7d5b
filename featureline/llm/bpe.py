"""Byte-level BPE: a backtracking encoder and a decoder with an offset table.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are *compatible*: no
merge across their border would have come before the merges that built them. So the encoder goes from left to right,
takes the longest token at each place (found for all places by one pass of an Aho-Corasick automaton), and keeps it if
it is compatible with the token before; else it tries the next shorter token, and goes one token back where none fits.
Places that can't be completed are marked, so that no place is tried twice and the work is linear in the text.

Texts are encoded in runs. A run's distinct pieces that the worker does not know yet are cut into pre-tokens, and all
of these go through the automaton and the backtracking together, one step of each at a time, in arrays. The automaton
reads them from their ends, over tokens turned round: its state at a place then names the longest token that begins there.

Decoding. All tokens lie one after the other in one byte string; an offset table says where each begins.

Null texts count as empty; an empty text has no tokens. Rows are independent of each other, so repeated rows and any
number of rows per source give the same results, and an empty table gives an empty one. Other columns stay, but for
those with the names of results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import batched, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import fields, held, others as other_columns

#: Entries that a Python worker keeps of what it has encoded; beyond that, only those of the present run stay.
CACHE_ENTRIES = 240_000
#: Characters of text in a run, but for longer texts, and bytes of the longest pre-tokens that are encoded together.
RUN, LONG = 1 << 20, 128
#: Pre-tokens that are encoded together at most: some MB of arrays, however long a text is.
TOGETHER = 1 << 16
#: Bits of a slot in the table of compatible pairs. A pair takes the slot of an older one.
PAIR_BITS = 20
RESULT = fields("n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder for a vocabulary file of the ``tokenizers`` library with a byte-level BPE model."""

    def __init__(self, definition: str):
        import regex

        spec = json.loads(definition)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normaliser is needed")
        if spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("add_prefix_space and ignore_merges are not supported")
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Tokens in order of rank: the 256 bytes, then what each merge makes.
        self.tokens = [bytes([b]) for b in range(256)] + [raw(a) + raw(b) for a, b in merges]
        rank = {t: i for i, t in enumerate(self.tokens)}
        if len(rank) != len(self.tokens):
            raise ValueError("two merges make the same token")
        self.halves = [(i, i) for i in range(256)] + [(rank[raw(a)], rank[raw(b)]) for a, b in merges]
        self.merged = {pair: i for i, pair in enumerate(self.halves) if i >= 256}
        vocabulary = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.id_of = [vocabulary[t] for t in self.tokens]
        self.id_bytes = [i.to_bytes(4, "little") for i in self.id_of]
        self.sizes = [len(t) for t in self.tokens]
        self._sizes, self._ids = np.array(self.sizes), np.array(self.id_of, "<u4")
        self._compatible: dict[int, bool] = {}
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special_ids = {s: i.to_bytes(4, "little") for s, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        # The pattern of byte-level pre-tokenisation, a fixed value.
        self._words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        # A space that stands between other text always begins a pre-token, unless white space is on both sides of it.
        self._crowded = regex.compile(r"\p{White_Space} (?:\p{White_Space}|\Z)")
        self._borders = regex.compile(r"(?V1)(?<=\P{White_Space})(?= )|(?= \P{White_Space})")
        self._chunks: dict[str, bytes] = {}  # of pieces between spaces
        self._pair_table()
        self._automaton(rank)
        self._offset_table(special)

    def _automaton(self, rank: dict[bytes, int]) -> None:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.tokens)
        for i in sorted(range(len(self.tokens)), key=lambda i: self.sizes[i]):
            t = self.tokens[i]
            for n in range(len(t) - 1, 0, -1):
                if (p := rank.get(t[:n])) is not None and self.reachable(p):
                    self.shorter[i] = p
                    break
            if self.reachable(i):
                automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        automaton.make_automaton()
        self._longest = automaton
        self._shorter = np.array(self.shorter, np.int32)
        self._from_ends({t[::-1]: i for t, i in rank.items() if self.reachable(i)})

    def _from_ends(self, turned: dict[bytes, int]) -> None:
        """The same automaton as tables, over tokens turned round: states by row of moves, and the longest token of each."""
        moves: dict[int, int] = {}
        parent, letter, token = [0], [0], [-1]
        for t, i in turned.items():
            node = 0
            for b in t:
                child = moves.get(node << 8 | b)
                if child is None:
                    child = moves[node << 8 | b] = len(parent)
                    parent.append(node)
                    letter.append(b)
                    token.append(-1)
                node = child
            token[node] = i
        parent, letter, best = np.array(parent), np.array(letter), np.array(token, np.int32)
        depth = np.zeros(len(parent), np.int64)
        for v in range(1, len(parent)):  # parents come first
            depth[v] = depth[parent[v]] + 1
        inner = np.unique(parent)
        # A state without children moves as the one does that it falls back to; so it has no row of its own.
        row, fail = np.zeros(len(parent), np.int32), np.zeros(len(parent), np.int64)
        row[inner] = np.arange(len(inner))
        step = np.zeros((len(inner), 256), np.int32)
        for d in range(depth.max() + 1):
            at = np.flatnonzero(depth == d)
            if d > 1:
                fail[at] = step[row[fail[parent[at]]], letter[at]]
            best[at] = np.where(best[at] < 0, best[fail[at]], best[at])
            own = np.isin(at, inner)
            row[at[~own]] = row[fail[at[~own]]]
            step[row[at[own]]] = step[row[fail[at[own]]]]
            below = np.flatnonzero(depth == d + 1)
            step[row[parent[below]], letter[below]] = below
        self._row, self._step, self._best = row, step.ravel(), best

    def _pair_table(self) -> None:
        halves = np.array(self.halves, np.int64)
        self._left, self._right = halves[:, 0], halves[:, 1]
        pairs = halves[256:, 0] * len(halves) + halves[256:, 1]
        order = np.argsort(pairs)
        self._pairs, self._made = np.append(pairs[order], -1), np.append(order + 256, 0)
        self._pair_slots = np.full(1 << PAIR_BITS, -1, np.int64)

    def reachable(self, token: int) -> bool:
        """Whether the token's own halves, each reachable, would merge into it."""
        a, b = self.halves[token]
        return token < 256 or (self.reachable(a) and self.reachable(b) and self._meets(a, b, token))

    def _meets(self, a: int, b: int, until: int) -> bool:
        """Whether nothing merges across the border of a and b before the merge of rank ``until``."""
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < until:
                return False
            # Of the two tokens at the border the one that was merged last is taken apart: before, its inner half stood here.
            if a > b:
                until, inner = min(until, a), self.halves[a][1]
                if inner == a:
                    return True
                a = inner
            else:
                # Of equal ranks the left one is made first, so the right one can still meet it whole.
                until, inner = min(until, b + 1), self.halves[b][0]
                if inner == b:
                    if a < 256:
                        return True
                    until, a = min(until, a), self.halves[a][1]
                else:
                    b = inner

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= CACHE_ENTRIES:
                self._compatible.clear()
            known = self._compatible[key] = self._meets(a, b, len(self.tokens))
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        longest = [0] * len(word)
        for end, (back, token) in self._longest.iter(word.decode("latin-1")):
            longest[end - back] = token  # of those that begin here the longest ends last
        sizes, shorter, known, compatible = self.sizes, self.shorter, self._compatible.get, self.compatible
        out, at, last, size, dead = [], 0, -1, len(word), set()
        while at < size:
            token = longest[at]
            while True:
                if token < 0:  # no token fits here: the one before must be shorter
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    last = out[-1] if out else -1
                elif at + sizes[token] not in dead:
                    fits = last < 0 or known(last << 32 | token)
                    if fits or fits is None and compatible(last, token):
                        break
                token = shorter[token]
            out.append(token)
            at += sizes[token]
            last = token
        return out

    def _meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_meets` for many pairs of tokens."""
        out, pair, until = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), len(self.tokens))
        while len(pair):
            key = a * len(self.tokens) + b
            place = np.searchsorted(self._pairs[:-1], key)
            merged = (self._pairs[place] == key) & (self._made[place] < until)
            out[pair[merged]] = False
            go = np.flatnonzero(~merged & (np.maximum(a, b) >= 256))
            a, b, until, pair = a[go], b[go], until[go], pair[go]
            first = a > b
            until = np.minimum(until, np.where(first, a, b + 1))
            a, b = np.where(first, self._right[a], a), np.where(first, b, self._left[b])
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compatible` for many pairs of tokens."""
        key = a.astype(np.int64) * len(self.tokens) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        found = self._pair_slots[slot]
        out = (found & 1).astype(bool)
        fresh = np.flatnonzero(found >> 1 != key)
        if len(fresh):
            out[fresh] = self._meet(a[fresh].astype(np.int64), b[fresh].astype(np.int64))
            self._pair_slots[slot[fresh]] = key[fresh] << 1 | out[fresh]
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are not empty: :meth:`encode_word`, one step of each at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        limits = np.cumsum(sizes + 1) - 1
        starts = limits - sizes
        longest = np.zeros(len(letters), np.int32)
        ends, length = (x[np.argsort(-sizes, kind="stable")] for x in (limits, sizes))
        state = np.zeros(len(words), np.int32)
        for back in range(int(length[0])):
            at = ends[:np.searchsorted(-length, -back)] - 1 - back
            state = self._step[(self._row[state[:len(at)]].astype(np.int64) << 8) + letters[at]]
            longest[at] = self._best[state]
        token_sizes, shorter = self._sizes, self._shorter
        out, dead, counts = np.zeros(len(letters), np.int32), np.zeros(len(letters), bool), np.zeros(len(words), np.int64)
        word, start, at, limit = np.arange(len(words)), starts, starts.copy(), limits
        put, last, token = starts.copy(), np.full(len(words), -1, np.int32), longest[starts]
        while len(word):
            none = np.flatnonzero(token < 0)
            if len(none):  # no token fits here: the one before must be shorter
                dead[at[none]] = True
                put[none] -= 1
                token[none] = out[put[none]]
                at[none] -= token_sizes[token[none]]
                last[none] = np.where(put[none] > start[none], out[put[none] - 1], -1)
            end = at + token_sizes[token]
            fits = ~dead[end]
            fits[none] = False
            asked = np.flatnonzero(fits & (last >= 0))
            fits[asked] = self._fit(last[asked], token[asked])
            out[put[fits]] = token[fits]
            put += fits
            last = np.where(fits, token, last)
            at = np.where(fits, end, at)
            token = np.where(fits, longest[at], shorter[token])
            done = at == limit
            if done.any():
                counts[word[done]] = put[done] - start[done]
                word, start, at, limit, put, last, token = (x[~done] for x in (word, start, at, limit, put, last, token))
        ids = self._ids[out].tobytes()
        return [ids[4 * a:4 * z] for a, z in zip(starts.tolist(), (starts + counts).tolist())]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of pieces between spaces."""
        words = list(map(self._words.findall, chunks))
        ids: dict[str, bytes] = {}
        short: dict[str, bytes] = {}
        for w in set(chain.from_iterable(words)):
            raw = w.encode()
            if len(raw) <= LONG:
                short[w] = raw
            else:
                ids[w] = b"".join([self.id_bytes[t] for t in self.encode_word(raw)])
        for some in batched(short, TOGETHER):
            ids.update(zip(some, self._together([short[w] for w in some])))
        return {c: ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for c, w in zip(chunks, words)}

    def _cut(self, text: str) -> list[str]:
        if self._crowded.search(text):
            return self._borders.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def _plain(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self._cut, texts))
        present = set().union(*cut)
        fresh = self._learn(list(present.difference(self._chunks)))
        self._chunks.update(fresh)
        out = [b"".join(map(self._chunks.__getitem__, c)) for c in cut]
        for c in fresh:
            if len(c) > 64:
                del self._chunks[c]
        if len(self._chunks) > CACHE_ENTRIES:
            self._chunks = {c: self._chunks[c] for c in islice(present.intersection(self._chunks), CACHE_ENTRIES)}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; special strings in a text become their own ids."""
        special = self._special_ids
        parts = [self._specials.split(t) if any(s in t for s in special) else [t] for t in texts]
        plain = iter(self._plain([p for ps in parts for p in ps[::2]]))
        return [next(plain) if len(ps) == 1 else b"".join([special[p] if k % 2 else next(plain) for k, p in enumerate(ps)])
                for ps in parts]

    def _offset_table(self, special: dict[str, int]) -> None:
        by_id = dict(zip(self.id_of, self.tokens)) | {i: s.encode() for s, i in special.items()}
        sizes = np.zeros(max(by_id) + 2, np.int64)
        for i, t in by_id.items():
            sizes[i + 1] = len(t)
        self._offsets = np.cumsum(sizes)
        self._bytes = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the tokens stand for."""
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        starts, sizes = self._offsets[ids], self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(sizes)
        return self._bytes[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, with null as empty, in runs of some RUN characters; a longer text ends its run."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= RUN:
            yield some
            some, size = [], 0
    yield some


def _loaded(definition: str) -> ByteBPE:
    return held(("bpe", definition), lambda: ByteBPE(definition))


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 and decoded_sha256 to every row; ``text`` is dropped.

    ``vocabulary`` is the path of a vocabulary file on the driver; its content (a few MB, whatever the table's size) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    results = [f for f in RESULT if keep_ids or f.name != "ids"]
    others = other_columns(docs, text, *(f.name for f in results))
    schema = T.StructType([docs.schema[c] for c in others] + results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(definition.value)
        for batch in batches:
            columns = {c: batch.column(c) for c in others}
            texts = batch.column("__featureline_text")
            ids = [x for some in _runs(texts) for x in bpe.encode(some)]
            made = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()),
                    "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array(
                        [sha256(bpe.decode(x).decode(errors="replace").encode()).hexdigest() for x in ids], pa.string())}
            columns |= {f.name: made[f.name] for f in results}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(*others, F.col(text).cast("string").alias("__featureline_text")).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, vocabulary: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replaces the ids of :func:`encode_documents` by their text; null gives an empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        definition = rows.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in rows.columns if c not in (ids, text)]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(definition.value)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or b"").decode(errors="replace") for x in batch.column("__featureline_ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(texts, pa.string())],
                                             names=[*others, text])

    return rows.select(*others, F.col(ids).alias("__featureline_ids")).mapInArrow(run, schema)
