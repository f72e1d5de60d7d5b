"""Substring deduplication by suffix automata of reference shards.

A word is removed if it lies in a window of ``window`` words whose sequence also starts in a document with a smaller id.
A shard holds the distinct contexts (see :mod:`featureline.llm.repeats`) of an anchor; its suffix automaton is built in
the order of ids, so every state knows the smallest document in which its words occur. The contexts then stream through
it: the matching statistics give the longest match that ends at each word, and where it reaches the window's length, the
state of just that length tells the first document. Runs of removed words are the unions of such windows, that is the
maximal spans above the threshold.

An automaton of all documents would not fit a broadcast, so automata are dealt with the documents' contexts instead:
both go to the task of their anchor.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged. Null and empty texts have no words. Windows
are judged on the input. Repeats within a document, and between rows that share an id, stay. Rows with a null id stay as
they are. An empty table gives an empty one. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import fields, utf8
from featureline.llm.repeats import Kind, contexts_of, covered, repeated, spans
from featureline.session import work_dir

WINDOW = 13
#: Words of an anchor.
GRAM = 6
RESULT = T.StructType(fields("id long, n_words long, n_removed long, kept string, kept_sha256 string"))


class Automaton:
    """A suffix automaton of several sequences; states know the first document they were made for."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _state(self, size: int, link: int, follows: dict, first) -> int:
        self.next.append(follows)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the shorter sequences that p leads to."""
        copy = self._state(self.size[p] + 1, self.link[q], self.next[q].copy(), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, document) -> None:
        """Sequences must come in the order of their documents."""
        state = 0
        for word in words:
            q = self.next[state].get(word)
            if q is not None:  # known already: only the length may need a state of its own
                state = q if self.size[q] == self.size[state] + 1 else self._split(state, word, q)
                continue
            new, p = self._state(self.size[state] + 1, 0, {}, document), state
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            state = new

    def matches(self, words: list, window: int) -> Iterator[tuple[int, object]]:
        """(place, first document) of every window of the words that occurs here."""
        state = length = 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= window:
                while self.size[self.link[state]] >= window:
                    state = self.link[state]
                length = min(length, self.size[state])
                yield k - window + 1, self.first[state]


def _resolve(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows, known in contexts_of(batches, kind):
            out += known
            if len(rows) > 1:
                shard = Automaton()
                for i, _, _, words in rows:
                    shard.add(words, i)
                for i, mark, start, words in rows:
                    if starts := [start + k for k, first in shard.matches(words, kind.window) if first < i]:
                        out.append((i, mark, starts))
            if len(out) >= 10_000:
                yield spans(out)
                out = []
        yield spans(out)

    return run


def _finish(kind: Kind, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_words, n_removed, kept = [], [], []
            for k, (pos, starts) in enumerate(zip(batch.column("pos").to_pylist(), batch.column("starts").to_pylist())):
                words = data[offsets[k]:offsets[k + 1]].tobytes().split()
                gone = covered(len(words), pos, starts, kind) if pos or starts else None
                left = words if gone is None else [w for w, g in zip(words, gone) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array([x.decode() if keep else None for x in kept], pa.string()),
                 pa.array([sha256(x).hexdigest() for x in kept], pa.string())], names=RESULT.names)

    return run


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   keep_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, one space between) and kept_sha256."""
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = Kind(True, window, gram)
    out = repeated(bare, kind, _resolve(kind), work_dir(docs.sparkSession, "substrings"), _finish(kind, keep_text), RESULT)
    out = out.withColumnRenamed("id", id)
    return out if keep_text else out.drop("kept")
