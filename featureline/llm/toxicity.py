"""Toxicity of texts that hide their words: restore them by a noisy-channel model, then score the restored words.

Channel. A writer means letters; what is seen may be a look-alike (``1d10t``), letters with spaces or marks between them
(``i d i o t``, ``i.d.i.o.t``) or letters repeated (``idiooot``). Every token that looks like this becomes a lattice: at
each place the letters that may be meant, each with its cost; a run of three or more may stand for one letter or two.
Viterbi decoding under a character trigram model finds the likeliest reading. The trigrams are counted over all
documents (each task sends its sums) on the bytes of their words, so the model has a fixed size.

Score. A logistic regression on which words, and beginnings of words, occur in the restored text. It is fitted on at
most ``sample`` labelled rows, those with the smallest hash of doc_id among the rows to learn from; their most telling
``FEATURES`` words and beginnings are its features.

Null and empty texts have no words and get the base score. Several labels of one document count as toxic if one is; null
labels are ignored. Copies of a text are fitted once, as toxic if one is marked so, and rows in the order of their hash, so scores
don't depend on the partitioning. Without rows of both classes all scores are equal. Empty tables
give empty ones. Other columns stay, but for those with names of results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import ROW, TEXT, columns_of, fields, held, others, parts, record, text_of, utf8, whole_rows
from featureline.session import work_dir

#: Symbols of the character model: a border, a-z, and the low six bits of other bytes.
SYMBOLS = 91
FEATURES = 512
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 20_000
#: Bytes of a word's beginning.
BEGINNING = 4
CACHE_ENTRIES = 200_000
RESULT = fields("score double, predicted int")
#: What each look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
_SAME, _MEANT, _GAP, _RUN = -0.01, -1.5, -0.7, -0.3
_LEET = re.escape("".join(LOOKALIKES))
_SIGN = rf"(?:[^\W_]|[{_LEET}])"
#: Where a hidden word may be: a look-alike beside a letter, three equal letters, single letters and look-alikes with gaps.
_LOOKS = re.compile(rf"[{_LEET}][^\W\d_]|[^\W\d_][{_LEET}]")
_RUNS = re.compile(r"(.)\1\1")
_SPACED = re.compile(rf"(?:^|[ .\-_\n]){_SIGN}[ .\-_]{_SIGN}(?=[ .\-_]{_SIGN})")
_SPELT = re.compile(rf"{_SIGN}(?:[ .\-_]{_SIGN})+(?![^\W_])")
_PIECE = re.compile(rf"(?:[^\W\d_]|[{_LEET}])+")
_SYMBOL = np.array([0 if b < 65 else 27 + b % 64 if b > 127 else max(0, (b | 32) - 96) if (b | 32) <= 122 else 0 for b in range(256)])
_BLANK = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _pieces(low: str, places: Iterable[int]) -> Iterator[tuple[int, int]]:
    """The pieces of letters and look-alikes around places that grow. Nothing is read twice, however many places a piece has."""
    last, start, end = -1, 0, 0
    for place in places:
        at = place
        while at > max(last, 0) and (low[at - 1].isalpha() or low[at - 1] in LOOKALIKES):
            at -= 1
        if last < 0 or at > last:  # else this place lies in the piece of the one before
            start = at
        # From anywhere inside a piece it goes on to the same end.
        end = end if start < end else _PIECE.match(low, start).end()
        last = place
        yield start, end


def hidden(low: str) -> list[tuple[int, int]]:
    """Places of a lower-cased text that may hide words, in order, apart from each other."""
    found, done = [], 0
    for m in _SPACED.finditer(low):
        start = m.start() + (m[0][0] in " .-_\n")
        if start < done or not (whole := _SPELT.match(low, start)):
            continue
        done = whole.end()  # long rows of single marks are read once
        if done - start >= 5 and any(c.isalpha() for c in whole[0]):
            found.append((start, done))
    found += _pieces(low, (m.start() for m in _LOOKS.finditer(low)))
    found += _pieces(low, (m.start() for m in _RUNS.finditer(low) if m[1].isalpha()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def plain_words(low: str) -> set[bytes]:
    return set(low.encode("utf-8", "replace").translate(_BLANK).split())


@lru_cache(maxsize=4096)
def _symbols(meant: str) -> tuple[int, ...]:
    return tuple(_SYMBOL[list(meant.encode("utf-8", "replace"))].tolist()) if meant else ()


class CharModel:
    """Log-probabilities of a symbol after two others; symbol 0 is the border of a word."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape((SYMBOLS,) * 3).astype(np.float64)
        one = counts.sum((0, 1)) + 0.5
        one /= one.sum()
        two = counts.sum(0) + 2 * one
        two /= two.sum(1, keepdims=True)
        three = counts + 2 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


class Restorer:
    """Viterbi decoding of hidden words."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def lattice(self, seen: str) -> list[list[tuple[str, float]]]:
        """For each place what may be meant, with its log-probability; an empty text means nothing was."""
        out, at = [], 0
        spaced = re.fullmatch(rf"(?:{_SIGN}[ .\-_])+{_SIGN}", seen) is not None
        while at < len(seen):
            c, end = seen[at], at + 1
            while end < len(seen) and seen[end] == c:
                end += 1
            run = end - at
            if c.isalpha():
                out += [[(c, _RUN), (c + c, 2 * _RUN)]] if run >= 3 else [[(c, _SAME)]] * run
            elif c in LOOKALIKES:
                one = [(m, _MEANT) for m in LOOKALIKES[c]] + ([("", _MEANT + _GAP)] if c in "!|*+(" else [])
                out += [[(k * m, cost + k * _RUN) for m, cost in one for k in (1, 2)]] if run >= 3 else [one] * run
            elif spaced:
                out.append([("", _GAP)])
            at += run
        return out

    def restore(self, seen: str) -> str:
        if (word := self.known.get(seen)) is not None:
            return word
        log = self.model.log
        paths, back = {(0, 0): 0.0}, []  # at each place of the text, from which pair of symbols the best path comes and what it means
        for options in self.lattice(seen):
            step: dict = {}
            came: dict = {}
            for (a, b), score in paths.items():
                for meant, cost in options:
                    p, q, s = a, b, score + cost
                    for k in _symbols(meant):
                        s += log[p, q, k]
                        p, q = q, k
                    if (p, q) not in step or step[p, q] < s:
                        step[p, q], came[p, q] = s, (a, b, meant)
            paths = step
            back.append(came)

        def told(pair: tuple[int, int]) -> str:
            out = []
            for came in reversed(back):
                *pair, meant = came[tuple(pair)]
                out.append(meant)
            return "".join(reversed(out))

        best = {pair: s + log[*pair, 0] for pair, s in paths.items()}
        most = max(best.values())
        word = max(told(pair) for pair, s in best.items() if s == most)
        if len(seen) <= 64:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[seen] = word
        return word

    def text(self, text: str) -> str:
        """The text, lower-cased, with its hidden words restored."""
        low, out, at = text.lower(), [], 0
        for a, b in hidden(low):
            out += [low[at:a], self.restore(low[a:b])]
            at = b
        return "".join([*out, low[at:]])

    def features(self, text: str) -> set[bytes]:
        """The words as they stand and the restored ones, and the beginnings of all (with a star)."""
        low = text.lower()
        words = plain_words(low)
        for a, b in hidden(low):
            words |= plain_words(self.restore(low[a:b]))
        return words | {w[:BEGINNING] + b"*" for w in words if len(w) > BEGINNING}



def count_trigrams(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often each symbol follows two others inside words."""
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in parts(offsets):
            block = _SYMBOL[data[offsets[a]:offsets[b]]]
            # A border after each text, and two before the first.
            line = np.concatenate([[0, 0], np.insert(block, offsets[a + 1:b + 1] - offsets[a], 0)])
            first, middle, last = line[:-2], line[1:-1], line[2:]
            used = (middle > 0) | (last > 0)
            first = np.where(middle > 0, first, 0)
            counts += np.bincount(((first * SYMBOLS + middle) * SYMBOLS + last)[used], minlength=SYMBOLS ** 3)
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = count_trigrams(batches)
    grams = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts[grams])], names=["gram", "n"])


def char_model(docs: DataFrame, text: str = "text") -> CharModel:
    """The trigram model of all documents' words; ``SYMBOLS ** 3`` numbers at most come to the driver."""
    grams = docs.select(F.col(text).cast("string")).mapInArrow(_count, T.StructType(fields("gram long, n long"))) \
        .groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    counts[grams["gram"].to_numpy()] = grams["n"].to_numpy()
    return CharModel(counts)


def _fit(rows: list[tuple[list[int], int]], n: int, l2: float = 0.1, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a regularised logistic regression, by Newton steps."""
    x = np.zeros((len(rows), n + 1), np.float32)
    x[:, n] = 1
    for k, (features, _) in enumerate(rows):
        x[k, features] = 1
    y = np.array([label for _, label in rows], np.float32)
    w, penalty = np.zeros(n + 1), np.full(n + 1, l2)
    penalty[n] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:n], float(w[n])


def _train(docs: DataFrame, labels: DataFrame, model, id: str, text: str, label: str, learn, sample: int) -> tuple[dict[str, float], float]:
    """Weight of each telling word, and the intercept."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).where(learn).groupBy(F.col(id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("__featureline_text")).join(F.broadcast(known), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(model)
        for batch in batches:
            words = [sorted(w.decode("utf-8", "replace") for w in restorer.features(t or "")) for t in batch.column("__featureline_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), batch.column("_hash"),
                                              pa.array(words, pa.list_(pa.string()))], names=["_id", "_label", "_hash", "words"])

    schema = T.StructType([T.StructField("_id", chosen.schema["_id"].dataType), *fields("_label int, _hash long"),
                           T.StructField("words", T.ArrayType(T.StringType()))])
    path = work_dir(spark, "toxicity")
    # Of equal texts one is learnt from, as toxic if any of them is marked so.
    chosen.withColumn("_hash", F.xxhash64("__featureline_text")).mapInArrow(run, schema).groupBy("_hash").agg(
        F.max("_label").alias("_label"), F.min("_id").alias("_id"), F.max("words").alias("words")).write.parquet(path)
    rows = spark.read.parquet(path)
    n0, n1 = (int(x or 0) for x in rows.agg(F.sum(1 - F.col("_label")), F.sum("_label")).first())
    if not n0 or not n1:
        return {}, float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else -2.0
    found = rows.select("_label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("_label").alias("a"), F.sum(1 - F.col("_label")).alias("b")).where(F.col("a") + F.col("b") >= max(3, n1 // 100))
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi = F.pow(a * d - b * c, F.lit(2.0)) / ((a + b).cast("double") * (c + d + 1))
    features = [r.word for r in found.orderBy(F.desc(chi), "word").limit(FEATURES).select("word").collect()]
    named = F.array(*map(F.lit, features)) if features else F.array().cast("array<string>")
    kept = rows.select(F.array_intersect("words", named).alias("words"), "_label").orderBy("_hash").collect()  # ``sample`` rows at most
    place = {w: k for k, w in enumerate(features)}
    weights, intercept = _fit([([place[w] for w in r.words], r["_label"]) for r in kept], len(features))
    return {w: float(weights[k]) for w, k in place.items()}, intercept


def _restorer(shared) -> Restorer:
    model = shared.value
    return held(("restorer", id(model)), lambda: Restorer(model))  # it holds the model, so no other one gets this id


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, corpus: DataFrame | None = None, id: str = "doc_id", text: str = "text",
                    label: str = "toxic", learn=None, sample: int = SAMPLE) -> DataFrame:
    """Adds score and predicted to every row; ``text`` stays behind.

    ``corpus`` is what the character model is counted on and the labelled texts are taken from (by default the documents themselves); ``learn`` is a
    condition on label rows: which of them may be learnt from.
    """
    corpus = docs if corpus is None else corpus
    model = docs.sparkSession.sparkContext.broadcast(char_model(corpus, text))
    learn = F.lit(True) if learn is None else learn
    weights, intercept = _train(corpus, labels, model, id, text, label, learn, sample)
    kept = others(docs, text, *(f.name for f in RESULT))
    schema = T.StructType([docs.schema[c] for c in kept] + RESULT)
    weights = {w.encode(): x for w, x in weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, telling = _restorer(model), frozenset(weights)
        for batch in batches:
            total = [intercept + sum(map(weights.__getitem__, sorted(telling & restorer.features(t.as_py() or ""))))
                     for t in text_of(batch)]
            score = 1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30)))
            yield record(schema, {c: batch.column(c) for c in kept} | {
                "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    bare = docs.select(*kept) if ROW in kept else docs.select(*kept, F.col(text).cast("string").alias(TEXT))
    return bare.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not predicted to be toxic; all columns stay."""
    scored = toxicity_scores(whole_rows(docs, id, text), labels, corpus=docs, id=id, text=text, **options)
    return scored.where("predicted = 0").select(*columns_of(docs, text))
