"""Phrase mining against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featureline.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows: list, threshold: int, top: int) -> list:
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            name = "und" if lang is None else lang
            n[name] += len(words)
            for m in range(1, 6):
                f.update((name, tuple(words[k:k + m])) for k in range(len(words) - m + 1))
    f = {k: a for k, a in f.items() if a >= threshold}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        around = max((f.get((lang, q), 0) for (g, q) in f if g == lang and len(q) > len(p)
                      and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))), default=0)
        if around < a:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def given(seed: int) -> list:
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "of the", "New York city", "é", "中", "x\0y", "long" * 40, "in the end of it", "(", "\x1c"]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", ":", "\x0b"]) for _ in range(rng.randint(0, 40)))
            for _ in range(120)]
    made += ["w1 w2 w3 w4 w5 w6 " * 30, None, "", " ", ".", "A-b " * 300, made[0], made[0]]
    return [(k % 50, t, rng.choice(["en", "de", None, "und", ""]) if k < 120 else "en", "clash", "x") for k, t in enumerate(made)]


@pytest.mark.parametrize("shards,bits,threshold,parts", [(1, 24, 9, 1), (3, 24, 5, 5), (4, 4, 6, 2), (5, 10, 12, 7), (2, 1, 4, 3)])
def test_equals_counting_by_hand(spark, shards, bits, threshold, parts, monkeypatch):
    """Also with tables so small that nearly every slot is taken, and with late phrases, which need several cycles."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 700)
    rows = given(shards)
    out = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(parts), threshold=threshold, top=25, shards=shards, table_bits=bits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == by_hand(rows, threshold, 25)


@pytest.mark.parametrize("shards,bits,threshold,seed", [(3, 5, 3, 0), (4, 6, 5, 5)])
def test_slots_shared_with_older_phrases_lose_no_count(spark, shards, bits, threshold, seed):
    """Words that become frequent late, inside phrases whose slots were taken before."""
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice([f"w{j}" for j in range(rng.randint(1, 10))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de"]), "", "")
            for k in range(60)]
    out = phrases.collocations(spark.createDataFrame(rows, DOCS).coalesce(1), threshold=threshold, shards=shards, table_bits=bits)
    assert sorted(map(tuple, out.collect())) == by_hand(rows, threshold, 2000)


def test_a_phrase_begins_no_earlier_than_its_words():
    table = np.full(1 << 24, phrases.NEVER, np.uint8)
    word = phrases._hashes(pa.array([b"p", b"q", b"r"]))
    first = phrases._first_words(word, np.repeat(phrases._hashes(pa.array([b"en"])), 3))
    table[first >> np.uint64(40)] = 2
    table[phrases._longer(first[:2], word[1:]) >> np.uint64(40)] = 1  # by other phrases of the same hash
    batches = phrases.counted(pa.array(["en"]), pa.array(["p q r"]), table, 2, 4)
    found = {r["phrase"]: r["began"] for b in batches for r in b.to_pylist() if r["size"] > 1}
    assert found == {"p q": 2, "q r": 2, "p q r": 2}


def test_a_phrase_of_the_last_shard_is_found(spark):
    """Everything frequent lies in the shard scanned last, so each length takes a cycle more."""
    rows = [(k, "p q r s t" if k % 4 == 3 else f"u{k}", "en", "", "") for k in range(400)]
    out = phrases.collocations(spark.createDataFrame(rows, DOCS).coalesce(1), threshold=60, shards=4).collect()
    assert [(r.phrase, r.a, r.n) for r in out] == [("p q r s t", 100, 800)]


def test_large_numbers_stay_exact(spark):
    big = 3 * 10 ** 12
    got = spark.range(1).select(F.expr(f"cast({big} as decimal(19,0)) * cast({7 * big} as decimal(19,0)) * 1000 div "
                                       f"(cast({big + 1} as decimal(19,0)) * cast({big + 7} as decimal(19,0)))").alias("x")).first().x
    assert got == 1000 * big * 7 * big // ((big + 1) * (big + 7))


def test_empty_tables_and_long_texts(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", ""), (2, " . ", "en", "", "")], DOCS), threshold=1).count() == 0
    rows = [(1, "the end " * 50_000 + "x" * 100_000, "en", "", "")]
    out = phrases.collocations(spark.createDataFrame(rows, DOCS), threshold=100, shards=2).collect()
    assert sorted(map(tuple, out)) == by_hand(rows, 100, 2000)
