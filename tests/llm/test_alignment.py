"""Alignment of two tokenizers against the libraries and a plain walk over token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from featureline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a string, _key string, `a.b` string"


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, letters, sentencepiece.SentencePieceProcessor(model_file=B)


def links(library, text):
    """Ids of A and B, groups, and all linked pairs."""
    a, letters, sp = library
    if not text:
        return [], [], [], []
    x = a.encode(" " + text, add_special_tokens=False)
    ids_a, raw_a = x.ids, [bytes(letters[c] for c in t) for t in x.tokens]
    ids_b = sp.encode(text)
    raw_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in raw_a]).tolist(), np.cumsum([len(t) for t in raw_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return ids_a, ids_b, groups, [(s, t) for g, h in groups for s in g for t in h]


def expected(library, rows):
    found = {k: links(library, text) for k, text in rows}
    count = Counter(pair for *_, pairs in found.values() for pair in set(pairs))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = {}
    for k, (a, b, groups, pairs) in found.items():
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[k] = (len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs),
                  hashlib.sha256(said.encode()).hexdigest() if a else "")
    return out


def texts(seed: int, n: int = 150) -> list:
    rng = random.Random(seed)
    letters = list("abc  \n\t'sSdlrevtm019.,!?é中\x85​　\x1c²½\x00😀") + ["<|endoftext|>", "<s>", " the", "ing ", " \n ", " Hello", "<0x41>", "▁"]
    made = ["".join(rng.choice(letters[:-1] if rng.random() < 0.97 else letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "  ", "\n", "a▁b", "a" * 5000, "ab" * 3000 + " " * 70, "中文" * 900, "<|endoftext|>", "=-" * 400, *made, made[0], made[0]]


@pytest.mark.parametrize("seed,hot,kept,parts", [(1, 1 << 19, 200_000, 1), (2, 0, 200_000, 5), (3, 40, 30, 3)])
def test_equals_the_libraries(spark, library, seed, hot, kept, parts, monkeypatch):
    """With all pairs in the broadcast table, with none, and with some and a small memory of windows."""
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", kept)
    monkeypatch.setattr(alignment, "GATHERED", 50)
    given = list(enumerate(texts(seed)))
    rows = [(k, t, "clash", "x", "y") for k, t in given]
    out = alignment.align(spark.createDataFrame(rows, DOCS).repartition(parts), A, B, hot_pairs=hot)
    assert out.columns == ["doc_id", "_key", "a.b", *alignment.RESULT.names]
    found = {r[0]: tuple(r)[3:] for r in out.collect()}
    want = expected(library, given)
    assert len(found) == len(given)
    for k, t in given:
        assert found[k] == want[k], repr(t)
    assert want[4][0] and not want[5][0]  # a line end has tokens; a text with the model's own space mark has none


def test_repeated_and_null_ids_are_documents_of_their_own(spark, library):
    rows = [(None, "one two", "", "", ""), (None, "one three", "", "", ""), (7, "one two", "", "", ""), (7, "one two", "", "", "")]
    out = sorted((tuple(r)[3:] for r in alignment.align(spark.createDataFrame(rows, DOCS), A, B).collect()), key=str)
    assert out == sorted(expected(library, enumerate(r[1] for r in rows)).values(), key=str)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None, "", "", "")], DOCS), A, B).select("n_links", "groups_sha256").first() == (0, "")


def test_hash_collisions_of_windows_are_told_apart(library, monkeypatch):
    """With a hash that is always the same, windows are still compared id by id."""
    monkeypatch.setattr(alignment, "mixed", lambda x: x * np.uint64(0))
    monkeypatch.setattr(alignment, "_SEED", alignment._SEED * np.uint64(0))
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    given = [t or "" for t in texts(5, 40)]
    data = np.frombuffer("".join(given).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in given])])
    made = aligner.batch(data, offsets)
    want = expected(library, list(enumerate(given)))
    assert [(int(a), int(g), h) for a, g, h in zip(made["n_a"], made["n_groups"], made["groups_sha256"])] \
        == [(w[0], w[2], w[6]) for w in want.values()]
