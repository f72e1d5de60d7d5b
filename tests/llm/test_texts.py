"""BPE, token counts, sharding, chat formatting."""

import cProfile
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featureline.llm import bpe as bpe_module
from featureline.llm.bpe import ByteBPE, decode_documents, encode_documents
from featureline.llm.chat import Template, escaped, format_conversations, read_back, unescaped
from featureline.llm.sharding import feistel_shards, permuted
from featureline.llm.token_counts import count_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_tokens string, _text string"


def texts(seed: int, n: int = 150) -> list:
    rng = random.Random(seed)
    letters = list("abc  \n\t'sSdlrevtm019.,!?é中\x85​　\x1c²½\x00▁") + ["<|endoftext|>", "<s>", " the", "ing ", " \n "]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "  ", "a" * 5000, "ab" * 3000 + " " * 70, "<|endoftext|>", "=-" * 400, *made, made[0], made[0]]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BPE)
    given = texts(1)
    rows = [(k, t, "clash", "x") for k, t in enumerate(given)]
    out = {r.doc_id: r for r in encode_documents(spark.createDataFrame(rows, DOCS), BPE).collect()}
    assert len(out) == len(given)
    for k, t in enumerate(given):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert (bytes(out[k].ids), out[k].n_tokens, out[k]._text) == (raw, len(ids), "x"), repr(t)
        assert out[k].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_round_trip_and_empty_table(spark):
    rows = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts(2))], DOCS)
    back = decode_documents(encode_documents(rows, BPE), BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts(2))}
    empty = encode_documents(spark.createDataFrame([], DOCS), BPE)
    assert empty.count() == 0 and "ids" in empty.columns


def test_new_words_are_encoded_together():
    """Steps of Python for each word that a worker did not know were most of the encoder's time."""
    rng = random.Random(5)
    with open(BPE, encoding="utf-8") as f:
        bpe = ByteBPE(f.read())
    words = ["".join(rng.choice(["th", "er", "on", "a", "e", "s", "é", "ß", "中", "_"]) for _ in range(rng.randint(4, 12))) for _ in range(20_000)]
    given = [" ".join(words[k:k + 500]) for k in range(0, len(words), 500)]
    profile = cProfile.Profile()
    got = profile.runcall(bpe.encode, given)
    calls = sum(entry.callcount for entry in profile.getstats())
    assert calls < 10 * len(words)
    library = Tokenizer.from_file(BPE)
    assert got == [b"".join(i.to_bytes(4, "little") for i in library.encode(t).ids) for t in given]


def test_words_encoded_together_are_those_encoded_alone(monkeypatch):
    rng = random.Random(6)
    with open(BPE, encoding="utf-8") as f:
        bpe = ByteBPE(f.read())
    some = [t for t in bpe.tokens if len(t) > 1]
    words = [bytes(rng.choice(b"-=_* \x00\xff\n") for _ in range(rng.randint(1, 128))) for _ in range(500)]
    words += [b"".join(rng.choice(some)[-rng.randint(1, 6):] for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    alone = [b"".join(bpe.id_bytes[t] for t in bpe.encode_word(w)) for w in words]
    assert bpe._together(words) == alone
    bpe._pair_slots = np.full(1 << 20, -1, np.int64)
    assert [x for w in words[:40] for x in bpe._together([w])] == alone[:40]
    monkeypatch.setattr(bpe_module, "PAIR_BITS", 3)  # pairs that take each other's slots
    bpe._pair_slots = np.full(8, -1, np.int64)
    assert bpe._together(words) == alone


def test_a_worker_keeps_a_bounded_number_of_pieces(monkeypatch):
    with open(BPE, encoding="utf-8") as f:
        bpe = ByteBPE(f.read())
    monkeypatch.setattr(bpe_module, "CACHE_ENTRIES", 50)
    library = Tokenizer.from_file(BPE)
    for k in range(6):
        given = [f"often {k}x{j} <|endoftext|>" + "y" * 70 + str(j) for j in range(12 * (k + 1))] + ["z" * 300, "", " "]
        assert bpe.encode(given) == [b"".join(i.to_bytes(4, "little") for i in library.encode(t).ids) for t in given]
        assert len(bpe._chunks) <= 50 and all(len(c) <= 64 for c in bpe._chunks)


@pytest.mark.parametrize("table_entries", [0, 40])
def test_token_counts_equal_the_library(spark, table_entries):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = texts(3)
    rows = spark.createDataFrame([(k, t, "clash", "x") for k, t in enumerate(given)], DOCS)
    out = count_tokens(rows, PIECES, table_entries=table_entries).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r._text) for r in out} == {
        k: (len((t or "").encode()), len(library.encode(t or "")), "x") for k, t in enumerate(given)}
    assert count_tokens(spark.createDataFrame([], DOCS), PIECES).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 10_007])
def test_permutation_is_one(spark, n):
    places = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 7)).collect()]
    assert sorted(places) == list(range(n))
    if n > 100:
        assert sum(a == b for a, b in enumerate(places)) < n / 10
        other = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 8)).collect()]
        assert places != other


def test_shards_follow_the_law(spark):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else rng.randint(0, 60), rng.choice([None, "", "é", "x" * 300]), "s", "p") for _ in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _p string")
    out = feistel_shards(df, 7).collect()
    again = feistel_shards(df.repartition(5), 7).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r._p == "p"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 500
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    assert feistel_shards(df.limit(0), 7).count() == 0


TURNS = "conv_id long, turn long, role string, text string, segments int"


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "é", "ok", "assistant\n", "<|im_end|>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb\\n<|x"]), rng.choice([None, "", "".join(rng.choices(bits, k=8))]), 1)
            for c in range(30) for t in range(rng.randint(1, 9))]
    rows += rows[:3] + [(None, None, "user", "hi", 1)]
    done = format_conversations(spark.createDataFrame(rows, TURNS))
    assert all("".join(s.text for s in r.segments) == r.formatted for r in done.collect())
    out = {r.conv_id: r for r in read_back(done).collect()}
    assert len(out) == 31
    for conv, got in out.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv), key=lambda x: (x[0] is not None, x))
        assert [(t.role, t.text) for t in got.turns] == [x[1:] for x in turns]
        assert got.loss_text == "".join(x[2] for x in turns if x[1] == "assistant")
    assert format_conversations(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("roles, valid", [
    (["user", "assistant"], True), (["system", "user", "assistant", "user"], True), (["assistant"], False), (["user", "user"], False),
    (["system"], False), (["user", "tool"], False), (["user", "assistant", "system"], False)])
def test_chat_turn_order(spark, roles, valid):
    rows = spark.createDataFrame([(1, k, r, "x", 0) for k, r in enumerate(roles)], TURNS)
    assert format_conversations(rows, Template()).first().valid is valid


def test_escaping_leaves_no_mark(spark):
    given = ["<|a", "<\\|a", "<\\\\|", "<<||", "plain <b> |"]
    out = spark.createDataFrame([(g,) for g in given], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u"))
    assert all("<|" not in r.e and r.u == r.t for r in out.collect())


def test_shards_equal_a_plain_feistel_order_and_keep_any_column(spark):
    """Maps, columns named like results of the numbering, and dots; null keys come first."""
    schema = "doc_id long, text string, row_no string, m map<string,int>, `a.b` string, s struct<m:map<string,int>>"
    rows = [(k, f"t{k}", f"r{k}", {"x": k}, "d", ({"y": k},)) for k in range(30)] + [(None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = feistel_shards(df, 5).collect()
    assert feistel_shards(df, 5).columns == ["doc_id", "row_no", "m", "a.b", "s", "size", "text_crc32", "shard", "slot"]
    assert {r.doc_id: (r.row_no, r.m, r["a.b"]) for r in out if r.doc_id is not None} == {k: (f"r{k}", {"x": k}, "d") for k in range(30)}
    assert sorted((r.shard, r.slot) for r in out) == sorted((p % 5, p // 5) for p in range(32))
    place = {r.n: r.p for r in spark.range(32).select(F.col("id").alias("n"), permuted(F.col("id"), 32, 0).alias("p")).collect()}
    for r in out:
        if r.doc_id is not None:  # rows 0 and 1 are those without a key
            assert (r.shard, r.slot) == (place[r.doc_id + 2] % 5, place[r.doc_id + 2] // 5)
