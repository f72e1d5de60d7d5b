"""Decontamination, toxicity, and the pipeline."""

import hashlib
import os
import random
import time
import re

import pytest

import corpus_pipeline
from featureline.llm import decontaminate, toxicity
from featureline.llm.queries import learnable
from featureline.llm.toxicity import CharModel, Restorer, char_model, count_trigrams, toxicity_scores

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_hit string, score string, item_id int"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {x for x in got if x is not None}
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def bench_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"Word{k}" for k in range(40)] + ["é1", "ÄB", "42"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 9, 10, 11, 30]))) for k in range(15)] + [(20, None), (21, ""), (22, "..."), (None, text(12))]
    items += [(23, items[0][1]), (0, items[0][1])]
    rows = [(k, " ".join([text(rng.randint(0, 9)), rng.choice(items)[1] or "", text(5)])) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "..."), (53, "a" * 50_000), (54, rows[0][1])]
    return rows, items


@pytest.mark.parametrize("block_windows", [3, 1 << 20])
def test_contamination_equals_brute_force(spark, block_windows):
    rows, items = bench_case(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(frame(spark, rows), bench, block_windows=block_windows).collect()
    got = sorted((r.doc_id, r.n_words, [k for s, e in zip(r.hit_starts, r.hit_ends) for k in range(s, e)], r.item_ids) for r in out)
    assert got == sorted(brute_hits(rows, items, 10))
    assert all(r.n_items == len(r.item_ids) and r.n_hit == sum(e - s for s, e in zip(r.hit_starts, r.hit_ends)) for r in out)


def test_removal_of_spans_and_documents(spark):
    rows = [(1, "Before, one two three four FIVE six; after."), (2, "clean one two"), (3, None)]
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(frame(spark, rows), bench).collect()}
    assert cut == {1: "Before, ; after.", 2: "clean one two", 3: None}
    left = decontaminate.remove_documents(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3] and left.columns == frame(spark, rows).columns
    nothing = bench.limit(0)
    assert decontaminate.remove_documents(frame(spark, rows), nothing).count() == 3
    assert decontaminate.contamination(frame(spark, rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("block_windows", [3, 1 << 20])
def test_rows_that_share_an_id_stay_apart(spark, block_windows):
    rows, items = bench_case(2)
    rows = [(None if k % 5 == 0 else k % 7, t) for k, (_, t) in enumerate(rows)] + [(1, "clean"), (1, "clean"), (None, "clean"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, options = frame(spark, rows).repartition(3), {"block_windows": block_windows}
    out = decontaminate.contamination(docs, bench, **options).collect()
    got = [(r.doc_id, r.n_words, [k for s, e in zip(r.hit_starts, r.hit_ends) for k in range(s, e)], r.item_ids) for r in out]
    want = brute_hits(rows, items, 10)
    assert sorted(got, key=str) == sorted(want, key=str)
    left = decontaminate.remove_documents(docs, bench, **options)
    clean = [(i, t) for (i, t), (*_, hit, _) in zip(rows, want) if not hit]
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate.remove_spans(docs, bench, **options).collect()
    gone = [(i, len(words(t)) - len(hit)) for (i, t), (*_, hit, _) in zip(rows, want)]
    assert sorted(((r.doc_id, len(words(r.text))) for r in cut), key=str) == sorted(gone, key=str)


@pytest.fixture(scope="module")
def restorer(spark):
    text = "the idiot is a stupid moron and a loser but the clown was worthless trash so pathetic and disgusting scum " * 50
    return Restorer(char_model(frame(spark, [(1, text)])))


@pytest.mark.parametrize("seen, meant", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("$cum", "scum"),
    ("l0$er", "loser"), ("p4th3t1c", "pathetic"), ("cl*wn", "clown"), ("A plain line, 10.2.3.4!", "a plain line, 10.2.3.4!"), ("", "")])
def test_hidden_words_are_restored(restorer, seen, meant):
    assert restorer.text(seen) == meant


@pytest.mark.parametrize("seen, meant", [
    ("idio7", "idiot"), ("worthle55", "worthless"), ("trash and 4 wa5", "was"), ("s t u p ! d", "stupid"), ("p.@.t.h.e.t.!.c", "pathetic")])
def test_look_alikes_at_ends_and_in_spelt_words(restorer, seen, meant):
    assert meant.encode() in restorer.features(seen)
    assert {b"idiot", b"stupid"} <= toxicity.plain_words(restorer.text("an idiot! so (stupid)"))


def test_decoding_is_the_best_path(restorer):
    """Viterbi against all readings of the lattice."""
    log = restorer.model.log

    def score(reading):
        a = b = 0
        total = sum(cost for _, cost in reading)
        for k in [*toxicity._SYMBOL[list("".join(t for t, _ in reading).encode())], 0]:
            total += log[a, b, k]
            a, b = b, k
        return total

    for seen in ("1d!0t", "l00oser", "5|um", "w0r+h"):
        readings = [[]]
        for options in restorer.lattice(seen):
            readings = [r + [o] for r in readings for o in options]
        best = max(readings, key=score)
        assert restorer.restore(seen) == "".join(t for t, _ in best)


def test_trigrams_stop_at_texts(spark):
    import pyarrow as pa

    one = count_trigrams([pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "ab c"])], names=["text"])])
    want = [(0, 0, 1), (0, 1, 2), (1, 2, 0)] * 2 + [(0, 0, 3), (0, 3, 0)]
    n = toxicity.SYMBOLS
    got = {(k // n // n, k // n % n, k % n): int(one[k]) for k in one.nonzero()[0]}
    assert got == {g: want.count(g) for g in want}
    CharModel(one)


def test_scores_of_hidden_toxic_texts(spark):
    rng = random.Random(2)
    clean = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    bad, hidden = ["idiot", "moron", "loser"], ["1d10t", "m o r o n", "l0000ser"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = rng.choices(clean, k=30) + (rng.choices(bad if k % 8 else bad + hidden, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels += [(k, int(toxic))] if k % 5 else [(k, None)]
    rows += [(900 + k, f"wa wb {h} wc") for k, h in enumerate(hidden)] + [(950, None), (951, ""), (0, rows[0][1])]
    df, known = frame(spark, rows), spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int")
    out = toxicity_scores(df, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {k: int(k % 4 == 0) for k in range(400)} | {900: 1, 901: 1, 902: 1, 950: 0, 951: 0}
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= len(out) - 4
    assert all(r.predicted == 1 for r in out if r.doc_id in (900, 901, 902))
    assert toxicity_scores(df.limit(0), known, corpus=df).count() == 0
    one_class = toxicity_scores(df, known.where("toxic = 0")).collect()
    assert len({r.score for r in one_class}) == 1 and len({r.score for r in toxicity_scores(df, known.limit(0)).collect()}) == 1


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity_scores(docs, labels, learn=learnable()).join(labels, "doc_id").where(~learnable()).collect()
    assert len(scored) > 400 and sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.97


@needs_data
def test_pipeline_equals_brute_force(spark, folder):
    """Each stage on its own input; only the classifier's decisions are taken as they are."""
    def kept(k, docs):
        corpus_pipeline.STAGES[k][1](spark, docs, SF).write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    clean = kept(0, docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and gone and all(labels.get(i, 1) for i in gone)

    single = kept(1, clean)
    groups = {}
    for r in clean.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g)[1] for g in groups.values()) and single.columns == columns

    apart = kept(2, single)
    from test_duplicates import brute_classes
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(brute_classes(rows, 5, 80, 100).values()))

    pure = kept(3, apart)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in apart.collect()], items, 10)
    assert sorted(r.doc_id for r in pure.collect()) == sorted(i for i, _, hit, _ in hits if not hit) and pure.columns == columns

    texts = {r.doc_id: r.text for r in pure.collect()}
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_hidden_places_equal_a_search_from_every_look_alike():
    """Against walking back to the beginning of the piece from each place."""
    def plain(low):
        def piece(at):
            while at and (low[at - 1].isalpha() or low[at - 1] in toxicity.LOOKALIKES):
                at -= 1
            return at, toxicity._PIECE.match(low, at).end()

        found = [piece(m.start()) for m in toxicity._LOOKS.finditer(low)]
        return found, [piece(m.start()) for m in toxicity._RUNS.finditer(low) if m[1].isalpha()]

    rng = random.Random(12)
    for _ in range(3000):
        low = "".join(rng.choice("ab1@* .²é_7") for _ in range(rng.randint(0, 25)))
        looks, runs = plain(low)
        assert list(toxicity._pieces(low, (m.start() for m in toxicity._LOOKS.finditer(low)))) == looks, low
        assert list(toxicity._pieces(low, (m.start() for m in toxicity._RUNS.finditer(low) if m[1].isalpha()))) == runs, low


@pytest.mark.parametrize("unit", ["a1", "0f3c9b", "a1²", "aaab4"])
def test_long_tokens_take_time_in_proportion(restorer, unit):
    def seconds(n):
        began = time.process_time()
        restorer.features(unit * (n // len(unit)))
        return time.process_time() - began

    seconds(2000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.02)


def test_copies_with_different_labels_score_alike_in_any_partitioning(spark):
    rng = random.Random(4)
    clean, bad = [f"w{c}" for c in "abcdefghij"], ["idiot", "moron"]
    rows = [(k, " ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=2) if k % 4 == 0 else []))) for k in range(160)]
    rows += [(200 + k, t) for k, t in rows[:40]]  # copies
    labels = [(k, int(k % 4 == 0)) for k in range(160)] + [(200 + k, int(k % 3 == 0)) for k in range(40)]
    got = []
    for parts in (1, 5, 9):
        scored = toxicity_scores(frame(spark, rows).repartition(parts), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts))
        got.append(sorted((r.doc_id, r.score) for r in scored.select("doc_id", "score").collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 200
