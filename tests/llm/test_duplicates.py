"""Exact copies, near copies, and repeated passages, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from featureline.llm import bwt_dedup, exact_dedup, ngram_join, substring_dedup
from featureline.llm.ngram_join import SKETCH_BITS, components, least_overlap, ngram_classes, one_of_each, prefix_of
from featureline.llm.repeats import Kind, anchors
from featureline.llm.substring_dedup import Automaton
from featureline.session import work_dir

DOCS = "doc_id long, text string, kept string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def blank_free(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def some_docs(seed):
    rng = random.Random(seed)
    base = ["alpha beta", "alpha  beta\n", "alphabeta", None, "", " \n", "é é", "éé", "x" * 9000, "the long text " * 30]
    rows = [(k, rng.choice(base)) for k in range(120)] + [(200 + k, f"own {k}") for k in range(40)]
    rows += [(300, "alpha beta")] * 3 + [(301, "one"), (301, "two"), (302, "one"), (None, "alphabeta"), (None, "alone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket_bytes", [1, 200, 64 << 20])
def test_exact_groups(spark, bucket_bytes):
    rows = some_docs(1)
    out = exact_dedup.exact_groups(frame(spark, rows), bucket_bytes=bucket_bytes).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(blank_free(t), []).append((-len(t or ""), i is None, i))
    want = sorted((str(i), str(min(groups[n])[2]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                  for i, t in rows for n in [blank_free(t)])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_directory_splits_overfull_buckets(spark):
    rows = [(k, f"text number {k} " * 20) for k in range(400)] + [(1000 + k, "one big copy " * 200) for k in range(50)]
    index = exact_dedup.build_index(frame(spark, rows), bucket_bytes=20_000)
    assert len(index.depths) >= 8 and len(index.depths) == 1 << int(index.depths.max())
    sizes = {r[0]: r[1] for r in spark.read.parquet(index.buckets).groupBy("bucket").count().collect()}
    assert len(sizes) >= 4
    full = spark.read.parquet(index.buckets).selectExpr("bucket", "octet_length(body) AS b").groupBy("bucket").sum("b").collect()
    assert all(r[1] <= 20_000 for r in full)


def test_remove_copies_keeps_one_of_each(spark):
    rows = some_docs(2)
    out = exact_dedup.remove_copies(frame(spark, rows))
    left = [blank_free(r.text) for r in out.collect()]
    assert sorted(left) == sorted({blank_free(t) for _, t in rows})
    assert out.columns == ["doc_id", "text", "kept", "id"]
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute_classes(rows, size, a, b):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and b * len(x & y) >= a * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, n = [], 0
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 5, 12, 40, 80]))
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(own).swapcase() if rng.random() < 0.3 else " ".join(own)))
            n += 1
    common = " ".join(vocabulary[:20])
    rows += [(n + k, f"{common} {' '.join(rng.choices(vocabulary, k=8))}") for k in range(25)]
    rows += [(900, None), (901, ""), (902, " "), (903, "w1"), (904, "W1"), (None, rows[0][1]), (905, rows[0][1]), (905, rows[0][1]),
             (906, rows[30][1]), (906, rows[50][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, size, share", [(1, 4, (85, 100)), (2, 4, (50, 100)), (3, 2, (80, 100)), (4, 5, (80, 100))])
def test_classes_equal_brute_force(spark, seed, size, share):
    rows = near_copies(seed)
    out = ngram_classes(frame(spark, rows), size=size, share=share).collect()
    want = brute_classes(rows, size, *share)
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert got == want
    assert sorted((str(r.doc_id), r.n_shingles) for r in out) == sorted((str(i), len(shingles(t, size))) for i, t in rows)


def test_dealt_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPREAD", 2)
    rows = near_copies(6)
    got = {r.doc_id: r.component_id for r in ngram_classes(frame(spark, rows)).collect() if r.doc_id is not None}
    assert got == brute_classes(rows, 4, 85, 100)


def edited(n, seed=8):
    """Copies of one text of 200 words, each with 0 to 9 words of its own."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(200), rng.randint(0, 9)):
            own[k] = f"own{i}-{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_pairs_of_a_group_of_near_copies_grow_in_proportion(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "work_dir", lambda *a: made.append(work_dir(*a)) or made[-1])
    for n in (300, 1200):
        rows = edited(n)
        got = {r.doc_id: r.component_id for r in ngram_classes(frame(spark, rows)).collect()}
        if n == 300:
            assert got == brute_classes(rows, 4, 85, 100)
    pairs = [sum(spark.read.parquet(f"{f}/{p}-pairs").count() for p in ("stars", "others")) for f in made]
    assert pairs[1] <= 5 * max(pairs[0], 300)


def test_counts_are_exact_across_flushes_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_FLUSH", 50)
    rows = [(k, f"the very same words and own{k} ones besides{k}") for k in range(40)]
    described = frame(spark, rows).selectExpr("doc_id AS id", "text").repartition(3).mapInArrow(ngram_join._describe(4), ngram_join._DOCS)
    levels = ngram_join._levels(described)
    assert len(levels) == 1 << SKETCH_BITS
    # Two shingles are in all 40 texts: twice the logarithm of 40, rounded down. All others are in one.
    assert sorted(levels[levels > 0].tolist()) == [10, 10]
    assert not ngram_join._levels(described.limit(0)).any()


def test_one_of_each_and_empty(spark):
    rows = near_copies(5)
    left = one_of_each(frame(spark, rows))
    want = brute_classes(rows, 5, 80, 100)
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == set(want.values())
    assert left.columns == ["doc_id", "text", "kept", "id"]
    assert ngram_classes(frame(spark, []) if False else frame(spark, rows).limit(0)).count() == 0


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 8, 1 << SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = x.copy()
        for _ in range(int(rng.integers(0, 6))):
            y[rng.integers(len(y))] = rng.integers(0, 1 << 63)
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        (p, a, _), (q, b, _) = prefix_of(x, levels, (85, 100)), prefix_of(y, levels, (85, 100))
        assert len(np.intersect1d(a, b)) >= min(p, q)
        assert len(a) == len(x) - least_overlap(len(x)) + p


def test_components_of_a_chain(spark):
    chain = list(range(100, 160))
    random.Random(1).shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(7, 8), (8, 7), (9, 9)]
    out = components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "chain"))
    assert {r.id: r.component for r in out.collect() if r.id != r.component} == {**{k: 100 for k in range(101, 160)}, 8: 7}


def passages(seed, word):
    rng = random.Random(seed)
    make = (lambda n: " ".join(rng.choice(word) for _ in range(n)))
    shared = [make(n) for n in (5, 14, 20, 60, 90)]
    rows = []
    for k in range(60):
        pieces = [make(rng.randint(0, 25)) for _ in range(3)]
        for at in rng.sample(range(3), rng.randint(0, 3)):
            pieces[at] += rng.choice([" ", "\n", "  "]) + rng.choice(shared)
        rows.append((k, " ".join(pieces)))
    rows += [(70 + k, rows[k][1]) for k in range(6)] + [(90, shared[4] + " " + shared[4]), (91, None), (92, ""), (93, "é" * 80), (94, "é" * 70)]
    rows += [(95, shared[3]), (95, shared[3]), (96, shared[3]), (96, "other " + shared[2] * 2), (None, shared[4])]
    rng.shuffle(rows)
    return rows


def brute_repeats(rows, split, window):
    """For every row: its symbols, and which of them go."""
    first = {}
    for i, t in rows:
        s = split(t or "")
        for k in range(len(s) - window + 1):
            key = tuple(s[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        s = split(t or "")
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if i is not None and first[tuple(s[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, s, gone))
    return out


@pytest.mark.parametrize("seed, words", [(1, 400), (2, 6), (3, 2)])
def test_repeated_words(spark, seed, words):
    rows = passages(seed, [f"v{k}" for k in range(words)])
    out = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    want = sorted((str(i), len(s), sum(g), " ".join(w for w, x in zip(s, g) if not x))
                  for i, s, g in brute_repeats(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 13))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in out)


@pytest.mark.parametrize("seed, words", [(4, 300), (5, 5)])
def test_repeated_bytes(spark, seed, words):
    rows = passages(seed, [f"v{k}" for k in range(words)])
    out = bwt_dedup.remove_repeats(frame(spark, rows)).collect()
    want = []
    for i, s, g in brute_repeats(rows, lambda t: t.encode(), 50):
        runs = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        want.append((str(i), len(s), sum(g), runs, bytes(b for b, x in zip(s, g) if not x)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(want)


def half_alike(kind, unit):
    """Two texts around one anchor whose contexts differ and have hashes that agree in the upper 32 bits."""
    rng = np.random.default_rng(1)

    def texts(n, symbols):
        out = rng.integers(97, 123, (n, symbols * unit), np.uint8)
        if unit > 1:
            out[:, unit - 1::unit] = 32
        return out

    def found(block):
        return anchors(*kind.symbols(block.ravel(), np.arange(len(block) + 1) * block.shape[1]), kind)

    # A gram of a small hash is the only anchor of a text that it stands in the middle of.
    grams = texts(20_000, kind.window)
    place, anchor, _ = found(grams)
    least = place[np.argmin(anchor)]
    gram = grams.ravel()[least * unit:(least + kind.gram) * unit]
    held, upper = [], []
    for _ in range(20):
        block = texts(40_000, 2 * kind.reach + kind.gram)
        block[:, kind.reach * unit:(kind.reach + kind.gram) * unit] = gram
        place, anchor, context = found(block)
        mine = place % (2 * kind.reach + kind.gram) == kind.reach
        held.append(block[place[mine] // (2 * kind.reach + kind.gram)])
        upper.append(context[mine] >> np.uint64(32))
        every = np.concatenate(upper)
        order = np.argsort(every, kind="stable")
        same = np.flatnonzero(every[order][1:] == every[order][:-1])
        if len(same):
            blocks = np.concatenate(held)
            return [blocks[order[same[0] + k]].tobytes().decode() for k in (0, 1)]
    raise AssertionError("no such texts")


@pytest.mark.parametrize("operator, words, unit", [(substring_dedup, True, 4), (bwt_dedup, False, 1)])
def test_contexts_are_told_apart_by_all_bits(spark, operator, words, unit):
    x, y = half_alike(Kind(words, operator.WINDOW, operator.GRAM), unit)
    out = operator.remove_repeats(frame(spark, [(1, x), (2, y), (3, x)])).collect()
    assert x != y and {r.doc_id: r.n_removed > 0 for r in out} == {1: False, 2: False, 3: True}


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert bwt_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("shards", [2, 3, 5])
def test_merged_transforms_and_automaton_find_the_same(monkeypatch, shards):
    monkeypatch.setattr(bwt_dedup, "SHARDS", shards)
    rng = random.Random(shards)
    for window, letters in ((5, b"ab"), (9, b"abc\x00\xff"), (50, b"ab")):
        pool = [bytes(rng.choices(letters, k=rng.randint(3, 80))) for _ in range(4)]
        texts = sorted(((rng.randint(0, 8), b"".join(rng.choices(pool, k=rng.randint(1, 3)))) for _ in range(25)), key=lambda x: x[0])
        first = {}
        for d, t in texts:
            for k in range(len(t) - window + 1):
                first.setdefault(t[k:k + window], d)
        want = sorted((j, k) for j, (d, t) in enumerate(texts) for k in range(len(t) - window + 1) if first[t[k:k + window]] < d)
        assert sorted(bwt_dedup.block_repeats(texts, window)) == want
        automaton = Automaton()
        for d, t in texts:
            automaton.add(list(t), d)
        assert sorted((j, k) for j, (d, t) in enumerate(texts) for k, f in automaton.matches(list(t), window) if f < d) == want


def test_a_worker_keeps_nothing_of_other_operators_while_shingles_are_counted():
    """Workers live through the stages of a pipeline; what a stage kept for its tasks would stay beside the next one's rows."""
    import pyarrow as pa
    from featureline.llm import bpe, frames, toxicity

    restorer = toxicity.Restorer(toxicity.CharModel(np.ones(toxicity.SYMBOLS ** 3)))
    assert frames.held("a", lambda: restorer) is frames.held("a", lambda: None)
    assert frames.held("b", lambda: "other") == "other" and "a" not in frames._held
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e", None])], names=["id", "text"])
    described, counted = ngram_join._describe(4)(iter([batch]))
    assert not frames._held and described.column("n").to_pylist() == [2, 0] and len(counted) == 2
    assert not hasattr(bpe._loaded, "cache_info") and not hasattr(toxicity, "_restorers")


def test_shingles_are_sent_on_before_they_fill_a_worker():
    import pyarrow as pa

    texts = [" ".join(f"{k}x{j}" for j in range(70_000)) for k in range(16)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array(texts)], names=["id", "text"])
    counts = [b for b in ngram_join._describe(4)(iter([batch])) if b.column("chunk").null_count == 0]
    each = [sum(len(t.as_py()) // 4 for t in b.column("times")) for b in counts]
    assert sum(each) == pytest.approx(16 * 69_997, abs=50) and max(each) < 600_000
