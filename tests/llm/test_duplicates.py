"""Suffix sorting, repeated strings, near duplicates, components, the pipeline."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.llm import induced
from phasewise.llm import op4_suffix_dedup as op4
from phasewise.llm import op8_minhash as op8
from phasewise.llm import queries
from phasewise.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_equal_sorting(seed):
    own = np.random.default_rng(seed)
    for trial in range(60):
        n, sigma = int(own.integers(0, 70)), int(own.integers(1, 6))
        text = own.integers(0, sigma, n).astype(np.uint8 if trial % 2 else np.int64)
        if trial % 5 == 0:
            text = np.tile(text[:7], 9)
        values = text.tolist()
        array, shared = induced.suffixes(text, 12)
        assert array.tolist() == sorted(range(len(values)), key=lambda k: values[k:])
        for k in range(len(values) - 1):
            a, b = values[array[k]:], values[array[k + 1]:]
            same = next((m for m, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(same, 12)


def removed(texts, length):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[k:k + length] for k in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k + 1:k + 1 + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[1:-1]])
        found.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return found


def texts_with_repeats(seed):
    own = random.Random(seed)
    words = ["".join(own.choice("abcdeé") for _ in range(own.randint(1, 6))) for _ in range(60)]
    long = [" ".join(own.choice(words) for _ in range(own.randint(1, 150))) for _ in range(40)]
    texts = list(long)
    for _ in range(40):
        a, b = own.choice(long), own.choice(long)
        texts.append(a[own.randint(0, 50):own.randint(0, 400)] + own.choice(words) + b[own.randint(0, 90):])
    return texts + ["x" * 199, "y" * 200, "z" * 201, "ab" * 3000, "é" * 150, "q" + "é" * 150, "", None, None, "\x00" * 500, long[0], long[0]]


@pytest.mark.parametrize("shard_bytes", [8_000_000, 3_000])
def test_removals_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(op4, "SHARD_BYTES", shard_bytes)
    texts = texts_with_repeats(shard_bytes)
    rows = [(k // 2 if k % 9 else None, t, "x", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n int, _key int").repartition(3)
    expected = sorted(((r[0], *f) for r, f in zip(rows, removed(texts, 200))), key=repr)
    assert sorted(map(tuple, op4.removals(docs).collect()), key=repr) == expected
    kept = op4.without_repeats(docs)
    assert kept.columns == docs.columns and kept.where("text is null and _key = 2").count() == 2
    assert kept.where("text is not null").agg(F.sum(F.length(F.encode("text", "UTF-8")))).first()[0] <= sum(e[1] - e[2] for e in expected)


def test_a_frequent_line_does_not_make_one_large_shard(spark, monkeypatch):
    own = random.Random(8)
    some = lambda n: "".join(own.choice("abcdefghij ") for _ in range(n))
    line, passage = some(190), some(400)
    texts = [some(300) + line + some(300) for _ in range(300)]
    texts += [some(150) + passage + line + passage[:120] + some(90) for _ in range(30)] + [t[100:] for t in texts[:20]] + texts[:3]
    expected = sorted(removed(texts, 200))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    keyed = docs.select(op4.text_key(F.col("text")).alias("key"), "text")
    different = keyed.groupBy("key").agg(F.first("text").alias("text"))

    def largest():
        placed, _ = op4.dealt_pieces(keyed, different, 200)
        sums = placed.select("h", "id", F.length("piece").alias("b")).distinct().groupBy("h").agg(F.sum("b"))
        return sums.agg(F.max("sum(b)")).first()[0]

    assert largest() > 40_000  # the pieces around the smallest gram of the line
    monkeypatch.setattr(op4, "HOT_TEXTS", 25)
    assert largest() < 10_000
    monkeypatch.setattr(op4, "SHARD_BYTES", 5_000)
    assert sorted(tuple(r)[1:] for r in op4.removals(docs).collect()) == expected
    monkeypatch.setattr(op4, "HOT_TEXTS", 2)  # nearly all grams of repeated passages
    assert sorted(tuple(r)[1:] for r in op4.removals(docs).collect()) == expected


def test_removals_of_nothing(spark):
    assert op4.removals(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = op4.removals(spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in one) == [(0, 0), (5, 0)]


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(op4, "SEGMENT", 1 << 9)
    data = ("".join(random.Random(3).choice("ab ") for _ in range(3000)) + "cc" * 400).encode()
    text, h, s, r, again = op4.pieces_of([b"", data, data[:250]], 200)
    own = [(a, b) for n, a, b in zip(text, s, r) if n == 1]
    covered = sorted(k for a, b in own for k in range(a, a + b))
    assert covered == list(range(len(data) - 199))
    keys = {}
    for n, key, a, b in zip(text, h, s, r):
        whole = data if n == 1 else data[:250]
        for k in range(a, a + b):
            assert keys.setdefault(whole[k:k + 200], key) == key


def near(texts, words_each, percent=80):
    """(size, component, kept) by all pairs."""
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + words_each]) for k in range(len(w) - words_each + 1)} if len(w) >= words_each else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted(((i, len(sets[k]), low.get(top(k), i), i is not None and i == low[top(k)]) for k, (i, _) in enumerate(texts)), key=repr)


def edited_copies(seed, groups=4, copies=45):
    own = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    texts = []
    for g in range(groups):
        base = [own.choice(words) for _ in range(own.randint(5, 150))]
        for c in range(copies):
            new = list(base)
            for _ in range(own.randint(0, max(1, len(base) // own.choice((8, 12, 30))))):
                new[own.randrange(len(new))] = own.choice(words)
            texts.append((g * 100 + c, own.choice((" ", "\n ")).join(new).replace("w1", "W1")))
    return texts + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "x " * 5000), (906, "one two"), (None, texts[0][1]), (907, texts[3][1]), (907, texts[3][1])]


@pytest.mark.parametrize(("words_each", "block"), [(2, 256), (5, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words_each, block):
    monkeypatch.setattr(op8, "BLOCK", block)
    texts = edited_copies(words_each)
    docs = spark.createDataFrame([(*t, "x", 1, 2) for t in texts], "doc_id long, text string, node string, signature int, _root int").repartition(3)
    expected = near(texts, words_each)
    assert sorted(map(tuple, op8.near_duplicates(docs, words_each).collect()), key=repr) == expected
    kept = op8.one_of_each(docs, words_each)
    assert kept.columns == docs.columns and {r["_root"] for r in kept.collect()} == {2}
    without = sum(1 for e in expected if not e[1])
    assert kept.count() == len({e[2] for e in expected if e[1]}) + without
    assert op8.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union(spark, seed):
    own = random.Random(seed)
    edges = [(own.randint(0, 80), own.randint(0, 80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(200, k) for k in range(201, 260)]
    parent = {k: k for e in edges for k in e}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {k: top(k) for k in parent if any(a != b and k in (a, b) for a, b in edges)}
    assert components(df.limit(0)).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    kept = docs
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        frames.append(kept)
    for f in frames[:-1]:
        assert f.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in frames[0].collect()]
    assert sorted(r["doc_id"] for r in frames[1].collect()) == sorted(e[0] for e in near(texts, 5) if e[3])
    before = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    ids = list(before)
    after = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    for i, (_, _, _, digest) in zip(ids, removed([before[i] for i in ids], 200)):
        if after[i].encode() == before[i].encode():
            assert digest == hashlib.sha256(before[i].encode()).hexdigest()
    assert {r["doc_id"] for r in frames[3].collect()} == set(ids)


def test_queries_are_registered():
    assert len(queries.queries()) == 14 and set(queries.statements()) <= set(queries.queries())
