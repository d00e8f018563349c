"""Substring removal by words, importance resampling and centroid clustering, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.llm import op11_substring_dedup as op11
from phasewise.llm import op12_importance as op12
from phasewise.llm import op13_centroids as op13

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}
CLASHING = "doc_id long, text string, `_id` string, key int, `n_words` string, `_key` int"


def awkward(spark, texts):
    """Rows with nulls, repeated rows, equal ids and columns with names used inside."""
    rows = [(k // 2 if k % 7 else None, t, "x", 1, "y", 3) for k, t in enumerate(texts)]
    rows += [(1, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def told(rows):
    return sorted(map(tuple, rows), key=repr)


# substring removal

def without(texts, window):
    """n_words, n_removed and kept words of each text."""
    words = [SPACED.findall(t or "") for t in texts]
    count = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    found = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        found.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return found


def passages(seed):
    own = random.Random(seed)
    line = " ".join(own.choice("abcdefghij") + str(own.randrange(30)) for _ in range(25))
    passage = " ".join(own.choice("klmnop") + str(own.randrange(50)) for _ in range(70))
    prose = lambda n: " ".join(f"w{own.randrange(4000)}" for _ in range(n))
    texts = [f"{prose(own.randrange(60))} {own.choice([line, passage, passage[20:], '', line])}\n{prose(own.randrange(60))}" for _ in range(120)]
    texts += [texts[3], texts[3], texts[5] + " ", passage, passage + " x", "a " * 300, "a " * 90 + "b", "x y " * 120, "é\x85ü\xa0z " * 60,
              None, "", " \t\n\x0b\x0c\r ", "one", "q" * 90_000, prose(30_000), line]
    return texts


@pytest.mark.parametrize("window,hot", [(35, 5000), (35, 20), (3, 5000), (2, 4), (16, 30)])
def test_repeated_words_go(spark, monkeypatch, window, hot):
    monkeypatch.setattr(op11, "HOT_PLACES", hot)
    texts = passages(window)
    docs = awkward(spark, texts)
    order = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
              for (i, _), (n, gone, kept) in zip(order, without([t for _, t in order], window))]
    assert told(op11.removals(docs, window=window).collect()) == told(wanted)


def test_kept_words_and_other_columns(spark):
    texts = passages(9)
    docs = awkward(spark, texts)
    rows = [tuple(r) for r in docs.collect()]
    wanted = [(r[0], kept if r[1] is not None else None, *r[2:]) for r, (_, _, kept) in zip(rows, without([r[1] for r in rows], 35))]
    got = op11.without_repeats(docs)
    assert got.columns == docs.columns and told(got.collect()) == told(wanted)
    assert op11.removals(docs.limit(0)).collect() == [] and op11.without_repeats(docs.limit(0)).collect() == []


def test_super_kmers_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(op11, "SEGMENT", 300)
    monkeypatch.setattr(op11, "MOST_WINDOWS", 64)
    monkeypatch.setattr(op11, "HASHED_BYTES", 500)
    texts = [(t or "").encode() for t in passages(4)]
    text, h, first, run, again = op11.all_super_kmers(texts, 35)
    covered = Counter((t, s + k) for t, s, r in zip(text.tolist(), first.tolist(), run.tolist()) for k in range(r))
    words = [t.split() for t in texts]
    assert covered == Counter({(n, k): 1 for n, w in enumerate(words) for k in range(len(w) - 34)})
    minimiser = {}  # equal windows have equal minimisers
    for t, value, s, r in zip(text.tolist(), h.tolist(), first.tolist(), run.tolist()):
        for k in range(s, s + r):
            assert minimiser.setdefault(b" ".join(words[t][k:k + 35]), value) == value


# importance resampling

def resampled(texts, ids, targets, most, buckets, percent, least, seed):
    def features(text):
        words = LETTERED.findall((text or "").translate(CAPITALS))
        runs = [" ".join(words[k:k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, aims = [features(t) for t in texts], [features(t) for t in targets]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aims for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, (n, f) in zip(ids, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    drawn = order[:len(order) * percent // 100]
    return rows, [(r[1], r[4], k + 1) for k, r in enumerate(drawn)]


WORDS = ["the", "The", "of", "a1", "é", "漢字", "x" * 200, "zebra", "and", "it's", "x\x00y"]


@pytest.mark.parametrize("most,buckets,least,frequent", [(1, 10_000, 20, 20_000), (1, 7, 0, 3), (2, 50, 3, 4), (2, 10_000, 0, 0), (4, 97, 5, 6)])
def test_resampling(spark, monkeypatch, most, buckets, least, frequent):
    monkeypatch.setattr(op12, "HEAD_WORDS", frequent)
    monkeypatch.setattr(op12, "HEAD_PAIRS", frequent)
    own = random.Random(most * buckets)
    line = lambda n: own.choice([" ", ", ", "\n"]).join(own.choice(WORDS) + own.choice(["", "", str(own.randrange(40))]) for _ in range(n))
    texts = ["", None, "  ", "one", "THE", "the " * 5000, line(4000)] + [line(own.randrange(60)) for _ in range(150)]
    targets = [line(30) for _ in range(5)] + [None, ""]
    docs = awkward(spark, texts)
    given = docs.select("doc_id", "text").collect()
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    rows = op12.resample(docs, target, most, buckets, 30, least).collect()
    wanted, drawn = resampled([r["text"] for r in given], [r["doc_id"] for r in given], targets, most, buckets, 30, least, op12.SEED)
    assert told((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in rows) == told(r[1:] for r in wanted)
    assert sorted((r["doc_id"], r["score"], r["rank"]) for r in rows if r["rank"] is not None if r["doc_id"] is not None) == sorted(
        d for d in drawn if d[0] is not None)
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, len(drawn) + 1))


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id int, text string, score int")
    nothing = docs.limit(0)
    assert op12.resample(nothing, docs).collect() == []
    (row,) = op12.resample(docs, nothing, least_words=0, percent=100).collect()
    gain = math.floor(1000 * math.log(1 * (3 + 10_000) / (2 * 10_000)))
    assert (row["n_features"], row["weight"], row["rank"]) == (3, gain, 1)


# centroids

def clustered(rows, k, rounds, size, scale, seed):
    usable = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in usable]
    order = sorted(usable, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [[math.floor(scale * x) for x in v] for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for c in range(len(centres)):
            own = [v for (_, v), (_, n) in zip(kept, near) if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    near = assigned()
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    fit = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, fit(d), fit(inertia[n]), fit(inertia.total()), sha[n]) for (i, _), (d, n) in zip(kept, near)]


@pytest.mark.parametrize("kind", ["clusters", "few values", "large", "few rows"])
def test_clusters(spark, kind):
    own = np.random.default_rng(5)
    centres = own.standard_normal((5, 6))
    values = {"clusters": centres[own.integers(5, size=400)] + 0.1 * own.standard_normal((400, 6)),
              "few values": own.integers(-1, 2, size=(300, 6)) / 64,  # many ties and equal vectors
              "large": own.standard_normal((60, 6)) * 10.0 ** own.integers(0, 16, size=(60, 1)),
              "few rows": own.standard_normal((3, 6))}[kind]
    rows = [(k // 2 if k % 9 else None, v) for k, v in enumerate(values.tolist())]
    rows += [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 7), (5, [math.nan] + [0.0] * 5), (6, [math.inf] + [0.0] * 5), (7, [None] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id int, embedding array<double>, cluster int, v string").repartition(3)
    got = op13.clusters(frame, k=7, rounds=3, size=6, pivots=4).collect()
    assert told(got) == told(clustered(rows, 7, 3, 6, 64, op13.SEED))


def test_no_clusters(spark):
    frame = spark.createDataFrame([(1, None), (2, [math.nan])], "vec_id long, embedding array<float>")
    assert op13.clusters(frame).collect() == [] and op13.clusters(frame.limit(0)).collect() == []
    assert op13.clusters(frame).dtypes == op13.clusters(spark.createDataFrame([(1, [0.0] * 64)], frame.schema)).dtypes


def test_pivots_spare_distances():
    """On vectors in clusters most distances are not computed, and the result is that of all distances."""
    own = np.random.default_rng(1)
    middles = own.integers(-400, 400, size=(16, 64))
    vectors = middles[own.integers(16, size=3000)] + own.integers(-20, 21, size=(3000, 64))
    pivots = [tuple(v) for v in vectors[:16].tolist()]
    now = op13.Centroids([tuple(v) for v in middles.tolist()], pivots)
    to_pivots = np.stack([op13.roots(op13.squared(vectors, np.array(p))) for p in pivots], axis=1)
    best, distance, measured = now.nearest(vectors, to_pivots)
    full = ((vectors[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.3 * full.size
