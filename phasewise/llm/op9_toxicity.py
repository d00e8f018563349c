"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Two words are alike as far as they share subsequences of four characters; a subsequence that
spans more characters weighs less (decay per character), up to ``SPAN``.  So an insult with
gaps, inserted characters or endings stays near the plain insult.  Words are normalised by
the weights of their own subsequences, so long words are not nearer to everything.

Landmarks are words of labelled documents.  The kernel against the landmarks, whitened by
their own kernel matrix, is the Nyström map; a linear support vector machine on it is one
weight per landmark.  As the kernel is a product over subsequences, landmarks and weights
fold into one table of subsequence weights, with which a word is scored without visiting the
landmarks one by one; the values are the same.

A sentence scores as its worst word and a document by its three worst different words, through a
logistic curve fitted on the labelled documents.
Words of single letters set apart (``i d i o t``) are read together.

Only the texts are inputs of a score.  The fit uses a bounded sample of labelled documents
(``TRAIN_DOCS``, those with the smallest id hashes outside the held-out fold).  Null and empty texts
score as documents without words.  A doc_id with several labels counts as toxic if any says
so; labels without a document, or null, are skipped.  Without toxic or clean examples the
score is the smoothed share of toxic ones.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import column, hold, portions, quoted, tidy, unused

FOLDS = 5
#: Bounds of the fit: labelled documents, words of either kind, landmarks.
TRAIN_DOCS = 12_000
POSITIVE_WORDS = 600
NEGATIVE_WORDS = 1_500
LANDMARKS = 400
#: Times that the clean words with the highest scores join the examples, and how many.
HARD_ROUNDS, HARD_WORDS = 2, 500
#: A word is a landmark if so much of it is left unexplained by the landmarks before it.
UNEXPLAINED = 0.3
#: The kernel: characters of a subsequence, the longest stretch it may span, weight lost per character.
LENGTH, SPAN, DECAY = 4, 7, 0.6
#: Longer words are scored in overlapping windows of this many characters.
WINDOW = 24
#: A word is an example of toxicity if at least so many toxic documents have it, so many times as often.
LEAST_DOCS, LEAST_RATIO = 3, 4.0
REMEMBERED_WORDS = 200_000
LEARNED_AT_ONCE = 20_000
#: A document is described by its worst different words, their positive scores also squared and
#: cubed, so that one plain insult can outweigh several doubtful words.
WORST, POWERS = 3, (2, 3)
FEATURES = WORST * (1 + len(POWERS))
#: Characters: a-z, one for word borders, the rest by hash.
LETTERS, OTHERS = 27, 13
BASE = LETTERS + OTHERS
#: Border signs at each end of a word, so that its beginning and end weigh more.
BORDERS = 2
LOOKALIKES = str.maketrans("013457@$", "oieastas")
AROUND = re.compile(r"^[\W_]+|[\W_]+$")
PART = re.compile(r"[^\W\d_]+")
APART = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


@cache
def patterns(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of all subsequences of a word with so many characters (borders included)."""
    rows = [(a, *rest) for a in range(size) for rest in itertools.combinations(range(a + 1, min(size, a + SPAN)), LENGTH - 1)]
    places = np.array(rows, np.int64).reshape(-1, LENGTH)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1.0) if len(rows) else np.zeros(0))


def codes(words: list[str]) -> np.ndarray:
    """Character numbers of words of one length, with borders."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.int64)
    plain = (points >= 97) & (points <= 122)
    return np.pad(np.where(plain, points - 96, LETTERS + points % OTHERS), ((0, 0), (BORDERS, BORDERS)))


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for size, own in groups.items():
        step = max(1, 400_000 // max(1, len(patterns(size + 2 * BORDERS)[0])))
        for at in range(0, len(own), step):
            yield own[at:at + step], [words[k] for k in own[at:at + step]]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights, (words x subsequences), of words of one length."""
    letters = codes(words)
    places, weights = patterns(letters.shape[1])
    number = letters[:, places[:, 0]]
    for k in range(1, LENGTH):
        number = number * BASE + letters[:, places[:, k]]
    norm = np.sqrt((weights ** 2).sum())
    return number, weights / norm if norm else weights


def features(words: list[str]) -> list[dict[int, float]]:
    result: list[dict[int, float]] = [{} for _ in words]
    for own, same in by_length(words):
        numbers, weights = subsequences(same)
        for k, row in zip(own, numbers.tolist()):
            for n, w in zip(row, weights.tolist()):
                result[k][n] = result[k].get(n, 0.0) + w
    return result


def kernel(left: list[dict[int, float]], right: list[dict[int, float]]) -> np.ndarray:
    holders: dict[int, list[tuple[int, float]]] = {}
    for j, own in enumerate(right):
        for n, w in own.items():
            holders.setdefault(n, []).append((j, w))
    result = np.zeros((len(left), len(right)))
    for i, own in enumerate(left):
        for n, w in own.items():
            for j, v in holders.get(n, ()):
                result[i, j] += w * v
    return result


def cleaned(chunk: str) -> set[str]:
    """Words of a run of characters without white space: its letters together, and its longer parts.

    Signs around it go; digits and signs inside stand for the letters they look like.
    """
    own = AROUND.sub("", chunk).translate(LOOKALIKES)
    parts = PART.findall(own)
    joined = "".join(parts)
    found = {joined} | ({p for p in parts if len(p) > 2} if len(parts) > 1 else set())
    result = set()
    for w in found:
        if len(w) <= WINDOW:
            result.add(w)
        else:
            result.update(w[k:k + WINDOW] for k in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    result.discard("")
    return result


def chunks_of(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    found.update("".join(m.split()) for m in APART.findall(text))
    return found


@dataclass
class Model:
    """Subsequence weights and the curve from word scores to a document's score."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    table: np.ndarray | None = field(default=None, repr=False)
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"numbers": self.numbers, "weights": self.weights, "bias": self.bias, "curve": self.curve, "table": None, "known": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(BASE ** LENGTH, np.float32)
            self.table[self.numbers] = self.weights
        result = np.zeros(len(words))
        for own, same in by_length(words):
            numbers, weights = subsequences(same)
            result[own] = self.table[numbers] @ weights + self.bias
        return result

    def learn(self, chunks: set[str]) -> None:
        todo = iter(chunks)
        while some := list(itertools.islice(todo, LEARNED_AT_ONCE)):
            new = [(c, cleaned(c)) for c in some]
            words = sorted(set().union(*(ws for _, ws in new)))
            scores = dict(zip(words, self.word_scores(words).tolist()))
            for c, ws in new:
                self.known[c] = max((scores[w] for w in ws), default=self.bias)

    def document_features(self, texts: list[str]) -> np.ndarray:
        """Scores of the worst different words of each text, and powers of them."""
        split = [chunks_of(t) for t in texts]
        if len(hold(self.known)) > REMEMBERED_WORDS:
            self.known.clear()
        self.learn(set().union(*split) - self.known.keys())
        result = np.full((len(texts), FEATURES), min(self.bias, -1.0))
        for row, chunks in zip(result, split):
            values = np.fromiter(map(self.known.__getitem__, chunks), float, len(chunks))
            worst = np.sort(np.partition(values, -WORST)[-WORST:] if len(values) > WORST else values)[::-1]
            row[:len(worst)] = worst
        for k, power in enumerate(POWERS, 1):
            result[:, k * WORST:(k + 1) * WORST] = np.maximum(result[:, :WORST], 0) ** power
        return result

    def scores(self, features_: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features_ @ self.curve[:-1] + self.curve[-1], -30, 30)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 200.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(50):
        active = (y * (x @ w)) < 1
        own = x[active]
        new = np.linalg.solve(keep + cost * own.T @ (own * weight[active, None]),
                              cost * own.T @ (weight[active] * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def landmarks(own: list[dict[int, float]], count: int) -> list[int]:
    """The first words, but for those that the ones before already explain."""
    gram = kernel(own, own)
    left = gram.diagonal().copy()
    basis = np.zeros((len(own), 0))
    taken: list[int] = []
    for k in range(len(own)):
        if len(taken) < count and left[k] > UNEXPLAINED * gram[k, k]:
            taken.append(k)
            new = (gram[:, k] - basis @ basis[k]) / np.sqrt(left[k])
            basis = np.hstack([basis, new[:, None]])
            left = np.maximum(left - new ** 2, 0)
    return taken


def word_model(positive: list[str], documents: np.ndarray, negative: list[str], count: int) -> Model:
    """Words in order of importance; a positive word weighs as many times as documents show it."""
    words = positive + negative
    own = features(words)
    chosen = landmarks(own[:len(positive)], count * 2 // 3)
    chosen += [len(positive) + k for k in landmarks(own[len(positive):], count - len(chosen))]
    marks = [own[k] for k in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[documents / documents.sum(), np.full(len(negative), 1 / len(negative))]
    w, bias = machine(kernel(own, marks) @ whiten, y, weight)
    total: dict[int, float] = {}
    for alpha, features_ in zip(whiten @ w, marks):
        for n, v in features_.items():
            total[n] = total.get(n, 0.0) + alpha * v
    numbers = np.array(sorted(total), np.int64)
    return Model(numbers, np.array([total[n] for n in numbers.tolist()], np.float32), bias, np.zeros(FEATURES + 1))


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(column(id_column).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    chosen = (labels.select(column(id_column).alias("_id"), column(label_column).cast("int").alias("_toxic"))
              .where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
              .where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs))
    # at most train_docs ids
    sample = cut(docs.select(column(id_column).alias("_id"), column(text_column).cast("string").alias("_text"))
                 .join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id").limit(train_docs))
    sizes = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_ = iter(batch.column(1).to_pylist())
            for texts in portions(batch.column(0)):
                found: list[str] = []
                marks: list[int] = []
                for t, y in zip(texts, labels_):
                    own = sorted(set().union(*map(cleaned, chunks_of(t))))
                    found += own
                    marks += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["word", "y"])

    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0,
                 np.append(np.zeros(FEATURES), np.log((toxic + 1) / (clean + 1))))
    if not toxic or not clean:
        return none
    counted = cut(sample.repartition(spark.sparkContext.defaultParallelism * 2).select("_text", "_toxic").mapInArrow(tidy(words), "word string, y int")
                  .groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    found = (counted.where((F.col("t") >= LEAST_DOCS) & (ratio >= LEAST_RATIO))
                .orderBy((F.col("t") * F.log(ratio)).desc(), "word").limit(POSITIVE_WORDS).collect())
    positive, documents = [r["word"] for r in found], np.array([r["t"] for r in found], float)
    usual = counted.where((F.col("c") >= 1) & (ratio < 1.5))
    negative = [r[0] for r in usual.orderBy(F.col("c").desc(), "word").limit(NEGATIVE_WORDS // 3).collect()]
    negative += [r[0] for r in usual.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE_WORDS - len(negative)).collect()]
    negative = list(dict.fromkeys(negative))
    if not positive or not negative:
        return none
    model = word_model(positive, documents, negative, LANDMARKS)
    for _ in range(HARD_ROUNDS):  # clean words that the machine takes for toxic join the examples
        negative += [w for w in _hardest(counted.where("t = 0"), model) if w not in set(negative)]
        model = word_model(positive, documents, negative, LANDMARKS)

    names = [*(f"f{k}" for k in range(FEATURES)), "y"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in portions(batch.column(0)):
                found = model.document_features(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(found[:, k]) for k in range(FEATURES)), batch.column(1).slice(at, len(texts))], names=names)
                at += len(texts)

    rows = np.array([tuple(r) for r in sample.select("_text", "_toxic").mapInArrow(tidy(measured), ", ".join(f"{n} double" for n in names[:-1]) + ", y int").collect()], float)
    model.curve = logistic(rows[:, :-1], rows[:, -1])
    return model


def _hardest(words: DataFrame, model: Model) -> list[str]:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.word_scores(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["word", "score"])

    scored = words.select("word").mapInArrow(tidy(run), "word string, score double")
    return [r[0] for r in scored.orderBy(F.col("score").desc(), "word").limit(HARD_WORDS).collect()]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs' id with held_out, score and predicted."""
    rows = docs.select(column(id_column).alias("_id"), column(text_column).cast("string").alias("_text"))
    return _scored(rows, model, "_text", "_score").select(
        F.col("_id").alias(id_column), held_out("_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def _scored(rows: DataFrame, model: Model, text_column: str, name: str) -> DataFrame:
    columns = rows.columns
    place = columns.index(text_column)
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema) + f", {quoted(name)} double"
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.scores(own.document_features(texts)) for texts in portions(batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*columns, name])

    return rows.mapInArrow(tidy(run), schema)


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose texts are not predicted toxic."""
    name = unused(docs.columns, "_score")
    return _scored(docs, model, text_column, name).where(column(name) < 0.5).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
