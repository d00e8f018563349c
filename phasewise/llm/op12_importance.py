"""Importance resampling towards a target: hashed word features, exact bucket totals, Gumbel draws.

A text's features are its runs of 1 to ``most`` consecutive words, repeats counted; a feature's
bucket is the CRC-32 of its bytes modulo ``buckets``.  The totals of all buckets, in the documents
and in the target, give each bucket a gain, and a document weighs the mean gain of its features.
A score adds noise made from the id, and the highest scores are drawn.

Vocabulary in head and tail: words are counted over all documents; the CRC states of the most
frequent ones and the buckets of the most frequent pairs of them are broadcast, ``HEAD_WORDS`` and
``HEAD_PAIRS`` at most, of at most ``HEAD_BYTES`` bytes each.  Every other word takes its CRC
directly, and a run continues the state of the run before its last word.  Head and tail give
the same buckets, so where one ends changes no result.

Texts are cut into words twice: for the vocabulary, and for the buckets of each document, which are
written with their counts.  Totals and weights come from that table.  Ranks are given by sorting
ranges of scores and adding up the sizes of the ranges before.

Null and empty texts have no features and weigh 0.  Repeated rows and equal ids are separate
documents with equal noise; a null id has the noise of an empty one and comes first among ties.  Texts are processed
whole, of any length.  An empty table of documents gives no rows; an empty target, gains of a target
without features.  Other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import ROWS_AT_ONCE, column, portions, tidy

MOST_WORDS, BUCKETS, SEED = 1, 10_000, 2024
PERCENT, LEAST_WORDS = 10, 20
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 20_000, 20_000, 64
#: Bytes of different words or pairs that a task holds back to add up their counts.
HELD_BYTES = 32_000_000
#: A partition's number in an id of monotonically_increasing_id.
PARTITION_BITS = 33
#: Small letters for capital ones, a space for every other ASCII character that is in no word.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

Head = tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]


def words(text: str) -> list[bytes]:
    """The words of a text in lower case (A to Z only), as UTF-8."""
    return text.encode().translate(LETTERS).split()


class Portion:
    """The words of some texts as numbers of their different words."""

    def __init__(self, texts: list[str]):
        parts = [words(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        coded = pa.array([w for p in parts for w in p], pa.large_binary()).dictionary_encode()
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.text = np.repeat(np.arange(len(texts)), self.sizes)

    def pairs(self) -> Iterator[tuple[bytes, bytes, int]]:
        """Pairs of neighbouring words of one text, and how often they occur."""
        inside = np.flatnonzero(self.text[1:] == self.text[:-1])
        codes, n = np.unique(self.number[inside] * len(self.words) + self.number[inside + 1], return_counts=True)
        for code, times in zip(codes.tolist(), n.tolist()):
            first, second = divmod(code, len(self.words))
            yield self.words[first], self.words[second], times

    def features(self, most: int, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and bucket of every run."""
        states, pair_buckets = head
        last = np.array([states[w] if w in states else zlib.crc32(w) for w in self.words], np.int64)
        run, texts = self.number, [self.text]
        found = [(last % buckets)[run] if len(last) else run]
        for length in range(2, most + 1):
            inside = np.flatnonzero(self.text[length - 1:] == self.text[:len(self.text) - length + 1])
            codes, place = np.unique(run[inside] * len(self.words) + self.number[inside + length - 1], return_inverse=True)
            before, after = np.divmod(codes, max(1, len(self.words)))
            known = np.full(len(codes), -1, np.int64)
            if length == 2 and pair_buckets:
                known = np.array([pair_buckets.get((self.words[a], self.words[b]), -1) for a, b in zip(before.tolist(), after.tolist())], np.int64)
            needed = known < 0 if length == most else np.ones(len(codes), bool)
            state = np.zeros(len(codes), np.int64)
            state[needed] = [zlib.crc32(b" " + self.words[b], a) for a, b in zip(last[before[needed]].tolist(), after[needed].tolist())]
            found.append(np.where(known >= 0, known, state % buckets)[place])
            texts.append(self.text[inside])
            # a run is known by its last number at its first place; places without a whole run stay unused
            run = np.zeros(len(self.number), np.int64)
            run[inside] = place
            last = state
        return np.concatenate(texts), np.concatenate(found)


def counted(texts: DataFrame, states: Broadcast | None = None) -> DataFrame:
    """feature and n: all words short enough for a head, or all pairs of words in ``states``, added up per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["feature", "n"])

        def each(part: Portion) -> Iterable[tuple[bytes, int]]:
            if states is None:
                return ((w, n) for w, n in zip(part.words, np.bincount(part.number, minlength=len(part.words)).tolist()) if len(w) <= HEAD_BYTES)
            known = states.value
            return ((a + b" " + b, n) for a, b, n in part.pairs() if a in known and b in known)

        for batch in batches:
            for part in portions(batch.column(0)):
                for feature, n in each(Portion(part)):
                    if feature in held:
                        held[feature] += n
                    else:
                        held[feature] = n
                        size += len(feature) + 100
                if size > HELD_BYTES:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    return texts.mapInArrow(tidy(run), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, at_most: int) -> list[bytes]:
    """Features that occur twice or more, from the most frequent on down to a power of two; no more than ``at_most``.

    A histogram of the powers tells where to stop, so no task sends rows that are not wanted.
    """
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    kept = cut(counts.where("n > 1").withColumn("power", power))
    least, total = 64, 0
    for found, n in kept.groupBy("power").count().orderBy(F.col("power").desc()).collect():  # 63 rows at most
        total += n
        if total > at_most:
            break
        least = found
    return [bytes(r["feature"]) for r in kept.where(F.col("power") >= least).select("feature").collect()]


def head(texts: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> Head:
    """CRC states of the frequent words of the column, and buckets of the frequent pairs of them."""
    states = {w: zlib.crc32(w) for w in most_frequent(counted(texts), HEAD_WORDS)}
    if most < 2:
        return states, {}
    pairs = most_frequent(counted(texts, texts.sparkSession.sparkContext.broadcast(states)), HEAD_PAIRS)
    return states, {tuple(p.split(b" ")): zlib.crc32(p) % buckets for p in pairs}


def bucket_rows(rows: DataFrame, known: Broadcast, most: int, buckets: int) -> DataFrame:
    """id, n_words, and buckets with their counts, of each row of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in portions(batch.column(1)):
                own = Portion(part)
                text, bucket = own.features(most, known.value, buckets)
                codes, n = np.unique(text * buckets + bucket, return_counts=True)
                ends = pa.array(np.searchsorted(codes, np.arange(len(part) + 1) * buckets).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(own.sizes),
                     pa.ListArray.from_arrays(ends, pa.array((codes % buckets).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["id", "n_words", "buckets", "counts"])
                at += len(part)

    return rows.mapInArrow(tidy(run), f"id {rows.schema[0].dataType.simpleString()}, n_words long, buckets array<int>, counts array<int>")


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of ``bucket_rows``; each task sends one row per bucket it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in (rows.select("buckets", "counts").mapInArrow(tidy(run), "bucket int, n long")
                      .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # no more rows than buckets
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln) of the ratio of its smoothed shares in the target and the source."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gain: Broadcast) -> DataFrame:
    """id, n_words, n_features and weight (floored mean gain) of each row of ``bucket_rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            counts = batch.column(3).flatten().to_numpy().astype(np.int64)
            gained = np.concatenate([[0], np.cumsum(counts * gain.value[batch.column(2).flatten().to_numpy()])])
            features = np.concatenate([[0], np.cumsum(counts)])
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            n, total = np.diff(features[ends]), np.diff(gained[ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(own: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, taking_part: Column, percent: int) -> DataFrame:
    """rows with rank: 1 and on for the first ``percent`` of those that take part, by score and id; else null.

    Ranges of scores are sorted each by itself; a range's first rank follows from the sizes of those
    before it, of which there are as many as shuffle partitions.
    """
    order = [F.col("_part").desc(), F.col("score").desc(), F.col("id").asc()]
    placed = cut(rows.withColumn("_part", F.coalesce(taking_part, F.lit(False))).repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_at", F.monotonically_increasing_id()))
    number = F.shiftright("_at", PARTITION_BITS)
    sizes = sorted(placed.groupBy(number.alias("_range")).agg(F.count("*"), F.count_if("_part")).collect())
    drawn = sum(r[2] for r in sizes) * percent // 100
    before = [0]
    for r in sizes:
        before.append(before[-1] + r[1])
    firsts = F.broadcast(rows.sparkSession.createDataFrame(  # a row per shuffle partition
        [(r[0], b) for r, b in zip(sizes, before)], "_range long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1)) + 1
    return (placed.withColumn("_range", number.cast("long")).join(firsts, "_range")
            .withColumn("rank", F.when(F.col("_part") & (rank <= drawn), rank)).drop("_range", "_before", "_at", "_part"))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text",
             target_text: str = "text") -> DataFrame:
    """Per document: id, n_features, weight, score and rank (null if not drawn), towards the texts of ``target``."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text"))
    aims = target.select(F.lit(0).alias("id"), column(target_text).cast("string").alias("text"))
    known = context.broadcast(head(texts.select("text"), most, buckets))
    rows = cut(bucket_rows(texts, known, most, buckets))
    gain = context.broadcast(gains(totals(rows, buckets), totals(bucket_rows(aims, known, most, buckets), buckets)))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return (ranked(scored, F.col("n_words") >= least_words, percent)
            .select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), source AS (SELECT row, unnest(words) AS w FROM d
), target AS (SELECT unnest({_WORDS}) AS w FROM benchmark
), codes AS (
  SELECT w, hex(encode(w)) AS code FROM (SELECT w FROM source UNION SELECT w FROM target)
), hashed AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(code) // 2),
      lambda k: (16 * (strpos('0123456789ABCDEF', code[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', code[2 * k + 2]) - 1)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM codes, crc
), s AS (SELECT bucket, count(*) AS s FROM source JOIN hashed USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + {BUCKETS})
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), own AS (
  SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM source JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN own USING (row)
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (row)
"""
