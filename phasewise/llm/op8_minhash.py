"""Near-duplicate documents: MinHash with banding, verification and connected components.

A text is the set of its distinct word n-grams, as 64-bit hashes.  Texts with equal sets are
one node.  Each node has ``BANDS * ROWS`` minima of universal (multiply-add-shift) hashes;
nodes that agree on all rows of a band share a bucket.  At a similarity of 0.8 a pair
misses every bucket with a probability of (1 - 0.8^4)^32 = 5e-8.

In each bucket every node is first held against the smallest one only.  A pair is verified
by its signature (agreement well below the threshold rejects) and then on the full sets.
Links found that way are joined to components.  Nodes that share buckets, directly or
through others, are a family.  Where a family still has several components, all its pairs
across components are compared on their full sets, in blocks of bounded size: no link is lost,
and no task returns more than one link per node, so no pairs are written out.

Texts that are null, empty or only white space have no set and link with nothing; their
component is their own id.  Repeated rows and equal ids are nodes by their text; a null id
takes part in links but is never a component id.  Very long texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import ROWS_AT_ONCE, column, groups, hold, portions, quoted, tidy, unused
from phasewise.llm.components import components

PERCENT = 80
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Signatures whose agreement lies so many standard deviations below the threshold are not verified further.
DEVIATIONS = 6
#: Nodes of a family compared with as many others in one step, and different n-grams looked at together.
BLOCK = 256
COLUMNS = 8192
REMEMBERED_WORDS = 150_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@cache
def hashes() -> tuple[WordHashes, np.ndarray, np.ndarray]:
    own = np.random.Generator(np.random.PCG64(20240229))
    a = own.integers(0, 2 ** 64, MINIMA, np.uint64) | np.uint64(1)
    return WordHashes(), a[:, None], own.integers(0, 2 ** 64, MINIMA, np.uint64)[:, None]


def least_agreement(percent: int) -> int:
    share = percent / 100
    return max(1, round(MINIMA * (share - DEVIATIONS * (share * (1 - share) / MINIMA) ** 0.5)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words_each: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram of all its words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = hold(hashes()[0])
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(words_each, len(words))
    grams = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        grams = mixed(grams * STEP + own[k:len(own) - size + 1 + k])
    return np.unique(grams)


def signature(grams: np.ndarray) -> np.ndarray:
    _, a, b = hashes()
    low = np.full(MINIMA, 2 ** 64 - 1, np.uint64)
    for k in range(0, len(grams), 2048):
        part = a * grams[None, k:k + 2048]
        part += b
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, words_each: int, id_column: str, text_column: str) -> DataFrame:
    """id, text_key, n_shingles, node (null without a set) and signature of each row."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"_id {kind}, text_key binary, n_shingles long, node binary, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for texts in portions(batch.column(2)):
                for t in texts:
                    grams = shingles(t, words_each)
                    columns[0].append(len(grams))
                    columns[1].append(node_of(grams) if len(grams) else None)
                    columns[2].append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary())))],
                names=["_id", "text_key", "n_shingles", "node", "signature"])

    text = column(text_column).cast("string")
    return docs.select(column(id_column).alias("_id"), text_key(text).alias("text_key"), text.alias("_text")).mapInArrow(tidy(run), schema)


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sets_of(docs: DataFrame, wanted: DataFrame, words_each: int, text_column: str) -> DataFrame:
    """node, full set and signature of the texts whose keys are wanted (text_key, distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in portions(batch.column(0)):
                sets = [shingles(t, words_each) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["node", "grams", "signature"])

    text = column(text_column).cast("string")
    rows = docs.select(text.alias("_text"), text_key(text).alias("text_key"))
    # one text of each wanted key is enough
    return (rows.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("_text").alias("_text"))
            .select("_text").mapInArrow(tidy(run), "node binary, grams binary, signature binary"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose signatures and then full sets are similar enough."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            good = []
            for ga, gb, sa, sb in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                agree = np.count_nonzero(np.frombuffer(sa, "<u4") == np.frombuffer(sb, "<u4"))
                x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
                both = 0
                if agree >= least and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("signature").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"), F.col("signature").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb", "sa", "sb")
            .mapInArrow(tidy(run), "a binary, b binary"))


def shared_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), COLUMNS):
        own = (number >= at) & (number < at + COLUMNS)
        has = np.zeros((len(sets), min(COLUMNS, len(values) - at)), np.float32)
        has[row[own], number[own] - at] = 1
        total += has[left] @ has[right].T
    return total


def across(pairs: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Further links (a, b) between nodes that buckets connect and verified links do not yet.

    Nodes that buckets connect, however indirectly, are a family.  Families of several
    components are compared on their full sets, block by block, and each task returns no more
    than one link per node.
    """
    roots = components(found).withColumnRenamed("node", "_node")
    family = components(pairs).withColumnRenamed("root", "family")
    placed = cut(family.join(roots, F.col("node") == F.col("_node"), "left")
                 .select("family", "node", F.coalesce("root", "node").alias("root")))
    open_ = (placed.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
             .where("low <> high").select("family", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = (placed.join(open_, "family").join(sets.select("node", "grams"), "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = rows.select("family", "node", "root", "grams", "block", F.explode(others).alias("other"))
    dealt = met.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "node", "root", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), own in groups(batches, 3):
            block, nodes = own["block"].to_numpy(), own["node"].to_pylist()
            number = {r: k for k, r in enumerate(dict.fromkeys(own["root"].to_pylist()))}
            root = np.array([number[r] for r in own["root"].to_pylist()])
            if len(number) < 2:
                continue
            parent = list(range(len(number)))

            def top(k: int) -> int:
                while parent[k] != k:
                    parent[k] = k = parent[parent[k]]
                return k

            grams = [np.frombuffer(g, np.uint64) for g in own["grams"].to_pylist()]
            size = np.array([len(g) for g in grams])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            both = shared_grams(grams, left, right)
            linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (root[left][:, None] != root[right][None, :])
            some: list[tuple[bytes, bytes]] = []
            for x, y in zip(*np.nonzero(linked)):
                x, y = left[x], right[y]
                p, q = top(root[x]), top(root[y])
                if p != q:
                    parent[p] = q
                    some.append((nodes[x], nodes[y]))
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in some], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return (dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
            .mapInArrow(tidy(run), "a binary, b binary"))


def links(docs: DataFrame, signed: DataFrame, words_each: int, percent: int, text_column: str) -> DataFrame:
    """(node, root) of all nodes with a link."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
        k, F.substring("signature", k * 4 * ROWS + 1, F.lit(4 * ROWS))))
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("signature").alias("signature"))
    banded = nodes.select("node", F.explode(bands).alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = cut(banded.join(shared.select("key", "low"), "key"))
    pairs = cut(buckets.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    wanted = buckets.select("node").distinct()
    keys = signed.join(wanted, "node").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key")
    sets = cut(sets_of(docs, keys, words_each, text_column))
    found = cut(verified(pairs, sets, percent))
    return components(found.union(across(pairs, found, sets, percent)))


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = PERCENT, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links) and kept."""
    signed, by_node = _components(docs, words_each, percent, id_column, text_column)
    own = F.col("_id")
    return (signed.select("_id", "n_shingles", "node").join(by_node, "node", "left")
            .select(own.alias(id_column), "n_shingles", F.coalesce("component_id", own).alias("component_id"))
            .withColumn("kept", F.coalesce(column(id_column) == F.col("component_id"), F.lit(False))))


def _components(docs, words_each, percent, id_column, text_column) -> tuple[DataFrame, DataFrame]:
    signed = cut(sign(docs, words_each, id_column, text_column))
    roots = links(docs, signed, words_each, percent, text_column)
    ids = signed.where("node is not null").groupBy("node").agg(F.min("_id").alias("low"))
    placed = ids.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return signed, placed.join(lowest, "root").select("node", "component_id", "root")


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = PERCENT, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Rows of docs, all columns: of each group of near duplicates the one with the smallest id
    (null last; equal ids: one of them, by a hash of the row), and all rows without a set."""
    signed, by_node = _components(docs, words_each, percent, id_column, text_column)
    key, mark, group, several = (unused(docs.columns, n) for n in ("_key", "_mark", "_root", "_several"))
    root = (signed.where("node is not null").select("text_key", "node").distinct()
            .join(by_node.select("node", "root"), "node").select(F.col("text_key").alias(key), F.col("root").alias(group)))
    names = [column(c) for c in docs.columns]
    rows = docs.withColumn(key, text_key(column(text_column).cast("string"))).withColumn(mark, F.xxhash64(*names))
    # who stays is decided on ids and hashes; the texts move once, to meet the decision
    placed = rows.select(key, mark, F.struct(column(id_column).isNull(), column(id_column), F.col(mark)).alias("order")).join(root, key, "left")
    grouped = placed.where(F.col(group).isNotNull())
    first = grouped.groupBy(group).agg(F.min("order").alias("first"))
    chosen = (grouped.join(first, group).where("order = first").groupBy(key, mark, group)
              .agg((F.count("*") > 1).alias(several)))
    alone = (placed.where(F.col(group).isNull()).select(key, mark).distinct()
             .select(key, mark, F.lit(None).cast("binary").alias(group), F.lit(False).alias(several)))
    kept = rows.join(cut(chosen.unionByName(alone)), [key, mark])
    # of rows equal in every column one stays
    return kept.where(~F.col(several)).select(*names).union(
        kept.where(F.col(several)).dropDuplicates([group]).select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_each=2)
