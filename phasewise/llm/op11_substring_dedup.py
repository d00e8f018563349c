"""Removal of repeated runs of words by super-k-mers.

A word goes if some window of ``WINDOW`` words that covers it also starts anywhere else, in the same
text or another.  Windows never cross texts and are judged on the input.

The minimiser of a window is the gram (half as many words or more than a quarter: a power of two) with the smallest hash in it, so equal windows
have equal minimisers.  Consecutive windows with one minimiser are a super-k-mer.  A super-k-mer whose
minimiser has one place in all texts holds no repeated window and stays where it is.  Every other one travels
as one packed string (its words with single spaces) to the bucket of its minimiser, where the windows of
all strings are sorted as rows of word numbers and equal ones counted: nothing rests on a hash.

Around a minimiser with ``HOT_PLACES`` places or more (part of a line in many texts) a bucket would have no bound.
The windows of such super-k-mers are dealt by themselves instead: each travels as a digest (half a
SHA-256), digests are counted with partial sums before the shuffle, and those that occur again are joined back, where
adaptive execution splits a hot one.  Both ways are parts of one plan at every size.

Copies of a text are worked on once and count as often as they are there.  Null and empty texts have
no words; texts with fewer words than a window lose nothing.  Repeated rows and equal or null ids are
separate texts.  Texts of any length are processed whole.  An empty table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import ROWS_AT_ONCE, column, portions, tidy, unused
from phasewise.llm.op4_suffix_dedup import smallest, text_key

WINDOW = 35
#: Windows of a super-k-mer at most; longer runs (of a word repeated over and over) are several.
MOST_WINDOWS = 1024
#: Places from which the windows around a minimiser are dealt one by one.
HOT_PLACES = 5_000
#: Windows sorted at once in a bucket, besides those of the last minimiser.
SORTED_AT_ONCE = 50_000
#: Windows of texts cut into super-k-mers at once; twice as many words must fit into the bits of PLACE.
SEGMENT = 1 << 19
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of words hashed at once, and different factors of a byte's place in its word.
HASHED_BYTES, FACTORS = 1 << 20, 4096
DIGEST_BYTES = 16

_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_factors = np.cumprod(np.full(FACTORS, 0x9E3779B97F4A7C15, np.uint64))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_space[np.frombuffer(data, np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word; equal words have equal ones."""
    found = [np.zeros(0, np.uint64)]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES, side="right")))
        low, high = starts[at], ends[upto - 1]
        part = np.frombuffer(data, np.uint8, high - low, low)
        own = starts[at:upto] - low
        sizes = np.diff(np.append(own, high - low))
        within = np.arange(high - low) - np.repeat(own, sizes)
        value = np.where(_space[part], np.uint64(0), part.astype(np.uint64) + np.uint64(1)) * _factors[within % FACTORS]
        h = np.add.reduceat(value, own)
        h ^= h >> np.uint64(31)
        found.append(h * np.uint64(0xBF58476D1CE4E5B9))
        at = upto
    return np.concatenate(found)


def gram_words(window: int) -> int:
    """Words of a gram: the largest power of two that is at most half the window."""
    return 1 << ((window // 2).bit_length() - 1)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the words from each place on, by doubling."""
    h, size = words, 1
    while size < gram:
        right = h[size:]
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def super_kmers(segments: list[tuple[int, int, np.ndarray]], window: int) -> tuple[np.ndarray, ...]:
    """Text, minimiser, first word, number of windows, and whether some may be equal, of each super-k-mer.

    segments: text, number of the first word, hashes of a window of words or more.
    """
    gram = gram_words(window)
    sizes = np.array([len(s[2]) for s in segments], np.int64)
    windows = sizes - window + 1
    grams = gram_hashes(np.concatenate([s[2] for s in segments]), gram)
    # the first gram with the smallest high bits in each window, by its place in the low bits
    ranked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    own = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.cumsum(sizes) - sizes
    low = (smallest(ranked, window - gram + 1) & PLACE).astype(np.int64)[begin[own] + inside]
    value = grams[low].view(np.int64)
    other_text = own[1:] != own[:-1]
    new = np.append(True, (value[1:] != value[:-1]) | other_text)
    moved = np.append(True, (low[1:] != low[:-1]) | other_text)
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(own)))
    again = np.add.reduceat(moved.astype(np.int64), start) > 1
    parts = -(-run // MOST_WINDOWS)
    whole = np.repeat(np.arange(len(start)), parts)
    first = start[whole] + MOST_WINDOWS * (np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts))
    run = np.minimum(start[whole] + run[whole] - first, MOST_WINDOWS)
    text, offset = np.array([s[0] for s in segments], np.int64), np.array([s[1] for s in segments], np.int64)
    return text[own[first]], value[first], inside[first] + offset[own[first]], run, again[whole]


def all_super_kmers(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    held, size, found = [], 0, [(np.zeros(0, np.int64),) * 5]
    for n, data in enumerate(texts):
        hashes = word_hashes(data, *word_places(data))
        for at in range(0, len(hashes) - window + 1, SEGMENT):
            held.append((n, at, hashes[at:at + SEGMENT + window - 1]))
            size += len(held[-1][2])
            if size >= SEGMENT:
                found.append(super_kmers(held, window))
                held, size = [], 0
    if held:
        found.append(super_kmers(held, window))
    return tuple(np.concatenate(c) for c in zip(*found))


def placed_rows(texts: DataFrame, window: int) -> DataFrame:
    """key and super-k-mers (minimiser, first word and windows in one number, again) of each row of (key, text)."""
    kind = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in portions(batch.column(1)):
                text, h, s, r, again = all_super_kmers([t.encode() for t in part], window)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(part)))]).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [pa.array(h), pa.array(s * MOST_WINDOWS + r - 1), pa.array(again.astype(bool))], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "found"])
                at += len(part)

    return texts.mapInArrow(tidy(run), "key binary, found array<struct<h: long, at: long, again: boolean>>")


def wanted_rows(texts: DataFrame, window: int) -> DataFrame:
    """key, n (copies), and the super-k-mers of each different text that may hold repeated windows: usual and hot."""
    rows = cut(placed_rows(texts, window).where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("found").alias("p")).select("row", "p.h", "p.at", "p.again")
    often = each.groupBy("h").agg(F.count("*").alias("places"), F.max("again").alias("again")).where("places > 1 or again")
    hot, own = F.col("places") >= HOT_PLACES, F.struct("h", "at")
    first = rows.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    return cut(each.select("row", "h", "at").join(often.select("h", "places"), "h").join(first, "row").groupBy("key", "n")
               .agg(F.collect_list(F.when(~hot, own)).alias("usual"), F.collect_list(F.when(hot, own)).alias("hot")))


def cut_from(texts: list[str], places: list[list[dict]], window: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Text number, minimiser, first word and words of each super-k-mer."""
    for n, (text, own) in enumerate(zip(texts, places)):
        data = text.encode()
        starts, ends = word_places(data)
        for p in own:
            s, r = divmod(p["at"], MOST_WINDOWS)
            yield n, p["h"], s, data[starts[s]:ends[s + r + window - 1]].split()


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def packed_strings(window: int) -> Callable:
    """(key, n, text, super-k-mers) to (h, piece, key, n, s): a row per super-k-mer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches):
            found = list(cut_from(batch.column(2).to_pylist(), batch.column(3).to_pylist(), window))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[1] for f in found], pa.int64()), pa.array([b" ".join(f[3]) for f in found], pa.binary()),
                 batch.column(0).take(rows), batch.column(1).take(rows), pa.array([f[2] for f in found], pa.int64())],
                names=["h", "piece", "key", "n", "s"])
    return run


def single_windows(window: int) -> Callable:
    """(key, n, text, super-k-mers) to (key, n, s, digest): a row per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches):
            rows, places, digests = [], [], []
            for n, _, s, words in cut_from(batch.column(2).to_pylist(), batch.column(3).to_pylist(), window):
                for k in range(len(words) - window + 1):
                    rows.append(n)
                    places.append(s + k)
                    digests.append(hashlib.sha256(b" ".join(words[k:k + window])).digest()[:DIGEST_BYTES])
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(places, pa.int64()), pa.array(digests, pa.binary())],
                names=["key", "n", "s", "digest"])
    return run


def repeated_windows(pieces: list[bytes], places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece and range (first, behind the last) of the windows that have two places or more in all pieces."""
    words = [p.split(b" ") for p in pieces]
    sizes = np.array([len(w) for w in words], np.int64)
    code = (pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices
            .to_numpy(zero_copy_only=False).astype(">u4"))  # bytes in this order sort like numbers
    windows = sizes - window + 1
    own = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, window)[(np.cumsum(sizes) - sizes)[own] + inside])
    order = np.argsort(rows.view(f"V{4 * window}").ravel(), kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)))
    total = np.add.reduceat(places[own[order]], first)
    again = np.zeros(len(own) + 1, bool)
    again[order[np.repeat(total >= 2, np.diff(np.append(first, len(order))))]] = True
    starts = np.flatnonzero(again[:-1] & np.append(True, ~again[:-2] | (own[1:] != own[:-1])))
    ends = np.flatnonzero(again[:-1] & (~again[1:] | np.append(own[1:] != own[:-1], True)))
    return own[starts], inside[starts], inside[ends] + 1


def counted_buckets(window: int) -> Callable:
    """(h, piece, key, n, s), sorted by h and piece, to (key, low, high): ranges of repeated windows of each text."""
    def found(pieces: list[tuple[int, bytes, list[tuple[bytes, int]]]], places: list[int]) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for k, a, b in zip(*(x.tolist() for x in repeated_windows([p[1] for p in pieces], np.array(places, np.int64), window))):
            for key, s in pieces[k][2]:
                for column_, value in zip(out, (key, s + a, s + b)):
                    column_.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, bytes, list]] = []
        places: list[int] = []
        windows = 0
        for batch in each_slice(batches):
            for h, piece, key, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                if not pieces or (h, piece) != pieces[-1][:2]:
                    if windows >= SORTED_AT_ONCE and h != pieces[-1][0]:
                        yield found(pieces, places)
                        pieces, places, windows = [], [], 0
                    pieces.append((h, piece, []))
                    places.append(0)
                    windows += piece.count(b" ") + 2 - window
                pieces[-1][2].append((key, s))
                places[-1] += n
        if pieces:
            yield found(pieces, places)
    return run


def repeated_ranges(different: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """key, low and high of ranges of windows that occur again; ranges may be parts of longer ones."""
    def of(places: str) -> DataFrame:
        return different.join(wanted.where(F.size(places) > 0).select("key", "n", places), "key").select("key", "n", "text", places)

    dealt = of("usual").mapInArrow(tidy(packed_strings(window)), "h long, piece binary, key binary, n long, s long")
    usual = (dealt.repartition("h").sortWithinPartitions("h", "piece")
             .mapInArrow(tidy(counted_buckets(window)), "key binary, low long, high long"))
    single = of("hot").mapInArrow(tidy(single_windows(window)), "key binary, n long, s long, digest binary")
    again = single.groupBy("digest").agg(F.sum("n").alias("places")).where("places > 1").select("digest")
    hot = single.join(again, "digest", "left_semi").select("key", F.col("s").alias("low"), (F.col("s") + 1).alias("high"))
    return usual.unionByName(hot)


def texts_without_repeats(texts: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """For each different text of (key, text): key, n_words, n_removed and the kept words, or their SHA-256.

    key must be a function of the text.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    # no key is null; said here, it is the same filter in every use, so that Spark shuffles the texts once
    texts = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).where(F.col("key").isNotNull())
    different = texts.groupBy("key").agg(F.first("text").alias("text"))
    ranges = repeated_ranges(different, wanted_rows(texts, window), window)
    gone = ranges.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches):
            columns: tuple[list, list, list] = ([], [], [])
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                starts, ends = word_places(data)
                edges = np.zeros(len(starts) + 1, np.int64)
                for r in own or ():
                    edges[r["low"]] += 1
                    edges[r["high"] + window - 1] -= 1
                kept = np.append(np.cumsum(edges)[:-1] == 0, False)
                change = np.diff(kept.astype(np.int8), prepend=np.int8(0))
                runs = zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist())
                words = b" ".join(b" ".join(data[starts[a]:ends[b - 1]].split()) for a, b in runs)
                for c, v in zip(columns, (len(starts), len(starts) - int(kept.sum()), hashlib.sha256(words).hexdigest() if digests else words.decode())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["key", "n_words", "n_removed", last])

    last = "kept_sha256" if digests else "kept"
    return different.join(gone, "key", "left").mapInArrow(tidy(run), f"key binary, n_words long, n_removed long, {last} string")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256."""
    text = column(text_column).cast("string")
    rows = docs.select(column(id_column).alias("_id"), text_key(text).alias("key"), text.alias("text"))
    found = texts_without_repeats(rows.select("key", "text"), window, digests=True)
    return (rows.select("_id", "key").join(found, "key")
            .select(F.col("_id").alias(id_column), "n_words", "n_removed", "kept_sha256"))


def without_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the kept words and single spaces as text; null stays null."""
    text = column(text_column).cast("string")
    key, kept = unused(docs.columns, "_key"), unused(docs.columns, "_kept")
    found = (texts_without_repeats(docs.select(text_key(text).alias("key"), text.alias("text")), window)
             .select(F.col("key").alias(key), F.col("kept").alias(kept)))
    names = [F.when(text.isNotNull(), column(kept)).alias(c) if c == text_column else column(c) for c in docs.columns]
    return docs.withColumn(key, text_key(text)).join(found, key).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d
), starts AS (
  SELECT row, unnest(range(1, len(words) - {WINDOW} + 2)) AS pos FROM d
), windows AS (
  SELECT row, pos, md5(array_to_string(words[pos:pos + {WINDOW} - 1], ' ')) AS own FROM starts JOIN d USING (row)
), again AS (
  SELECT row, pos FROM windows QUALIFY count(*) OVER (PARTITION BY own) > 1
), judged AS (
  SELECT row, pos, word, max(CASE WHEN again.pos IS NULL THEN 0 ELSE 1 END) OVER (
    PARTITION BY row ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN again USING (row, pos)
), kept AS (
  SELECT row, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
  FROM judged GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
