"""Removal of long repeated byte strings by suffix sorting.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else, in the
same text or another.  Strings never cross texts and are judged on the input.

Every window of ``LENGTH`` bytes belongs to the smallest hash among the short byte grams in it, so
equal windows belong to equal hashes.  Runs of windows of one hash make a piece.  Pieces whose
hash occurs at one place in all texts hold no repeated window.  All other pieces are dealt to shards by
their hash, so all places of a repeated window meet in one shard.

A gram that ``HOT_TEXTS`` different texts or more hold (part of a line in many texts) would fill a shard.
The windows around it are dealt by more of their content: windows that hold the gram's place at offsets of one range
of ``CORES`` bytes share all bytes but those of the range less one, and the hash of these decides.  So only windows whose
surroundings are equal, too, stay together; where even those are in so many texts, single windows are dealt
by all of their bytes.  In a shard the different pieces,
each with the number of its places, form one text, whose suffixes are sorted by external induced
sorting with common prefixes (``induced.py``).  Neighbouring suffixes that share ``LENGTH``
bytes are one window; it is repeated if the places of its pieces add up to two or more.

Copies of a text are worked on once.  Copies of a piece are merged in each task before they
are dealt, so a passage in a third of all texts reaches its shard as one row per task.

Null and empty texts, and texts shorter than ``LENGTH``, lose nothing.  Repeated rows and equal
or null ids are separate texts.  Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut, scratch
from phasewise.llm.common import ROWS_AT_ONCE, column, portions, quoted, tidy, unused
from phasewise.llm.induced import suffixes

LENGTH = 200
#: Bytes of a gram: a power of two below LENGTH.
GRAM = 32
#: Windows of a piece at most; longer runs are several pieces.
MOST_WINDOWS = 4096
#: Bytes of pieces dealt to one shard, about, copies included.
SHARD_BYTES = 4_000_000
#: Different texts from which a hash counts as hot, and the ranges of offsets by which its windows are dealt anew, one after the other.
HOT_TEXTS = 20_000
CORES = (8, 1)
#: Bytes of different pieces that a task holds back to merge copies.
MERGED_BYTES = 16_000_000
#: Windows of a text worked on at once; twice as many bytes must fit into the bits of PLACE.
SEGMENT = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
#: Pieces around hot grams worked on at once, each of at most MOST_WINDOWS windows.
PIECES_AT_ONCE = 1_000
PLUS_ONE = bytes((b + 1) % 256 for b in range(256))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def gram_hashes(data: np.ndarray, gram: int = 0) -> np.ndarray:
    """A hash of the GRAM bytes (or of another power of two) at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < (gram or GRAM):
        right = h[size:]
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
        size *= 2
    return h


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:])


def pieces_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, hash, first byte, windows, and whether windows of the piece may be equal, of all pieces."""
    parts = [(n, at, t[at:at + SEGMENT + length - 1]) for n, t in enumerate(texts) for at in range(0, len(t) - length + 1, SEGMENT)]
    found = [(np.zeros(0, np.int64),) * 5]
    while parts:
        some, size = 0, 0
        while some < len(parts) and (not some or size + len(parts[some][2]) <= 2 * SEGMENT):
            size += len(parts[some][2])
            some += 1
        found.append(segment_pieces(parts[:some], length))
        del parts[:some]
    return tuple(np.concatenate(c) for c in zip(*found))


class Windows:
    """All windows of some segments (text number, first byte, bytes), one after the other."""

    def __init__(self, segments: list[tuple[int, int, bytes]], length: int):
        self.segments = segments
        sizes = np.array([len(t) for _, _, t in segments], np.int64)
        windows = sizes - length + 1
        self.data = np.frombuffer(b"".join(t for _, _, t in segments), np.uint8)
        self.grams = gram_hashes(self.data)
        # the first gram with the smallest high bits in each window, by its place in the low bits
        ranked = (self.grams & ~PLACE) | np.arange(len(self.grams), dtype=np.uint64)
        low = (smallest(ranked, length - GRAM + 1) & PLACE).astype(np.int32)
        self.own = np.repeat(np.arange(len(sizes)), windows)
        self.begin = np.cumsum(sizes) - sizes
        self.skip = self.begin - (np.cumsum(windows) - windows)
        self.low = low[np.arange(len(self.own)) + np.repeat(self.skip, windows)]

    def starts(self, rows: np.ndarray) -> np.ndarray:
        """Places of windows in ``data``."""
        return rows + self.skip[self.own[rows]]

    def text_and_place(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment = self.own[first]
        text, offset = np.array([s[0] for s in self.segments], np.int64), np.array([s[1] for s in self.segments], np.int64)
        return text[segment], self.starts(first) - self.begin[segment] + offset[segment]


def segment_pieces(segments: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    w = Windows(segments, length)
    low, own = w.low, w.own
    change = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (own[1:] != own[:-1])))
    value = w.grams[low[change]].view(np.int64)
    new = np.append(True, (value[1:] != value[:-1]) | (own[change[1:]] != own[change[:-1]]))
    start, value = change[new], value[new]
    again = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
    run = np.diff(np.append(start, len(own)))
    parts = -(-run // MOST_WINDOWS)
    first = np.repeat(start, parts) + MOST_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    run = np.minimum(np.repeat(start + run, parts) - first, MOST_WINDOWS)
    text, place = w.text_and_place(first)
    return text, np.repeat(value, parts), place, run, np.repeat(again, parts)


def core_pieces(segments: list[tuple[int, int, bytes]], length: int, width: int) -> tuple[np.ndarray, ...]:
    """Text number, hash, first byte and windows of runs of at most ``width`` windows around one gram.

    Windows that hold their gram at offsets from k * width to (k + 1) * width - 1 all hold the bytes from
    k * width before the gram on that the first and the last of them share; the hash is that of these and k.
    """
    w = Windows(segments, length)
    rows = np.arange(len(w.own))
    group = (w.low - w.starts(rows)) // width
    start = np.flatnonzero(np.append(True, (w.low[1:] != w.low[:-1]) | (group[1:] != group[:-1]) | (w.own[1:] != w.own[:-1])))
    run = np.diff(np.append(start, len(rows)))
    core, size = length - width + 1, 1 << ((length - width + 1).bit_length() - 1)
    hashes = gram_hashes(w.data, size)
    at = w.low[start] - width * group[start]
    value = (hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + core - size]) ^ group[start].astype(np.uint64)
    text, place = w.text_and_place(start)
    return text, (value * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), place, run


def piece_rows(texts: DataFrame, length: int) -> DataFrame:
    """text key and pieces (hash, place: first byte and windows in one number, again) of each row of (key, text)."""
    kind = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in portions(batch.column(1)):
                text, h, s, r, again = pieces_of([t.encode() for t in part], length)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(part)))]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(h), pa.array(s * MOST_WINDOWS + r - 1), pa.array(again.astype(bool))], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "pieces"])
                at += len(part)

    return texts.mapInArrow(tidy(run), "key binary, pieces array<struct<h: long, at: long, again: boolean>>")


def dealt_anew(length: int, width: int):
    """Rows (key, n, h, at) of the pieces (key, n, s, piece) by the bytes that windows of nearby offsets share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECES_AT_ONCE) for b in batches for at in range(0, b.num_rows, PIECES_AT_ONCE)):
            parts = [(k, s, piece) for k, (s, piece) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))]
            row, h, s, r = core_pieces(parts, length, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(h),
                 pa.array(s * MOST_WINDOWS + r - 1)], names=["key", "n", "h", "at"])
    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, piece, places) with equal ids of one task made one, as far as memory goes."""
    held: dict[bytes, list] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v[0] for v in held.values()], pa.int32()), pa.array(list(held), pa.binary()),
             pa.array([v[1] for v in held.values()], pa.binary()), pa.array([v[2] for v in held.values()], pa.int64())],
            names=["shard", "id", "piece", "places"])

    for batch in batches:
        for shard, own, piece, places in zip(*(c.to_pylist() for c in batch.columns)):
            if own in held:
                held[own][2] += places
            else:
                held[own] = [shard, piece, places]
                size += len(piece)
        if size > MERGED_BYTES:
            yield rows()
            held.clear()
            size = 0
    if held:
        yield rows()


class Shard:
    """The different pieces of one shard, one after the other, with a separator between them."""

    def __init__(self, length: int):
        self.length = length
        self.number: dict[bytes, int] = {}
        self.places: list[int] = []
        self.sizes: list[int] = []
        self.file = tempfile.TemporaryFile()  # gone when closed

    def add(self, own: bytes, piece: bytes, places: int) -> None:
        k = self.number.setdefault(own, len(self.places))
        if k < len(self.places):
            self.places[k] += places
            return
        self.places.append(places)
        self.sizes.append(len(piece))
        self.file.write(piece.translate(PLUS_ONE))  # no byte of UTF-8 is 255, so 0 is free
        self.file.write(b"\0")

    def repeated(self) -> pa.RecordBatch:
        """id and ranges of window starts, of the pieces with repeated windows."""
        self.file.flush()
        sizes, places = np.array(self.sizes, np.int64), np.array(self.places, np.int64)
        text = np.asarray(np.memmap(self.file, np.uint8, "r", shape=(int((sizes + 1).sum()),)))
        self.file.close()
        offset = np.cumsum(sizes + 1) - sizes - 1
        windows = sizes - self.length + 1
        weight = np.zeros(len(text), np.int32)  # of the windows by their first byte; 0: no whole window
        edges = np.zeros(len(text) + 1, np.int8)
        edges[offset] = np.minimum(places, 2)
        edges[offset + windows] = -np.minimum(places, 2)
        np.cumsum(edges[:-1], out=weight)
        del edges
        order, shared = suffixes(text, self.length)
        first = np.flatnonzero(np.append(True, shared[:-1] < self.length))
        total = np.add.reduceat(weight[order], first)
        again = np.repeat(total >= 2, np.diff(np.append(first, len(order))))
        flags = np.zeros(len(text) + 1, np.int8)
        flags[order[again]] = 1
        flags[:-1][weight == 0] = 0
        change = np.diff(flags, prepend=np.int8(0))
        low, high = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        piece = np.searchsorted(offset, low, side="right") - 1
        ids = list(self.number)
        used, counts = np.unique(piece, return_counts=True)
        spans = pa.StructArray.from_arrays(
            [pa.array((low - offset[piece]).astype(np.int32)), pa.array((high - offset[piece]).astype(np.int32))], names=["a", "b"])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[k] for k in used.tolist()], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)], names=["id", "spans"])


def sorted_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for batch in batches:
            for number, own, piece, places in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    if shard:
                        yield shard.repeated()
                    shard, now = Shard(length), number
                shard.add(own, piece, places)
        if shard:
            yield shard.repeated()
    return run


def cuts(starts: list[int], spans: list[list[tuple[int, int]]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows."""
    ranges = sorted((s + r["a"], s + r["b"] - 1 + length) for s, own in zip(starts, spans) for r in own)
    found: list[list[int]] = []
    for low, high in ranges:
        if found and low <= found[-1][1]:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    return [tuple(f) for f in found]


def pieces_cut(different: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, n, h, s and bytes of the pieces (h, at) of ``wanted``, from the texts."""
    return (different.join(wanted, "key")
            .select("key", "n", F.encode("text", "UTF-8").alias("bytes"), F.explode("pieces").alias("p"))
            .select("key", "n", "p.h", F.floor(F.col("p.at") / MOST_WINDOWS).alias("s"), "bytes",
                    (F.col("p.at") % MOST_WINDOWS + length).cast("int").alias("size"))
            .select("key", "n", "h", "s", F.substring("bytes", (F.col("s") + 1).cast("int"), F.col("size")).alias("piece")))


def divided(each: DataFrame, last: bool) -> DataFrame:
    """key, n, and lists of the pieces (key, n, h, at, again) that may hold repeated windows: usual ones, and hot ones unless last."""
    often = (each.groupBy("h").agg(F.sum("n").alias("places"), F.count("*").alias("texts"), F.max("again").alias("again"))
             .where("places > 1 or again").select("h", "texts"))
    hot, own = (F.col("texts") >= HOT_TEXTS) & F.lit(not last), F.struct("h", "at")
    return each.select("key", "n", "h", "at").join(often, "h").groupBy("key", "n").agg(
        F.collect_list(F.when(~hot, own)).alias("pieces"), F.collect_list(F.when(hot, own)).alias("hot"))


def dealt_pieces(texts: DataFrame, different: DataFrame, length: int) -> tuple[DataFrame, int]:
    """key, n, h, s, piece and id of all pieces that may hold repeated windows, and how many shards they fill."""
    size = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["at"] % MOST_WINDOWS + length)
    with scratch(texts.sparkSession):
        rows = cut(piece_rows(texts, length).where(F.size("pieces") > 0)
                   .groupBy("key").agg(F.first("pieces").alias("pieces"), F.count("*").alias("n")))
        wanted = cut(divided(rows.select("key", "n", F.inline("pieces")), last=False), kept=True)
        parts = [wanted]
        total, hot = wanted.agg(F.sum(size), F.sum(F.size("hot"))).first()
        for width in CORES:  # for grams in very many texts only
            if not hot:
                break
            pieces = pieces_cut(different, parts[-1].where(F.size("hot") > 0).select("key", "n", F.col("hot").alias("pieces")), length)
            each = cut(pieces.select("key", "n", "s", "piece").mapInArrow(tidy(dealt_anew(length, width)), "key binary, n long, h long, at long"))
            parts.append(cut(divided(each.withColumn("again", F.lit(False)), width == CORES[-1]), kept=True))
            more, hot = parts[-1].agg(F.sum(size), F.sum(F.size("hot"))).first()
            total = (total or 0) + (more or 0)
    wanted = reduce(DataFrame.unionByName, [p.where(F.size("pieces") > 0).select("key", "n", "pieces") for p in parts])
    return (pieces_cut(different, wanted, length).withColumn("id", F.unhex(F.md5("piece"))),
            max(1, -(-(total or 0) // SHARD_BYTES)))


def texts_without_repeats(texts: DataFrame, length: int = LENGTH, digests: bool = False) -> DataFrame:
    """For each different text of (key, text): key, n_bytes, n_removed, n_spans and the kept bytes or their SHA-256.

    key must be a function of the text.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}")
    # no key is null; said here, it is the same filter in every use, so that Spark shuffles the texts once
    texts = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).where(F.col("key").isNotNull())
    different = texts.groupBy("key").agg(F.first("text").alias("text"))
    placed, shards = dealt_pieces(texts, different, length)
    dealt = placed.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "id", "piece", F.col("n").alias("places"))
    repeats = (dealt.mapInArrow(tidy(merged), dealt.schema).repartition("shard").sortWithinPartitions("shard")
               .mapInArrow(tidy(sorted_shards(length)), "id binary, spans array<struct<a: int, b: int>>"))
    gone = (placed.select("key", "s", "id").join(repeats, "id").groupBy("key")
            .agg(F.collect_list(F.struct("s", "spans")).alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            columns: list[list] = [[], [], [], []]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                ranges = cuts([g["s"] for g in own or ()], [g["spans"] for g in own or ()], length)
                ends = [0, *(x for r in ranges for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for c, v in zip(columns, (len(data), len(data) - len(kept), len(ranges),
                                          hashlib.sha256(kept).hexdigest() if digests else kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digests else pa.binary())],
                names=["key", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digests else "kept"
    return different.join(gone, "key", "left").mapInArrow(tidy(run), f"key binary, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256."""
    text = column(text_column).cast("string")
    rows = docs.select(column(id_column).alias("_id"), text_key(text).alias("key"), text.alias("text"))
    found = texts_without_repeats(rows.select("key", "text"), length, digests=True)
    return (rows.select("_id", "key").join(found, "key")
            .select(F.col("_id").alias(id_column), "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def without_repeats(docs: DataFrame, text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """docs, all columns, with the kept bytes as text; a character cut in two goes whole, null stays null."""
    text = column(text_column).cast("string")
    key, kept = unused(docs.columns, "_key"), unused(docs.columns, "_kept")
    found = (texts_without_repeats(docs.select(text_key(text).alias("key"), text.alias("text")), length)
             .select(F.col("key").alias(key), whole("kept").alias(kept)))
    names = [F.when(text.isNotNull(), column(kept)).alias(c) if c == text_column else column(c) for c in docs.columns]
    return docs.withColumn(key, text_key(text)).join(found, key).select(*names)


def whole(data: str) -> Column:
    @F.pandas_udf("string")
    def decoded(values):
        return values.map(lambda b: bytes(b).decode("utf-8", "ignore"))
    return decoded(F.col(quoted(data)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
