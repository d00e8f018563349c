"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become pieces of at most one capacity.  Pieces are sorted by length and numbered
within each length; open sequences are kept sorted by their gap.  Equal lengths and equal
gaps travel as runs (value, first rank, count), so the state of a round has at most one run
per length and gap however many rows there are.  A round takes the longest lengths left:
every piece looks up its successor, the smallest gap that holds it; if more pieces than gaps
meet, the lower ranks get the gaps and the others go on to the next larger gap or open new
sequences; the gaps shrink, and the rounds go on.  The rows themselves stay distributed:
a piece finds its place by its length and rank.

Null and empty texts are one piece with the end id alone.  Repeated rows and equal doc_ids
are separate documents.  Which of several equal pieces goes to which place is not fixed; the
layout of lengths is.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import column, hold, portions, quoted, tidy

CAPACITY = 2048
END_ID = 0
#: Words remembered between portions of text in one worker.
REMEMBERED_WORDS = 250_000
#: Rows of one length that one task numbers, about.
ROWS_PER_TASK = 50_000
LETTERS = "a-zªµºß-öø-ÿ"
SPACES = " \t\n\x0b\x0c\r\x85\xa0"
WORD = re.compile(f"[{LETTERS}]+")
RUNS = re.compile(f"[{LETTERS}]+|[^{LETTERS}{SPACES}]+")


class Words(dict):
    """Ids of a word in little-endian bytes; a new word is asked of the library once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        own = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x100)) if WORD.fullmatch(c)})
        self.ask, self.model = own.encode, own.model

    def __missing__(self, word: str) -> bytes:
        if WORD.fullmatch(word):  # one whole word for the library, which spells bytes as characters
            found = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.shown))]
        else:
            found = self.ask(word, add_special_tokens=False).ids
        ids = array("I", found).tobytes()
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Ids:
    """Ids of whole texts, word by word.

    The pre-tokenizer never joins a letter with another character but after an apostrophe, so
    a Latin-1 text without one (and without special tokens) is cut into runs of letters and of
    others; any other text is cut at spaces and line ends only.
    """

    def __init__(self, path: str):
        self.words = Words(path)

    def split(self, text: str) -> list[str]:
        if "'" not in text and "<|" not in text:
            try:
                text.encode("latin-1")
                return RUNS.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return [w for w in text.replace("\n", " ").split(" ") if w]

    def __call__(self, texts: list[str]) -> list[bytes]:
        hold(self.words)
        return [b"".join(map(self.words.__getitem__, self.split(t))) for t in texts]


@cache
def tokenizer(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Ids(path)


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces: id, piece, start, length, ids_crc32, and the ids if asked for."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"{quoted(id_column)} {kind}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(model)
        for batch in batches:
            row = 0
            for texts in portions(batch.column(1)):
                rows: list[int] = []
                out: list[list] = [[], [], [], [], []]
                for ids in own(texts):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append(row)
                        for column_, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column_.append(value)
                    row += 1
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in out[1:4])]
                names = [id_column, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4") for p in out[4]], pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(column(id_column), column(text_column).cast("string")).mapInArrow(tidy(run), schema + ", ids array<int>" * with_ids)


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of places: (length, first rank, count, first sequence, offset).

    counts: pieces of each length.  Its size, and that of all state here, is bounded by the
    capacity, not by the number of pieces.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []  # gaps there are, sorted
    opened = 0
    places: list[tuple[int, int, int, int, int]] = []

    def give_back(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):  # the successor: the smallest gap that holds the length
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                taken = min(count, left)
                places.append((length, rank, taken, first, capacity - gap))
                give_back(gap, first + taken, count - taken)
                give_back(gap - length, first, taken)
                rank, left = rank + taken, left - taken
                continue
            fit = capacity // length
            full, rest = divmod(left, fit)
            for some, layers in ((full, fit), (1, rest)):
                if some and layers:
                    for layer in range(layers):
                        places.append((length, rank, some, opened, layer * length))
                        rank, left = rank + some, left - some
                    give_back(capacity - layers * length, opened, some)
                    opened += some
    return places


def pack(parts: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """Rows of ``parts`` with sequence_id and offset.  It is read several times: pass a written table.

    Rows with a null length get no place (null); a length below 1 or above the capacity raises.
    """
    spark = parts.sparkSession
    length = column(length_column)
    rows = parts.withColumn("_spread", F.pmod(F.xxhash64(*[column(c) for c in parts.columns]), F.lit(1 << 20)).cast("int"))
    totals = {r[0]: r[1] for r in parts.where(length.isNotNull()).groupBy(length.cast("int")).count().collect()}
    if any(not 0 < n <= capacity for n in totals):
        raise ValueError("lengths must lie between 1 and the capacity")
    shares = max(1, -(-max(totals.values(), default=0) // ROWS_PER_TASK)) * 8
    rows = rows.withColumn("_share", F.pmod("_spread", F.lit(shares))).drop("_spread")
    by = ["_length", "_share"]
    rows = rows.withColumn("_length", length.cast("int"))
    before = (rows.where("_length is not null").groupBy(*by).agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(
                  Window.partitionBy("_length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)))
              .select(*by, F.coalesce("_before", F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy(*by).orderBy(*[column(c) for c in parts.columns])) - 1
    ranked = (rows.withColumn("_within", within).join(before, by, "left")
              .withColumn("_rank", F.col("_before") + F.col("_within")))
    # places: bounded by the capacity (see rounds)
    places = F.broadcast(spark.createDataFrame(
        rounds(totals, capacity), "_l int, _first long, _count long, _sequence long, _offset long"))
    return (
        ranked.join(places, (F.col("_length") == F.col("_l")) & (F.col("_rank") >= F.col("_first"))
                    & (F.col("_rank") < F.col("_first") + F.col("_count")), "left")
        .select(*[column(c) for c in parts.columns],
                (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
                F.col("_offset").alias("offset"))
    )


def packed(docs: DataFrame, model: str, **options) -> DataFrame:
    return pack(cut(pieces(docs, model, **options)), options.get("capacity", CAPACITY))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
