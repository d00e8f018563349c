"""Approximate nearest neighbours by collision counting over sorted single projections.

Nearness is the inner product.  One more coordinate makes it a distance: with M the largest
norm of all vectors, (x, sqrt(M^2 - |x|^2)) lies the nearer to a query scaled to norm M, the
larger the product.  Every vector is projected on ``PROJECTIONS`` random directions, and the
values of each direction are kept sorted.  A query starts with a narrow window around its own
value on every direction and widens all windows step by step (a wider window is a coarser hash,
read off the same sorted array).  Vectors inside ``THRESHOLD`` of the windows are verified by
their exact product.  Widening ends only when the k-th best is so near that windows this wide would
have met anything nearer (by ``MARGIN``), or when the windows have no end and all vectors are verified.

The vectors are indexed in blocks of about ``BLOCK`` rows, all of them; queries meet every
block in groups of about ``QUERY_BLOCK``, which pass through its index one after the other.  The best of
each block are merged in stages, so no query gathers more than ``k * MERGED`` rows in one step.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null
id take no part.  Rows that share an id are vectors of their own: each is a candidate for all others, and
each that asks gets its own answer.  Only vectors of equal length are compared.  The index works on vectors
divided by a power of two near the largest component, so that no norm overflows; scores are those of the
original vectors and can be infinite.  Ties go to the smaller id.  Fewer candidates than k give all.
An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import column, groups, tidy

NEIGHBOURS = 20
PROJECTIONS = 48
THRESHOLD = 0.68
#: Half widths of the windows relative to the largest norm: the first, and the factor from one to the next.
FIRST, WIDER, LEVELS = 0.8, 1.25, 7
#: A normal value lies inside this many deviations with a probability of THRESHOLD.
DEVIATIONS = 0.9945
#: The k-th best ends the search if it is nearer by this factor than what the windows meet on average.
MARGIN = 1.2
ROUNDING = 1e-9
BLOCK, QUERY_BLOCK, MERGED = 8_192, 8_192, 64
#: Queries searched at once.
ASKED_AT_ONCE = 256
EVERY = 20


def usable(vector: Column) -> Column:
    """Whether a vector has a length and only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(size: int) -> np.ndarray:
    """Random rotations, as many as give PROJECTIONS directions, scaled to unit variance."""
    own = np.random.Generator(np.random.PCG64(size))
    parts = [np.linalg.qr(own.standard_normal((size, size)))[0] * np.sqrt(size) for _ in range(-(-PROJECTIONS // size))]
    return np.hstack(parts)[:, :PROJECTIONS]


class Index:
    """The vectors of a block: row numbers (of the table), ids and components, and their sorted projections.

    largest: the largest norm of all vectors divided by ``unit``.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, unit: float, largest: float):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.vectors, self.largest = rows[order], ids[order], vectors[order], largest
        self.scaled = self.vectors / unit
        rest = np.sqrt(np.maximum(largest ** 2 - (self.scaled ** 2).sum(axis=1), 0))
        self.way = directions(vectors.shape[1] + 1)
        values = np.hstack([self.scaled, rest[:, None]]) @ self.way
        self.places = np.argsort(values, axis=0).T.copy()
        self.sorted = np.take_along_axis(values.T, self.places, axis=1)

    def search(self, asking: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row that asks, ids, scores) of the best found for each query."""
        n = len(self.ids)
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        centre = (unit * self.largest) @ self.way[:-1]
        half = self.largest * FIRST * WIDER ** np.arange(LEVELS)
        low = np.empty((LEVELS, *centre.shape), np.int32)
        high = np.empty_like(low)
        for p, values in enumerate(self.sorted):
            low[:, :, p] = np.searchsorted(values, centre[None, :, p] - half[:, None], side="left")
            high[:, :, p] = np.searchsorted(values, centre[None, :, p] + half[:, None], side="right")
        least = THRESHOLD * PROJECTIONS
        for q, (own, vector) in enumerate(zip(asking, queries)):
            counts = np.zeros(n, np.int64)
            done = self.rows == own  # its own row takes no part
            score = np.full(n, -np.inf)  # products with the query of norm 1
            a0 = b0 = None
            for level in range(LEVELS + 1):
                if level < LEVELS:
                    a, b = low[level, q], high[level, q]
                    if a0 is None:
                        parts = [r[x:y] for r, x, y in zip(self.places, a, b)]
                    else:
                        parts = [r[x:y] for r, x, y in zip(self.places, a, a0)] + [r[x:y] for r, x, y in zip(self.places, b0, b)]
                    a0, b0 = a, b
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                    new = np.flatnonzero((counts >= least) & ~done)
                else:
                    new = np.flatnonzero(~done)  # windows without end
                done[new] = True
                score[new] = np.einsum("ij,j->i", self.scaled[new], unit[q])
                if level < LEVELS and np.count_nonzero(done) > k:
                    kth = np.partition(score, -k)[-k] * self.largest
                    if np.sqrt(max(2 * self.largest ** 2 - 2 * kth, 0)) * MARGIN <= half[level] / DEVIATIONS:
                        break
            # the nearest, and any within rounding of them, in one fixed order of summation
            last = np.partition(score, -k)[-k] if n > k else -np.inf
            near = np.flatnonzero((score >= last - ROUNDING * self.largest) & (score > -np.inf))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (self.vectors[near] * vector).sum(axis=1)
            best = np.lexsort((self.ids[near], -exact))[:k]
            yield int(own), self.ids[near[best]], exact[best]


def nearest(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best found for each vector where ``queries`` (on ``_id``) holds."""
    rows = cut(vectors.select(column(id_column).cast("long").alias("_id"), column(vector_column).cast("array<double>").alias("_v"))
               .where(F.col("_id").isNotNull() & usable(F.col("_v")))
               .withColumn("_row", F.monotonically_increasing_id())
               .withColumn("_size", F.size("_v")).withColumn("_query", F.coalesce(queries, F.lit(False))))
    top = rows.agg(F.max(F.aggregate("_v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0] or 1.0
    unit = 2.0 ** math.frexp(top)[1] if math.frexp(top)[1] < 1024 else 2.0 ** 1023
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x / unit * (x / unit)))
    sizes = (rows.groupBy("_size").agg(F.max(norm).alias("_largest"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"),
                                       F.greatest(F.lit(1), F.ceil(F.count_if("_query") / QUERY_BLOCK)).cast("int").alias("_groups")))
    rows = rows.join(sizes, "_size")
    block = F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int")
    group = F.pmod(F.xxhash64("_row", F.lit(1)), F.col("_groups")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    last = ["_row", "_id", "_v", "_largest"]
    held = rows.select("_size", block.alias("_block"), every("_groups").alias("_group"), F.lit(0).alias("_asks"), *last)
    asked = rows.where("_query").select("_size", every("_blocks").alias("_block"), group.alias("_group"), F.lit(1).alias("_asks"), *last)

    def vectors_of(batch: pa.Table, size: int) -> np.ndarray:
        return np.vstack([c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in batch["_v"].chunks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = now = None
        for (size, block_, group_, asks), own in groups(batches, 4):  # a block's vectors come before the queries
            if not asks:
                now = (size, block_, group_)
                index = Index(own["_row"].to_numpy(), own["_id"].to_numpy(), vectors_of(own, size), unit, own["_largest"][0].as_py())
            elif now == (size, block_, group_):
                for at in range(0, own.num_rows, ASKED_AT_ONCE):
                    part = own.slice(at, ASKED_AT_ONCE)
                    for row, found, scores in index.search(part["_row"].to_numpy(), vectors_of(part, size), k):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), row)), pa.array(np.full(len(found), block_, np.int32)), pa.array(found), pa.array(scores)],
                            names=["row", "part", "vec_id", "score"])

    by = ["_size", "_block", "_group"]
    found = (held.union(asked).repartition(*by).sortWithinPartitions(*by, "_asks")
             .mapInArrow(tidy(run), "row long, part int, vec_id long, score double"))
    parts = sizes.agg(F.max("_blocks")).first()[0] or 1
    order = [F.col("score").desc(), F.col("vec_id")]
    while parts > MERGED:
        parts = -(-parts // MERGED)
        place = F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))
        found = (found.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))
                 .withColumn("place", place).where(F.col("place") <= k).drop("place"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    asking = rows.where("_query").select(F.col("_row").alias("row"), F.col("_id").alias("query_id"))
    return best.join(asking, "row").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("_id") % EVERY == 0)
