"""Centroid clustering in whole numbers, with distances to fixed pivots as bounds (LAESA).

Components become integers, so that assignments, means and distances are exact.  The distances
of every vector to ``PIVOTS`` fixed vectors are computed once and written with it.  In each round the
distances of the pivots to the centroids are computed; by the triangle inequality the largest
difference of the two distances to a pivot is a lower bound for that of vector and centroid.  The
centroid with the smallest bound is measured first; of the others only those whose bound does not exceed
what was found are measured.  Bounds are doubles, lowered by more than their rounding; what is
measured is an exact integer, so ties go to the smaller number for certain.

Each task adds up its vectors by centroid; the sums of all tasks (a row per centroid and task)
are added up by Spark, so a cluster with most of the rows costs no more than another.  The driver
sees the centroids and the pivots only, whose number is a parameter.

Vectors that are null, of another length, or hold null or non-finite components are left out.
Repeated rows and equal or null ids are separate vectors (a null id hashes as an empty one).  Fewer
vectors than centroids give as many centroids as vectors; an empty table gives no rows.  Components
beyond 2**24 are computed as Python integers instead of 64-bit ones; a distance or sum beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import column, tidy

SIZE, SCALE, CLUSTERS, ROUNDS, SEED, PIVOTS = 64, 64, 16, 3, 1, 16
#: Bounds are lowered by this share of the distances they come from.
SLACK = 1e-9
#: Vectors worked on at once.
ROWS = 4096
#: Components up to this size have distances and sums of a task that fit 64 bits.
SMALL = 1 << 24
LIMB = 40
EXACT = "decimal(38,0)"


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has so many components, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python integers where 64 bits are not enough for sums of squares."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0) <= SMALL:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise OverflowError("a component is too large to be scaled")
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector and point in rows that belong together."""
    d = vectors - points
    return (d * d).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def number(values: np.ndarray, small: bool) -> np.ndarray:
    return values if small else values.astype(object)


class Centroids:
    """The centroids of a round, and their distances to the pivots."""

    def __init__(self, centres: list[tuple[int, ...]], pivots: list[tuple[int, ...]]):
        self.small = all(abs(x) <= SMALL for p in (*centres, *pivots) for x in p)
        self.centres = np.array(centres, np.int64 if self.small else object)
        self.to_pivots = np.array([[sum((a - b) ** 2 for a, b in zip(c, p)) ** 0.5 for p in pivots] for c in centres])

    def nearest(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many distances were computed."""
        vectors, centres = number(vectors, self.small), number(self.centres, vectors.dtype != object)
        n = len(vectors)
        bound = np.zeros((n, len(self.centres)))
        for p in range(to_pivots.shape[1]):
            a, b = to_pivots[:, p, None], self.to_pivots[None, :, p]
            np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
        best = bound.argmin(axis=1)
        distance = squared(vectors, centres[best])
        limit = roots(distance) * (1 + SLACK)
        measured = n
        first = best.copy()
        for c in range(len(self.centres)):  # in order, so that a tie stays with the smaller number
            rows = np.flatnonzero((bound[:, c] <= limit) & (first != c))
            if not len(rows):
                continue
            measured += len(rows)
            found = squared(vectors[rows], centres[c])
            nearer = (found < distance[rows]) | ((found == distance[rows]) & (c < best[rows]))
            rows = rows[nearer]
            best[rows], distance[rows] = c, found[nearer]
            limit[rows] = roots(distance[rows]) * (1 + SLACK)
        return best, distance, measured


def vectors_of(column_: pa.ListArray, size: int) -> np.ndarray:
    return column_.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def pivot_rows(rows: DataFrame, pivots: list[tuple[int, ...]], size: int, scale: int) -> DataFrame:
    """rows (id, v) with to_pivots: the distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            values = whole(vectors_of(batch.column(1), size), scale)
            small = values.dtype != object and all(abs(x) <= SMALL for p in pivots for x in p)
            points = np.array(pivots, np.int64 if small else object)
            found = np.stack([roots(squared(number(values, small), p)) for p in points], axis=1)
            ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["id", "v", "to_pivots"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, to_pivots array<double>")


def each_assigned(batches: Iterator[pa.RecordBatch], now: Centroids, size: int, scale: int):
    """Batch, integers, cluster and squared distance, for parts of (id, v, to_pivots)."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        values = whole(vectors_of(batch.column(1), size), scale)
        best, distance, _ = now.nearest(values, vectors_of(batch.column(2), now.to_pivots.shape[1]))
        yield batch, values, best, distance


def limbs(value: int) -> list[int]:
    """An integer in parts of LIMB bits, lowest first, the last with the sign; a sum of parts fits a long."""
    found = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        found.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*found, value]


def sums(rows: DataFrame, now: Centroids, size: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum by component of each cluster that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(now.centres), np.int64), np.zeros((len(now.centres), size), object)
        for _, values, best, _ in each_assigned(batches, now, size, scale):
            for c in np.unique(best).tolist():
                own = values[best == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0)
        parts = [(c, k, at, part) for c in np.flatnonzero(count).tolist() for k, value in enumerate([*total[c].tolist(), int(count[c])])
                 for at, part in enumerate(limbs(int(value)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[x] for p in parts], pa.int32() if x < 3 else pa.int64()) for x in range(4)], names=["cluster", "component", "limb", "part"])

    found: dict[int, list[int]] = {}
    for c, k, at, part in (rows.mapInArrow(tidy(run), "cluster int, component int, limb int, part long")
                           .groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect()):  # some rows per centroid and component
        found.setdefault(c, [0] * (size + 1))[k] += part << (LIMB * at)
    return {c: (values[-1], values[:-1]) for c, values in found.items()}


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED,
             pivots: int = PIVOTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per usable vector: id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256."""
    vector = column(vector_column).cast("array<double>")
    rows = (vectors.select(column(id_column).alias("id"), vector.alias("v")).where(usable(F.col("v"), size)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # centroids and pivots by the order of the hashes: two runs of it, one after the other
    chosen = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k + pivots).collect()
    points = [tuple(int(x) for x in whole(np.array([r["v"]], np.float64), scale)[0]) for r in chosen]
    centres, fixed = points[:k], points[k:] or points[:pivots]
    kind = rows.schema["id"].dataType.simpleString()
    if not centres:
        return rows.select(F.col("id").alias(id_column), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    table = cut(pivot_rows(rows, fixed, size, scale))
    for _ in range(rounds):
        for c, (n, total) in sums(table, Centroids(centres, fixed), size, scale).items():
            centres[c] = tuple(x // n for x in total)
    last = Centroids(centres, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance in each_assigned(batches, last, size, scale):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32)), pa.array([str(d) for d in distance.tolist()])], names=["id", "cluster", "distance"])

    assigned = cut(table.mapInArrow(tidy(run), f"id {kind}, cluster int, distance string")
                   .withColumn("distance", F.expr(f"try_cast(distance as {EXACT})")))
    shas = F.broadcast(vectors.sparkSession.createDataFrame(  # a row per centroid
        [(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(centres)], "cluster int, centroid_sha256 string"))
    complete = lambda name: F.when(F.count(name) == F.count("*"), F.try_sum(name))
    inertia = assigned.groupBy("cluster").agg(complete("distance").alias("own")).join(shas, "cluster")
    inertia = inertia.join(F.broadcast(inertia.agg(complete("own").alias("all"))))
    fitting = lambda name: F.expr(f"try_cast(`{name}` as long)")
    return (assigned.join(F.broadcast(inertia), "cluster")
            .select(F.col("id").alias(id_column), "cluster", fitting("distance").alias("distance"),
                    fitting("own").alias("cluster_inertia"), fitting("all").alias("inertia"), "centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    distance = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT".format(n=SIZE)
    parts = [f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
)""", f"""centres_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {CLUSTERS}
)"""]
    for k in range(ROUNDS + 1):
        parts.append(f"""near_{k} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT row, vec_id, v, cluster, {distance} AS d FROM kept, centres_{k}) GROUP BY row
)""")
        if k < ROUNDS:
            parts.append(f"""centres_{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM centres_{k} LEFT JOIN (
    SELECT cluster, list(floor(s / n)::BIGINT ORDER BY i) AS m FROM (
      SELECT cluster, i, sum(x)::DOUBLE AS s, count(*)::DOUBLE AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near_{k}) GROUP BY cluster, i) GROUP BY cluster)
  USING (cluster)
)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near_{ROUNDS} JOIN centres_{ROUNDS} USING (cluster)"""


SQL = _sql()
