"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label with a cosine of at least the threshold are linked: unit vectors at a distance
of at most sqrt(2 - 2 * threshold).  The vectors of a label go into blocks of about ``BLOCK``
rows; each block becomes a cover tree: a node's children are centres, the node's own among
them, that cover its members within half its radius, and each node knows its true covering
radius.  Two trees are walked together: a pair of nodes whose centres lie further apart than
both radii and the link distance is pruned; a pair that is near enough as a whole is counted
without visiting its members; others are split.  What reaches single vectors is decided by the
cosine itself in double precision.  The pairs found are exact.

Equal vectors of a label are one node with a count, so copies cost nothing.  Tasks return a link
count per vector and edges to one local representative each, never the pairs.  In many
dimensions the bounds prune little between vectors that are all far apart: the number of
distances then grows with the square of a label's different vectors, in blocks.

Vectors that are null, empty or zero, hold null or non-finite components, or have no label link
with nothing.  Only vectors of equal length are compared.  Rows that share an id are separate
vectors; a null id links, but is never a component id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm.common import column, groups, tidy
from phasewise.llm.components import components
from phasewise.llm.op3_nearest import usable

COSINE = 0.98
BLOCK = 2048
LEAF = 24
#: Bounds this close are not trusted; rounding of a distance stays far below.
SLACK = 1e-6


class Node:
    __slots__ = ("centre", "members", "radius", "children")

    def __init__(self, centre: int, members: np.ndarray, radius: float):
        self.centre, self.members, self.radius, self.children = centre, members, radius, []


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def cover_tree(unit: np.ndarray, rows: np.ndarray) -> Node:
    """Nested nets with halving radii over the rows, with true covering radii."""
    first = distances(unit[rows[:1]], unit[rows])[0]
    root = Node(int(rows[0]), rows, float(first.max()))
    todo = [(root, first)]
    while todo:
        node, away = todo.pop()
        if len(node.members) <= LEAF or node.radius <= SLACK:
            continue
        left, centre = node.members, node.centre
        near = away <= node.radius / 2
        while True:
            own = left[near]
            child = Node(centre, own, float(away[near].max()))
            node.children.append(child)
            todo.append((child, away[near]))
            left = left[~near]
            if not len(left):
                break
            centre = int(left[0])
            away = distances(unit[centre:centre + 1], unit[left])[0]
            near = away <= node.radius / 2
            near[0] = True
            away[0] = 0.0
    return root


class Links:
    """Link counts and local representatives of the rows of one or two blocks."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, cosine: float):
        # by a power of two, which changes no cosine and keeps squares of tiny and huge numbers in range
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.norm = np.linalg.norm(vectors, axis=1)
        self.vectors, self.unit = vectors, vectors / self.norm[:, None]
        self.weight, self.cosine = weight, cosine
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.count = np.zeros(len(vectors), np.int64)
        self.parent = list(range(len(vectors)))

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def whole(self, p: Node, q: Node) -> None:
        """Every member of p links with every other member of q."""
        total = self.weight[q.members].sum()
        self.count[p.members] += total
        if p is q:
            self.count[p.members] -= self.weight[p.members]
        else:
            self.count[q.members] += self.weight[p.members].sum()
        for k in {*p.members.tolist(), *q.members.tolist()}:
            self.join(p.centre, k)

    def exact(self, p: Node, q: Node) -> None:
        x, y = p.members, q.members
        value = self.unit[x] @ self.unit[y].T
        edge_a, edge_b = np.nonzero(np.abs(value - self.cosine) < 1e-9)
        for a, b in zip(edge_a, edge_b):
            i, j = x[a], y[b]
            value[a, b] = (self.vectors[i] * self.vectors[j]).sum() / (self.norm[i] * self.norm[j])
        linked = value >= self.cosine
        if p is q:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.count[x] += linked @ self.weight[y]
        if p is not q:
            self.count[y] += self.weight[x] @ linked
        for a, b in zip(*np.nonzero(linked)):
            self.join(int(x[a]), int(y[b]))

    def walk(self, p: Node, q: Node) -> None:
        todo = [(p, q, float(distances(self.unit[[p.centre]], self.unit[[q.centre]])[0, 0]))]
        while todo:
            p, q, apart = todo.pop()
            if apart - p.radius - q.radius > self.reach + SLACK:
                continue
            if (2 * p.radius if p is q else apart + p.radius + q.radius) < self.reach - SLACK and len(p.members) + len(q.members) > 2:
                self.whole(p, q)
            elif not p.children and not q.children:
                self.exact(p, q)
            else:
                left, right = p.children or [p], q.children or [q]
                far = distances(self.unit[[c.centre for c in left]], self.unit[[c.centre for c in right]])
                reach = np.array([c.radius for c in left])[:, None] + np.array([c.radius for c in right])[None, :]
                near = far - reach <= self.reach + SLACK
                if p is q:
                    near = np.triu(near)
                    np.fill_diagonal(near, True)
                todo += [(left[a], right[b], 0.0 if p is q and a == b else float(far[a, b])) for a, b in zip(*np.nonzero(near))]


def linked(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", label_column: str = "label",
           vector_column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id reachable) and kept."""
    rows = cut(vectors.select(
        column(id_column).alias("_id"), column(label_column).cast("string").alias("_label"),
        column(vector_column).cast("array<double>").alias("_v"))
        .withColumn("_node", F.when(F.col("_label").isNotNull() & usable(F.col("_v")), F.unhex(F.md5(
            F.concat_ws("|", "_label", F.col("_v").cast("string")))))))
    nodes = cut(rows.where("_node is not null").groupBy("_node", "_label")
                .agg(F.first("_v").alias("_v"), F.count("*").alias("_n"), F.min("_id").alias("_low")))
    nodes_sized = nodes.withColumn("_size", F.size("_v"))
    blocks = nodes_sized.groupBy("_label", "_size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    dealt = (nodes_sized.join(blocks, ["_label", "_size"])
             .withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("_label", "_size", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"),
                     "_block", "_node", "_v", "_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, size, i, j), own in groups(batches, 4):
            block = own["_block"].to_numpy()
            values = np.vstack([c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in own["_v"].chunks])
            links = Links(values, own["_n"].to_numpy(), cosine)
            sides = [np.flatnonzero(block == b) for b in sorted({i, j})]
            if any(not len(s) for s in sides):
                continue
            trees = [cover_tree(links.unit, s) for s in sides]
            links.walk(trees[0], trees[-1])
            names = own["_node"].to_pylist()
            some = np.flatnonzero(links.count > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in some], pa.binary()), pa.array([names[links.root(k)] for k in some], pa.binary()),
                 pa.array(links.count[some])], names=["a", "b", "links"])

    keys = ["_label", "_size", "_i", "_j"]
    found = cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a binary, b binary, links long"))
    roots = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("_links"))
    placed = (nodes.select("_node", "_n", "_low")
              .join(counts.withColumnRenamed("a", "_node"), "_node", "left")
              .join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), "_node", "left")
              .select("_node", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"),
                      F.coalesce("_root", "_node").alias("_root"), "_low"))
    lowest = placed.groupBy("_root").agg(F.min("_low").alias("_component"))
    result = placed.join(lowest, "_root").select("_node", "_links", "_component")
    return (rows.select("_id", "_node").join(result, "_node", "left")
            .select(F.col("_id").alias(id_column), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("_component", "_id").alias("component_id"))
            .withColumn("kept", F.coalesce(column(id_column) == F.col("component_id"), F.lit(False))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
