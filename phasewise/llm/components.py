"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut

#: Rounds grow with the logarithm of the longest path; far more means a fault.
MAX_ROUNDS = 100


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))"), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable.

    Nodes can be of any ordered type.  Null ends, loops and repeated edges are ignored.  Each
    round is a written table, so a lost executor costs a re-read.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b")
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
