"""Connected components of a graph given as pairs of node numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import checkpoint


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every node of edges(a, b): root is the smallest number of its component.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest one it
    knows, then its smaller ones. The edges never grow, a component ends as a star around its root, and the
    number of rounds follows the logarithm of the longest path. Only minima are gathered for a node, which combine
    before the shuffle; joins of a hub with its edges are plain shuffle joins, whose partitions Spark can split.
    """
    current = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = current.union(current.select("b", "a"))
        lowest = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(lowest, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(floor, F.col("a") == F.col("u")).select("a", "b", "m")
        current = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        current = checkpoint(current)
        now = _state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still changed in round {rounds}")
    roots = current.select(F.col("b").alias("v")).distinct().select("v", F.col("v").alias("root"))
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
