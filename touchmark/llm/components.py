"""Connected components by alternating stars: union-find as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchmark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node under the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    larger = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours under the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("least"))
    return least.select("a", F.col("least").alias("b")).union(
        moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is its component's least node.

    Both steps aggregate by node, with partial sums before the shuffle, and join the one row per node
    back, which adaptive execution can split for a hot node. A round ends in a written table. The
    number of rounds grows with the logarithm of the nodes; an unfinished run is an error, never a
    partial answer. Null ends and self links are no links; repeated edges count once; no edges, no rows.
    """
    directed = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, seen = stored(directed.distinct(), "edges"), None
    for _ in range(max_rounds):
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select("b", "b").distinct()
            )
        seen = tuple(state)
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
