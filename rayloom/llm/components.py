"""Connected components of an undirected graph as DataFrame joins.

Large-star and small-star steps alternate until the edges no longer change; the
result is a star around the smallest node of each component. Minima are taken
with a partially aggregated ``groupBy``, written, and joined back: both sides of
the join are shuffled tables then, whose large partitions Spark splits, so a node
with very many neighbours neither meets in one task nor is multiplied.

Defined results for odd input: repeated links count once, a link from a node to
itself and a link with a null end are left out, and no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayloom.llm.common import materialise


def _edges(df: DataFrame) -> DataFrame:
    """Distinct edges from the larger node ``a`` to the smaller node ``b``."""
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("differ")).filter("differ").select("a", "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("m")), "components-least")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of those."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is its component's least node."""
    edges = materialise(_edges(links), "components")
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = materialise(_edges(_small_star(_edges(_large_star(edges)))), "components")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
