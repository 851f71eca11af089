"""Connected components of a graph in a table, by falling labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b) of integers; the root is the least id it is linked to.

    Each round takes the least label among neighbours and then the label's own label, so long chains
    halve. Tables are written between rounds; both sides of each join are plain tables, so
    Spark can split a node with very many edges. Nothing but one sum per round reaches the driver.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:
            return labels
        total = now
        near = both.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "root")
        least = stored(near.union(labels).groupBy("id").agg(F.min("root").alias("root")), "labels")
        upper = least.select(F.col("id").alias("__up"), F.col("root").alias("__top"))
        labels = stored(least.join(upper, F.col("root") == F.col("__up")).select("id", F.least("root", "__top").alias("root")), "labels")


def forest(a, b, names) -> list[tuple[int, int]]:
    """Pairs (member, least member) that hold the same connections as the edges a-b of positions in
    ``names``; at most one per member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            if names[y] < names[x]:
                x, y = y, x
            parent[y] = x
    return [(names[x], names[root(x)]) for x in parent]
