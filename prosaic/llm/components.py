"""Connected components of an edge table by alternating large-star and small-star steps, all on executors.

A node of many edges, as the smallest of a large component becomes, would bring
them all into one task of the large-star's join. Nodes with more than a quarter of
a partition's share of the edges are few, at most eight a partition, each edge
having two ends. They are counted first; where there are any, their edges stay
where they are and what is joined is broadcast. All other edges are joined by
shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosaic.llm.scratch import Scratch, partitions

#: Steps after which something must be wrong: they grow with the logarithm of the longest path.
MOST_ROUNDS = 60
#: A node is never called hot for fewer edges than this.
LEAST_HOT = 1000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hot(edges: DataFrame, number: int) -> list[int]:
    """Nodes of so many of the edges that they would burden a task; at most 8 a partition."""
    limit = max(LEAST_HOT, number // (4 * partitions(edges.sparkSession)))
    return [r["a"] for r in _both(edges).groupBy("a").count().filter(F.col("count") > limit).select("a").collect()]


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges, edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame, hot: list[int]) -> DataFrame:
    """Each node's larger neighbours are linked with its smallest neighbour (or itself)."""
    both = _both(edges)
    if hot:
        own, least = _with_least(both.filter(F.col("a").isin(hot)))
        rest, few = _with_least(both.filter(~F.col("a").isin(hot)))
        joined = own.join(F.broadcast(least), "a").unionByName(rest.join(few, "a"))
    else:
        rest, few = _with_least(both)
        joined = rest.join(few, "a")
    joined = joined.withColumn("m", F.least("a", "m"))
    return joined.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down, least = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    joined = down.join(least, "a")
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root for each node of edges (a, b: bigint, a <> b); root is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short and lost
    executors cost one round. Tables hold one row per edge that is left, and no
    group is gathered in one place. An error is raised if it doesn't end.
    """
    now = scratch.save(edges.filter("a <> b").distinct(), f"{name}-0")
    number, before = now.count(), None
    for k in range(1, MOST_ROUNDS + 1):
        now = scratch.save(_small_star(_large_star(now, _hot(now, number))), f"{name}-{k}")
        number, checked = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (number, checked) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        before = number, checked
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
