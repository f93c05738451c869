"""Connected components by alternating star contractions, in DataFrame operations.

Every round first points all larger neighbours of a node at the smallest node of its
neighbourhood, then all smaller ones; the edge set never grows beyond its size at the
start and ends as one star for each component, after a number of rounds that is
logarithmic in the number of nodes in practice.  A node's smallest neighbour is a map-side combined
minimum, no neighbourhood is ever gathered, and each round's edges are a written
table, so lost executors cost one round at most; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node of the closed neighbourhood of u."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    sym = both_ways(edges)
    return sym.join(smallest(sym), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger node u to the smaller v."""
    joined = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v")))


def tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (columns ``a`` and ``b``, of one
    orderable type); ``root`` is the component's smallest node.  Null ends and loops
    are ignored."""
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    edges = written(tidy(ends), "edges")
    before = None
    for _ in range(max_rounds):
        last, edges = edges, written(tidy(small_star(tidy(large_star(edges)))), "edges")
        drop_table(last)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
