"""Connected components by alternating large-star and small-star, as DataFrame joins.

Each star takes a node's least neighbour by a pre-aggregated ``min``, so a hub sends one row a task. The
minima are written before they are joined back to the edges: both sides of that join then come from a
shuffle of their own, which lets adaptive execution split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    return (
        both.join(least, both.u == least.k)
        .where("v > u AND v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
    star = edges.join(least, edges.u == least.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link to another; component: its least reachable node.

    Links are undirected; loops, repeated links and links with a null end are ignored. Nodes without
    links don't appear, and an empty table gives an empty table. Each round is written to the shared
    folder, so a lost executor costs no more than that round. Rounds grow with the logarithm of the
    longest path; more than ``max_rounds`` raise a RuntimeError instead of returning unsettled labels.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(
        links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"
    )
    state = _state(edges)
    if not state[0]:
        return _nodes(edges)
    for _ in range(max_rounds):
        large = written(_large_star(edges), "large")
        new = written(_small_star(large), "edges")
        drop_written(large)
        now = _state(new)
        drop_written(edges)
        edges = new
        if now == state:
            return _nodes(edges)
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _nodes(stars: DataFrame) -> DataFrame:
    centres = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres.select("v", "v"))


def _state(edges: DataFrame) -> tuple[int, int]:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(F.col("u") % 1000003 * 31 + F.col("v") % 1000003), F.sum(F.shiftright(h, 20))).first()
    return tuple(int(x or 0) for x in row)
