"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm.common import sized, stash


#: Edges that a task writes; small tables need not be cut into as many files as a
#: shuffle has partitions.
TASK_EDGES = 50_000


def with_least(edges: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least ``v`` of each ``u``. The least comes from
    partial sums and is written; the join back broadcasts it while it is small, and
    beyond has a plain exchange on either side, so a hub's edges are split over tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = sized(stash(least.coalesce(tasks) if tasks else least, name))
    return edges.join(least, "u").select("u", "v", "m")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, the root being the
    component's smallest node. Each round rewires edges to the smallest
    neighbour; it ends when a round changes none. Only counts reach the driver.
    Null ends are ignored; no edges give no rows. Rounds grow with the logarithm
    of the longest chain; ``most`` is far beyond any input's."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = stash(edges.select(high.alias("u"), low.alias("v")).filter("u > v").distinct(), "edges")
    told = _sum(e)
    for _ in range(most):
        if not told[0]:
            break
        tasks = -(-2 * told[0] // TASK_EDGES)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "least", tasks).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(stash(large.coalesce(tasks), "large"), "least", tasks)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e = stash(small.coalesce(tasks), "edges")
        now = _sum(e)
        if now == told:
            break
        told = now
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(star.select("root", "root").distinct())


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
