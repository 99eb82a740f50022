"""Connected components by alternating large-star and small-star steps, all of them joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, written

#: Nodes of more edges than this, and than a HUBS-th of all (each counted at both ends), are hubs. So there are HUBS at most, and their least neighbours go out by broadcast.
HUB_EDGES, HUBS = 10_000, 50_000
#: Edges that one task takes. So few need no shuffle: the same steps run over one partition. More are dealt by node.
ONE_TASK = 200_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges (a, b) with m of their a, from least (a, m, k). Edges of hubs (k > hub) stay where they are, so none gathers in one task."""
    hubs = F.broadcast(least.where(F.col("k") > hub).select("a", F.col("m").alias("hub")))
    both = edges.join(hubs, "a", "left")
    rest = both.where("hub is null").select("a", "b").join(least.where(F.col("k") <= hub).select("a", "m"), "a")
    return both.where("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(rest)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _dealt(edges: DataFrame, few: bool) -> DataFrame:
    """Edges so that those of one a are in one partition."""
    return edges.coalesce(1) if few else edges.repartition("a")


def _large_star(edges: DataFrame, hub: int | None, few: bool) -> DataFrame:
    """Each node's larger neighbours point to the least of it and its neighbours. Without hubs (hub is None), one shuffle brings a node's edges together."""
    both = _both_ways(edges)
    both = both if hub else _dealt(both, few)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("k"))
    larger = both.where("b > a")
    found = _with_least(larger, least, hub) if hub else larger.join(least.select("a", "m"), "a")
    return found.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. After a large star, a node has few smaller neighbours, so they come together in one shuffle."""
    down = _dealt(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), few)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b")
    return (out.coalesce(1) if few else out).distinct()


def _is_stars(edges: DataFrame, few: bool) -> bool:
    """Whether each node that has edges at its first end has one, and none at its second."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = (ends.coalesce(1) if few else ends).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0] in (None, False)


def components(edges: DataFrame, hub_edges: int = HUB_EDGES, rows: int | None = None) -> DataFrame:
    """(node, comp) of all nodes with an edge: comp is the least node of the component. edges: (a, b), repeats and loops allowed, `rows` of them at most. It stands on one table of
    `written`, which `discard` takes.

    Ends when each component is a star around its least node. Rounds grow with the logarithm of a component's size.
    """
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written((down.coalesce(1) if rows is not None and rows <= ONE_TASK else down).distinct(), "star", rows)
    while True:
        n = now.count()
        few = n <= ONE_TASK
        if _is_stars(now, few):
            break
        hub = max(hub_edges, 2 * n // HUBS)
        most = _both_ways(now).groupBy("a").count().agg(F.max("count")).first()[0] if n > hub else 0
        hub = hub if most > hub else None
        # a round keeps no more edges than it reads, but for one a node
        old, now = now, written(_small_star(_large_star(now, hub, few), few), "star", 2 * n)
        discard(old)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("comp")))
    out._kindred_path = now._kindred_path
    return out
