"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.session import cut


#: Links of a node that are too many for one task of a join, and the most such nodes that are broadcast.
HUB = 100_000
BROADCAST_ROWS = 500_000


def _with_least(links: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """``links`` (u, v) with m of their u; ``size`` is a bound of the number of links, and so of a node's."""
    m = least.select("u", "m")
    if size <= HUB:
        return links.join(m, "u")
    hubs = cut(least.where(F.col("n") > HUB).select("u", "m"))
    few = hubs.limit(BROADCAST_ROWS + 1).count()
    if not 0 < few <= BROADCAST_ROWS:
        return links.join(m, "u")
    rest = links.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(m, "u")
    return rest.unionByName(links.join(F.broadcast(hubs), "u").select(*rest.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds: a node hands its larger (then its smaller)
    neighbours to its smallest one. Each round is two shuffles of at most the edge count, and the
    number of rounds grows with the logarithm of the longest path. Per-node work is a minimum, which
    is combined before the shuffle, and an equi-join back, so no neighbour list is gathered. Nodes with over ``HUB`` links,
    such as the root of a large component, would meet all their links in one task of that join: there are few of them, and
    they are joined by broadcast instead.
    Self-loops and nulls are dropped; an empty edge list gives an empty result.
    """
    two = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut(two.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature, size = None, links.count()
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, small_least, size)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        row = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if (row.n, row.s) == signature:
            break
        signature, size = (row.n, row.s), row.n
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
