"""Connected components of a distributed edge table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.filter("v > u").join(least, "u").selectExpr("v AS u", "m AS v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").filter("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v")
    return others.union(least.selectExpr("u", "m AS v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not its component's smallest node.

    ``edges`` has long columns ``u, v``. The smallest node of a component is the root and has no
    row. Edges are only ever aggregated to minima and joined, so a hub does not meet in one task.
    """
    current = materialise(_small_star(edges), "components")
    state = _fingerprint(current)
    while state[0]:
        current = materialise(_small_star(_large_star(current)), "components")
        previous, state = state, _fingerprint(current)
        if state == previous:
            break
    return current.selectExpr("u AS node", "v AS root")
