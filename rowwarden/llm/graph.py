"""Connected components of an edge table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is a
minimum per vertex (aggregated before the shuffle) and a join back to the edges; neighbourhoods
are never gathered. A hub, with more edges than a quarter of a shuffle partition holds, would send them all to one task
of that join, so hubs are matched by broadcast; there are at most eight times as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.operators.joins import skew_join
from rowwarden.session import stored

MIN_HOT = 1000  # edges of a vertex below which it is never a hub
MAX_ROUNDS = 60  # O(log^2 n) rounds suffice; more means a broken input


def _met(rows: DataFrame, least: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` (u, v) with the least vertex ``m`` of u's neighbourhood. Hubs are matched by broadcast."""
    sizes = stored(least, "least")
    return skew_join(rows, sizes.select("u", "m"), ["u"], "inner", sizes=sizes, hot_rows=hot_rows)


def _star(edges: DataFrame, large: bool, hot_rows: int) -> DataFrame:
    """``edges`` (u > v). Large star: every greater neighbour points to the least of the
    neighbourhood. Small star: the smaller neighbours and the vertex do."""
    n = F.count(F.lit(1)).alias("n")
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), n)
        moved = _met(both.filter("v > u"), least, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), n)
        moved = _met(edges, least, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v, any order, repeats allowed) to (node, root): the least node of its component.

    Only nodes with an edge to another node appear; an empty table gives an empty one; null ends
    are no edges."""
    current = stored(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count("u"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot_rows = max(MIN_HOT, state[0] // (4 * partitions))
        current = stored(_star(_star(current, True, hot_rows), False, hot_rows), "edges")
    raise RuntimeError("components did not converge")
