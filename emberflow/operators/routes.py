"""Shortest paths over a table of weighted edges, for many sources at once, by delta-stepping.

The state of a search is a row for each source and node reached: distance, path, and whether it has changed since its
edges were last used.  Distances are dealt to buckets of ``delta``.  Rounds take the lowest bucket that has changed rows:
their light edges (``delta`` at most) are relaxed until the bucket rests, then the heavy edges of all its rows once, which
can only lead to later buckets.  Every round is one join with the edges and one grouped minimum, and is staged, so that
lineage stays short.  A search ends at its radius: the network that a source can reach within it bounds its rows.

Of paths of one length the least one (by its nodes in order) is kept, so that results don't depend on the order of rounds.
Weights are whole numbers of 0 or more; edges without a weight, or with a negative one, are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import _staged


def shortest_paths(sources: DataFrame, edges: DataFrame, radius: int, delta: int, rounds: int = 10_000) -> DataFrame:
    """(source, node, distance, path) of all nodes within ``radius`` of each source (a node), over directed edges
    (a, b, weight)."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt and sorted once for the rounds' joins, and never broadcast: Spark takes derived networks for smaller than they are
    roads = _staged(edges.where("weight >= 0 and a <> b").groupBy("a", "b").agg(F.min("weight").cast("long").alias("weight")).repartition(parts, "a").sortWithinPartitions("a"))
    heavy = bool(roads.agg(F.coalesce(F.max("weight"), F.lit(0)) > delta).first()[0])
    zero = F.lit(0).cast("long")
    now = _staged(sources.where("source IS NOT NULL").select("source").distinct().select("source", F.col("source").alias("node"), zero.alias("distance"), F.array("source").alias("path"), F.lit(True).alias("light"), F.lit(heavy).alias("heavy")))
    for _ in range(rounds):
        # the lowest bucket with work, and whether its light edges are done
        waiting = now.where("light or heavy").agg(F.min(F.struct(F.floor(F.col("distance") / delta).cast("long").alias("bucket"), (~F.col("light")).alias("rests"))).alias("next")).first()["next"]
        if waiting is None:
            return now.select("source", "node", "distance", "path")
        kind = "heavy" if waiting["rests"] else "light"
        inside = F.floor(F.col("distance") / delta) == waiting["bucket"]
        weight = F.col("weight") > delta if waiting["rests"] else F.col("weight") <= delta
        moving = now.where(inside & F.col(kind))
        reached = moving.join(roads.where(weight).hint("merge"), F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("b")).alias("path"), F.lit(True).alias("light"), F.lit(heavy).alias("heavy"))
        rested = now.withColumn(kind, F.col(kind) & ~inside)
        every = rested.unionByName(reached.where(F.col("distance") <= radius))
        # the best of the old row and the new ones: equal rows keep the old one's marks, as false comes first
        now = _staged(every.groupBy("source", "node").agg(F.min(F.struct("distance", "path", "light", "heavy")).alias("s")).select("source", "node", "s.*"))
    raise RuntimeError(f"paths still change after {rounds} rounds")


def shortest_routes(trips: DataFrame, edges: DataFrame, radius: int, delta: int) -> DataFrame:
    """Trips (source, target: nodes, further columns) with distance and path; null where the target isn't in reach."""
    found = shortest_paths(trips.select("source"), edges, radius, delta)
    return trips.join(found.withColumnRenamed("node", "target").hint("merge"), ["source", "target"], "left")
