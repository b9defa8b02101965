"""Groups of records linked by pairwise matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfscan.operators.connect import both_ways, connected
from shelfscan.session import written

#: Breadth-first rounds after which what was reached is taken out as it is.
PEEL_ROUNDS = 8
#: A frontier that adds less than this share of what was reached ends the peeling.
THIN = 0.05


def edges_of(pairs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Distinct undirected edges a < b of pairs(id_a, id_b) without loops and nulls, both ends in ids(id) if given."""
    e = pairs.where(F.col("id_a") != F.col("id_b")).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    if ids is not None:
        known = ids.where(F.col("id").isNotNull()).select("id").distinct()
        e = e.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return e.select("a", "b")


def _peel(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (v) reached from the highest-degree vertex (equal degrees: the smallest id), and those of the last frontier, whose neighbours were not looked at."""
    hub = both.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).select("v")
    reached = frontier = written(hub, "reached")
    size = 1
    for _ in range(PEEL_ROUNDS):
        seen = Observation()
        ahead = both.join(frontier, "v", "left_semi").select(F.col("w").alias("v")).distinct().join(reached, "v", "left_anti")
        frontier = written(ahead.observe(seen, F.count(F.lit(1)).alias("n")), "frontier")
        new = seen.get["n"]
        if not new:
            break
        reached = reached.union(frontier)
        size += new
        if new < THIN * size:
            break
    return reached, frontier


def group_ids(pairs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, group_id: each id in a group of two or more; group_id is the smallest id linked directly or indirectly.

    Loops, nulls, repeated rows, either order of a pair, and ids not in `ids` are dealt with; other columns are ignored; no
    pair that counts gives no rows. No graph data reaches the driver but counts.

    The component of the highest-degree vertex (the giant one, if there is a giant) is peeled by breadth-first joins of its frontier and taken out,
    vertices and edges, by anti-joins; the rest is labelled by minimum propagation (operators.connect). If the peeling ends before the component
    does, because its frontier gets thin, the groups of the rest that touch the last frontier belong to it too: a join with those groups' labels, so
    no vertex stands for the peeled part and none of its edges stay.
    """
    both = written(both_ways(edges_of(pairs, ids).select(F.col("a").alias("v"), F.col("b").alias("w"))), "both")
    reached, frontier = _peel(both)
    outer = both.join(reached, "v", "left_anti")
    rest = outer.join(reached.withColumnRenamed("v", "w"), "w", "left_anti").select("v", "w")
    labels = connected(rest)
    # of vertices outside that the last frontier meets, those with no other neighbour have no label yet
    touched = outer.join(frontier.withColumnRenamed("v", "w"), "w", "left_semi").select("v").distinct()
    held = written(labels.join(touched.withColumn("t", F.lit(True)), "v", "full_outer").select("v", F.coalesce("label", "v").alias("label"), F.coalesce("t", F.lit(False)).alias("t")), "labels")
    joined = held.where("t").select("label").distinct()
    inside = reached.union(held.join(joined, "label", "left_semi").select("v"))
    least = inside.agg(F.min("v")).collect()[0][0]
    others = held.join(joined, "label", "left_anti").select("v", F.col("label").alias("group_id"))
    return inside.select("v", F.lit(least).cast(dict(inside.dtypes)["v"]).alias("group_id")).union(others).withColumnRenamed("v", "id")
