"""Groups of what is linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfscan.session import release, written

#: Rounds after which something is wrong: each leaves a constant share of the vertices.
MAX_ROUNDS = 100


def _linked(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges(v, w) between different ends, written, and their number."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    return out, seen.get["n"]


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("v", "w").union(edges.select(F.col("w").alias("v"), F.col("v").alias("w"))).where("v <> w").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """v, label of each end of edges(v, w): the smallest end linked directly or indirectly. Loops give nothing; either order and repeated rows are one.

    Minimum propagation with contraction. In a round each vertex takes the least vertex among itself and its neighbours, in an order by hash that changes each
    round, and then what that vertex has taken; edges then join what their ends have taken, and those within one vertex drop out, and with them
    all that is settled. So edges and vertices shrink by a constant share a round, chains of any numbering included, and a long chain needs about
    log n rounds. Then the rounds are followed back, and each group gets its smallest end.

    A hub is no hot task: the minima are aggregates with map-side combine, and every join has one row a vertex on the other side, so that the planner
    splits an oversize partition (AQE skew join).
    """
    left, n = _linked(both_ways(edges))
    taken: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        if not n:
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        least = left.groupBy("v").agg(F.min(order("w")).alias("x")).select("v", F.least("x", order("v"))["id"].alias("to"))
        far = least.select(F.col("v").alias("to"), F.col("to").alias("far"))
        taken.append(written(least.join(far, "to").select("v", F.col("far").alias("to")), "taken"))
        ends = lambda c: taken[-1].select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(ends("v"), "v").join(ends("w"), "w").select(F.col("v_to").alias("v"), F.col("w_to").alias("w"))
        shrunk, n = _linked(moved.where("v <> w").distinct())
        release(left)
        left = shrunk
    else:
        raise RuntimeError("edges did not settle")
    if not taken:
        return left.select("v", F.col("w").alias("label"))
    of = taken.pop()
    while taken:
        below, above = taken.pop(), of.select(F.col("v").alias("to"), F.col("to").alias("root"))
        of = below.join(above, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    of = written(of, "roots")
    return of.join(of.groupBy("to").agg(F.min("v").alias("label")), "to").select("v", "label")
