"""Connected components of a link table, by alternating large-star and small-star steps, or by contraction.

Both steps only take minima and join them back: no node's neighbours meet in one task, the driver sees two numbers a
round, and the number of rounds grows with the logarithm of the component size. Every round is written to the shared
folder, so its lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

MAX_ROUNDS = 60
#: Joins that an id takes towards the root of its tree in a level of contraction.
HOPS = 3


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that a link names; the component is its smallest id.

    Links may repeat, point either way or loop; those with a null end are void. No links give an empty table.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        new = materialize(_small_star(_large_star(edges).distinct()).distinct())
        drop_scratch(edges)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())


def _hopped(parent: DataFrame, hops: int) -> DataFrame:
    """(id, up) with every id's ancestor some hops above its parent, or the last one there is."""
    step, out = parent.select(F.col("id").alias("_id"), F.col("up").alias("_up")), parent
    for _ in range(hops):
        out = out.join(step, F.col("up") == F.col("_id"), "left").select("id", F.coalesce("_up", "up").alias("up"))
    return out


def forest(links: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, up), a table: a smaller id of its component for every id that a link names with a smaller one. A cheap step towards components: equal ``up`` means one component."""
    parent = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("b")).groupBy("id").agg(F.min("b").alias("up")))
    out = materialize(_hopped(parent, hops))
    drop_scratch(parent)
    return out


def contracted_components(links: DataFrame) -> DataFrame:
    """What ``connected_components`` gives, by contraction: every id moves to an ancestor, and the links between ancestors are what is left to do.

    Ancestors are smaller ids, so a component shrinks to its smallest id. A level takes a minimum and a few joins; stars take one level, and
    a path shrinks with each by as many times as there are hops.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        if len(levels) == MAX_ROUNDS:
            raise RuntimeError(f"components have not settled after {MAX_ROUNDS} levels")
        up = forest(edges)
        levels.append(up)
        high, low = up.select(F.col("id").alias("a"), F.col("up").alias("_a")), up.select(F.col("id").alias("b"), F.col("up").alias("_b"))
        moved = edges.join(high, "a").join(low, "b", "left").select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        new = materialize(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        drop_scratch(edges)
        edges = new
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    drop_scratch(edges)
    known = levels.pop().withColumnRenamed("up", "component_id")
    while levels:
        up, above = levels.pop(), known.select(F.col("id").alias("_id"), "component_id")
        here = up.join(above, F.col("up") == F.col("_id"), "left").select("id", F.coalesce("component_id", "up").alias("component_id"))
        known = here.union(known.join(up.select("id"), "id", "left_anti"))
    return known.union(known.select(F.col("component_id").alias("id"), "component_id").distinct())
