"""Iterations over numbered nodes in a logarithmic number of rounds: pointer doubling, and components by alternating stars.

Nodes are longs (storage.ranked() numbers those of all scenes at once, in the order that
ties are broken by), so a round shuffles pairs of longs only. Each round is written to
the shared folder, and the one before it is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, discard, sized


def cyclic(step: DataFrame) -> DataFrame:
    """(node, least) of the nodes whose walk along step (node, to; one row a node) runs into a cycle; least: the least node of all the walk.

    After k rounds a node knows its 2^k-th successor and the least of the nodes before
    that. Walks that end lose their rows. It is over when no walk ended in a round and no
    least changed: then neither does in any later one.
    """
    now, size = sized(step.select("node", F.col("to").alias("jump"), F.col("node").alias("least")), "walks"), -1
    while True:
        ahead = now.select(F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("least").alias("other"))
        grown = now.join(ahead, "jump").select("node", F.col("further").alias("jump"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed"))
        new = sized(grown, "walks")
        discard(now)
        n, changed = new.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("changed"), F.lit(False))).first()
        now = new.drop("changed")
        now.scratch_path = new.scratch_path
        if not n or n == size and not changed:
            return now.select("node", "least")
        size = n


class Ancestors:
    """Of a forest (node, parent): its nodes' depths, and the ancestors at each power of two, by pointer doubling."""

    def __init__(self, forest: DataFrame) -> None:
        up = sized(forest.select("node", F.col("parent").alias("jump")), "ancestors")
        self.jumps = [up]
        #: (node, depth, root) of the nodes that have a parent.
        self.depths = sized(up.select("node", F.col("jump").alias("top"), F.lit(1).cast("long").alias("depth")), "depths")
        while not (last := self.jumps[-1]).isEmpty():
            ahead = self.depths.select(F.col("node").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"))
            new = self.depths.join(ahead, "top", "left").select("node", F.coalesce("further", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
            new = sized(new, "depths")
            discard(self.depths)
            self.depths = new
            twice = last.join(last.select(F.col("node").alias("jump"), F.col("jump").alias("further")), "jump").select("node", F.col("further").alias("jump"))
            self.jumps.append(sized(twice, "ancestors"))

    def lines(self, nodes: DataFrame) -> DataFrame:
        """(node, at, up): each of the nodes' ancestors, itself included (up 0), in a round a power of two; only rows of these nodes' lines are made."""
        out = nodes.select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("up"))
        for k in range(len(self.jumps) - 1, -1, -1):
            more = out.join(self.jumps[k].select(F.col("node").alias("at"), "jump"), "at").select("node", F.col("jump").alias("at"), (F.col("up") + (1 << k)).alias("up"))
            out = out.unionByName(more)
            if k % 4 == 0:  # plans stay short
                out = sized(out, "lines")
        return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. edges: a > b, distinct. Each node links its larger (or smaller) neighbours to the least node that it knows.

    The least neighbour is a partial aggregate, so a hub is combined before the shuffle;
    the join back is one that AQE can split when a hub's rows are skewed.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, write: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node. Nodes may be of any type that has an order.

    Self-loops, repeated edges and rows with a null end are dropped; nodes without an edge
    to another node do not appear. Ends when a round changes nothing.
    """
    a, b = F.greatest(src, dst), F.least(src, dst)
    edges = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = write(edges.select(a.alias("a"), b.alias("b")).distinct(), "cc")
    sign = None
    for _ in range(max_rounds):
        new = write(_star(_star(now, True), False), "cc")
        discard(now)
        now = new
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (row[0], row[1]) == sign:
            break
        sign = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
