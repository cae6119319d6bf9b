"""Connected components by contraction, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch


def connected(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round hooks every node to its smallest neighbour, jumps twice along those hooks, and contracts the edges to
    the nodes reached; a star or a chain of any length is halved at least, so the rounds grow with the logarithm of the
    longest path. Each round's small tables are written to the shared folder. Repeated edges and loops are harmless;
    no edges give no rows.
    """
    live = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-e0")
    labels = scratch.write(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), f"{tag}-l0")
    turn = 0
    live = live.where("a <> b")
    while not live.isEmpty():
        turn += 1
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), f"{tag}-h{turn}")
        step = hook.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        hook = scratch.write(hook.join(step, "to").select("a", F.col("to2").alias("to")), f"{tag}-j{turn}")
        left, right = hook.select("a", F.col("to").alias("_a")), hook.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        after = live.join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct()
        live = scratch.write(after, f"{tag}-e{turn}")
        moved = labels.join(hook.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(moved, f"{tag}-l{turn}")
        scratch.drop(f"{tag}-h{turn}", f"{tag}-j{turn}", f"{tag}-e{turn - 1}", f"{tag}-l{turn - 1}")
    return labels


class Groups:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
