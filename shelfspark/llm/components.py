"""Connected components by min-label contraction, without driver-side links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (``node``, ``comp``), comp being the smallest node.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``.  Each round hooks every node to its smallest
    neighbour, follows the hooks to their roots and contracts the edges; at least half of the
    nodes go per round.  Minima are partially aggregated, so a node with very many
    links does not load one task.
    """
    live = write_table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    total = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        roots = write_table(roots.select("node", F.least("node", "low").alias("comp")), "hooks")
        while True:
            step = roots.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            jumped = write_table(roots.join(step, "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "jumps")
            drop_table(roots)
            done = jumped.filter("moved").isEmpty()
            roots = jumped.drop("moved")
            roots._table_path = jumped._table_path
            if done:
                break
        ends = live
        for side in ("a", "b"):
            ends = ends.join(roots.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}")), side)
        older, live = live, write_table(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "edges")
        drop_table(older)
        if total is None:
            total = roots
        else:
            then = roots.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
            merged = write_table(total.join(then, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp")), "labels")
            drop_table(total)
            drop_table(roots)
            total = merged
    drop_table(live)
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    return total
