"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable from node.

    Alternates large-star and small-star steps, which need a logarithmic number of rounds; the edges
    of each round are written to the shared folder. Null ends and self-loops give no edge.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = cut(e)
    for _ in range(max_rounds):
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y")).where("x <> y")
        nxt = cut(small.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        # done when every node hangs on exactly one smaller node that hangs on none
        open_ = nxt.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").take(1) or nxt.join(nxt.select(F.col("v").alias("u")), "u", "left_semi").take(1)
        e = nxt
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
