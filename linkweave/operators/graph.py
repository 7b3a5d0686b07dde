"""Connected components of a graph given by its edges, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of the edges ``a, b`` (one type); a component is named by one of its nodes.

    Every round hooks each node to its smallest neighbour, jumps once, and contracts: of two joined nodes one hooks to the other or to a smaller one, so
    that nodes that are left are fewer by half at least of those with an edge. All tables of a round are written to the shared folder. Self-loops and repeated edges do no harm; no edges, no rows.
    """
    edges = cut(edges.select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    out = nodes.select("node", F.col("node").alias("component"))
    live = edges.filter("a <> b")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooked")
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = cut(hooked.join(jump, "up").select("node", F.col("top").alias("up")), "jumped")
        maps.append(jumped)
        ha, hb = jumped.select(F.col("node").alias("a"), F.col("up").alias("x")), jumped.select(F.col("node").alias("b"), F.col("up").alias("y"))
        live = cut(live.join(ha, "a").join(hb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    for m in maps:  # a node's label after each round is looked up in the next one's map
        out = out.join(m.select(F.col("node").alias("component"), F.col("up").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(out, "components") if maps else out
