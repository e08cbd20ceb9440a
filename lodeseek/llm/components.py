"""Connected components by repeated smallest-neighbour labels with pointer jumping, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, hot_keys, looked_up, written


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (a minimum that is combined before the shuffle, so
    a hub costs one row a task), then jumps to the label of that label. Hubs and labels that many nodes share are
    looked up by a broadcast of those few, so no task holds all their rows. Rounds grow with the logarithm of the
    longest path. State is written to the shared folder after each round; an empty input gives no rows.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("a <> b")
    edges = written(both.union(both.select("y", "x")).distinct(), label)
    hubs = hot_keys("y", edges)
    state = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")), label)
    while True:
        near = looked_up(edges, state.select(F.col("node").alias("y"), "component"), "y", hubs).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        low = written(state.join(near, "node").select("node", F.least("component", "near").alias("mid"), F.col("component").alias("old")), label)
        jump = state.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        after = looked_up(low, jump, "mid", hot_keys("mid", low)).select("node", F.least("mid", "far").alias("component"), (F.least("mid", "far") != F.col("old")).alias("moved"))
        after = written(after, label)
        moved = not after.where("moved").isEmpty()
        for old in (state, low):
            delete(spark, old._lodeseek_path)
        path, state = after._lodeseek_path, after.select("node", "component")
        state._lodeseek_path = path
        if not moved:
            delete(spark, edges._lodeseek_path)
            return state
