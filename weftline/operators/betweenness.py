"""Betweenness by shortest-path dependencies, as joins on (source, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import dense
from weftline.session import materialize, release


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness) of an unweighted, undirected graph, normalised to
    the share of ordered pairs. ``edges``: (u, v) with both directions.

    One search per source, all sources a level at a time: a level holds the
    nodes first reached at that distance with their numbers of shortest paths.
    Dependencies then flow back level by level. Rows grow with pairs of nodes
    that reach each other, which is what the measure costs; every level is
    spread by (source, node) and written, so none needs a whole graph in one
    task and a lost executor costs a level. Dense graphs, whose links a level
    would repeat for every source, are searched by matrix products instead
    (``dense``), as far as a bit a pair of nodes fits a worker.
    """
    links = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), "bt-edges")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    n = nodes.count()
    scale = max((n - 1) * (n - 2), 1)
    if dict(links.dtypes)["u"] == dict(links.dtypes)["v"] == "bigint" and n and dense.fits(links.count(), n):
        summed = dense.betweenness(links, nodes)
        return materialize(nodes.join(summed, "node", "left").select("node", (F.coalesce("need", F.lit(0.0)) / scale).alias("betweenness")), "bt")
    level = materialize(nodes.select(F.col("node").alias("s"), F.col("node").alias("x"), F.lit(1.0).alias("paths")), "bt-level")
    levels = [level]
    while True:  # a level has new pairs only, so there is a last one
        reached = level.join(links, F.col("x") == F.col("u")).groupBy("s", F.col("v").alias("x")).agg(F.sum("paths").alias("paths"))
        # a neighbour of a level is in the level before, in it, or new
        for seen in levels[-2:]:
            reached = reached.join(seen.select("s", "x"), ["s", "x"], "left_anti")
        level = materialize(reached, "bt-level")
        if level.isEmpty():
            break
        levels.append(level)

    total, below = None, None
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        held = level.withColumn("need", F.lit(0.0))
        if below is not None:
            held = level.join(below, ["s", "x"], "left").select("s", "x", "paths", F.coalesce("need", F.lit(0.0)).alias("need"))
        held = materialize(held, "bt-need")
        part = held.groupBy(F.col("x").alias("node")).agg(F.sum("need").alias("need"))
        total = part if total is None else total.unionByName(part)
        nearer = levels[depth - 1].select("s", F.col("x").alias("p"), F.col("paths").alias("p_paths"))
        back = held.join(links, F.col("x") == F.col("u")).select("s", F.col("v").alias("p"), (F.lit(1.0) + F.col("need")).alias("one"), "paths")
        below = back.join(nearer, ["s", "p"]).groupBy("s", F.col("p").alias("x")).agg(F.sum(F.col("p_paths") / F.col("paths") * F.col("one")).alias("need"))
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    summed = total.groupBy("node").agg(F.sum("need").alias("need"))
    out = materialize(nodes.join(summed, "node", "left").select("node", (F.coalesce("need", F.lit(0.0)) / scale).alias("betweenness")), "bt")
    for level in levels:
        release(level)
    return out
