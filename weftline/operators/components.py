"""Connected components as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; a component
    is named after its smallest node.

    Every round offers each node, and the node its label points to, the
    smallest label among its neighbours, then follows labels one step. Trees
    of labels halve in depth, so long chains take logarithmically many rounds.
    Rounds go on until one changes nothing; labels only fall, so that comes.
    A round's labels are written to the shared folder: lineage stays short and
    a lost executor costs one round at most. Null ends and loops are no edges.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = materialize(both.union(both.select("v", "u")).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f")), "cc-labels")
    done = labels.isEmpty()
    while not done:
        pointed = labels.select(F.col("u").alias("v"), F.col("f").alias("fv"))
        near = both.join(pointed, "v").groupBy("u").agg(F.min("fv").alias("m"))
        offered = labels.join(near, "u").select("u", "f", "m")
        votes = offered.select("u", F.least("f", "m").alias("f")).union(offered.select(F.col("f").alias("u"), F.col("m").alias("f")))
        hooked = votes.groupBy("u").agg(F.min("f").alias("g"))
        ahead = hooked.select(F.col("u").alias("g"), F.col("g").alias("gg"))
        moved = hooked.join(ahead, "g", "left").select("u", F.coalesce(F.least("g", "gg"), "g").alias("f"))
        before = labels.select("u", F.col("f").alias("old"))
        fresh = materialize(moved.join(before, "u").select("u", "f", (F.col("f") < F.col("old")).alias("changed")), "cc-labels")
        done = fresh.where("changed").isEmpty()
        release(labels)
        labels = fresh.select("u", "f")
        labels._weftline_path = fresh._weftline_path
    release(both)
    found = labels.select(F.col("u").alias("node"), F.col("f").alias("component"))
    found._weftline_path = labels._weftline_path
    return found
