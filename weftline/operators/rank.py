"""Iterative ranks on weighted graphs, one join and one aggregation a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

#: Rounds after which an iteration that has not settled fails.
MOST = 1000
#: Every so many rounds the change of the last one is measured.
LOOK = 5


def _moved(after: DataFrame, before: DataFrame, value: str) -> float:
    """The sum of absolute changes over the nodes."""
    old = before.select("node", F.col(value).alias("__old"))
    return after.join(old, "node").agg(F.sum(F.abs(F.col(value) - F.col("__old")))).first()[0] or 0.0


def pagerank(edges: DataFrame, rounds: int | None = None, damping: float = 0.85, every: int = 1, tolerance: float = 1e-8) -> DataFrame:
    """(node, rank) from a uniform start: after ``rounds`` rounds where they
    are given, else when a round changes the ranks by less than ``tolerance``
    a node in sum, up to 1,000 rounds; beyond that it fails. ``edges``:
    (u, v, w) with both directions of an undirected edge. Mass of nodes
    without weight is spread evenly. A round reads the one before it
    more than once, so it is written before the next is planned."""
    out = edges.groupBy("u").agg(F.sum("w").alias("total"))
    share = materialize(edges.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")), "rank-edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    nodes = materialize(nodes.join(out.select(F.col("u").alias("node"), F.lit(True).alias("linked")), "node", "left"), "rank-nodes")
    n = nodes.count()
    rank = nodes.select("node", "linked", F.lit(1.0 / max(n, 1)).alias("r"))
    for k in range(MOST if rounds is None else rounds):
        before = rank
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("linked").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        came = share.join(rank.select(F.col("node").alias("u"), "r"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("in"))
        rank = nodes.join(came, "node", "left").crossJoin(F.broadcast(lost)).select(
            "node", "linked", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n)).alias("r")
        )
        if rounds is None or ((k + 1) % every == 0 and k + 1 < rounds):
            rank = materialize(rank, "rank")
        if rounds is None and k % LOOK == LOOK - 1 and _moved(rank, before, "r") < tolerance * n:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks still move after {MOST} rounds")
    return rank.select("node", F.col("r").alias("rank"))


def eigenvector(edges: DataFrame, rounds: int | None = None, every: int = 1, tolerance: float = 1e-8) -> DataFrame:
    """(node, score): power iteration on A + I, which does not oscillate on
    bipartite graphs; weights should not be far below 1, or I outweighs them
    and little moves in a round. Scaled to unit length every round. After ``rounds``
    rounds where they are given, else when a round changes the scores by less
    than ``tolerance`` in sum, as in ``pagerank``."""
    nodes = edges.select(F.col("u").alias("node")).distinct()
    score = nodes.select("node", F.lit(1.0).alias("x"))
    for k in range(MOST if rounds is None else rounds):
        before = score
        came = edges.join(score.select(F.col("node").alias("v"), "x"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("in"))
        grown = score.join(came, "node", "left").select("node", (F.col("x") + F.coalesce("in", F.lit(0.0))).alias("x"))
        length = grown.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
        score = grown.crossJoin(F.broadcast(length)).select("node", (F.col("x") / F.col("len")).alias("x"))
        if rounds is None or ((k + 1) % every == 0 and k + 1 < rounds):
            score = materialize(score, "eigen")
        if rounds is None and k % LOOK == LOOK - 1 and _moved(score, before, "x") < tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"scores still move after {MOST} rounds")
    return score.select("node", F.col("x").alias("score"))
