"""Communities by greedy modularity."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import materialize, release


#: Nodes of a component up to which its weights are held as a matrix, 1.6 GB.
MATRIX = 14_000


def _heap(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, m: float) -> np.ndarray:
    """Each node's community, by its smallest node; links (a < b, w). A heap
    holds every linked pair's gain (times 2 m squared, whole where weights
    are); an entry is stale once either side has changed."""
    shared: dict = {}
    for u, v, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        shared.setdefault(u, {})[v] = x
        shared.setdefault(v, {})[u] = x
    weight = {u: sum(near.values()) for u, near in shared.items()}
    members, age = {u: [u] for u in shared}, dict.fromkeys(shared, 0)
    entry = lambda a, b: (weight[a] * weight[b] - 2 * m * shared[a][b], a, b, age[a], age[b])
    heap = [entry(a, b) for a, near in shared.items() for b in near if a < b]
    heapq.heapify(heap)
    while heap:
        gain, a, b, age_a, age_b = heapq.heappop(heap)
        if a not in shared or b not in shared or (age[a], age[b]) != (age_a, age_b):
            continue
        if gain >= 0:
            break
        for other, w in shared.pop(b).items():
            del shared[other][b]
            if other != a:
                shared[a][other] = shared[other][a] = shared[a].get(other, 0.0) + w
        weight[a] += weight.pop(b)
        members[a] += members.pop(b)
        age[a] += 1
        for other in shared[a]:
            heapq.heappush(heap, entry(*sorted((a, other))))
    found = np.arange(n)
    for group in members.values():
        found[group] = min(group)
    return found


def _dense(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, m: float) -> np.ndarray:
    """The same on a matrix: every row keeps its best partner to the right, so
    that a merger costs a row, a column and the rows whose partner it was."""
    shared = np.full((n, n), -np.inf)  # not linked
    shared[a, b] = shared[b, a] = w
    weight = np.bincount(a, w, n) + np.bincount(b, w, n)
    found, alive = np.arange(n), np.arange(n)
    value, partner = np.full(n, -np.inf), np.zeros(n, np.int64)

    def look(i: int) -> None:
        gain = 2 * m * shared[i, i + 1 :] - weight[i] * weight[i + 1 :]
        if len(gain):
            at = int(gain.argmax())
            value[i], partner[i] = gain[at], i + 1 + at

    for i in range(n):
        look(i)
    left = n
    while True:
        a = int(value.argmax())
        if not value[a] > 0:
            break
        b = int(partner[a])
        one, two = shared[a], shared[b]
        row = np.where(np.isneginf(one), two, np.where(np.isneginf(two), one, one + two))
        row[[a, b]] = -np.inf
        shared[b] = shared[:, b] = -np.inf
        shared[a] = shared[:, a] = row
        weight[a] += weight[b]
        value[b] = -np.inf
        found[alive[b]] = alive[a]
        gain = 2 * m * row[:a] - weight[a] * weight[:a]
        was = (partner[:a] == a) | (partner[:a] == b)
        better = (gain > value[:a]) | ((gain == value[:a]) & (a <= partner[:a]) & (gain > -np.inf))
        lost = was & ~better & (value[:a] > -np.inf)
        value[:a][better], partner[:a][better] = gain[better], a
        between = np.flatnonzero((partner[a + 1 : b] == b) & (value[a + 1 : b] > -np.inf)) + a + 1
        value[a] = -np.inf
        for i in [*np.flatnonzero(lost).tolist(), a, *between.tolist()]:
            value[i] = -np.inf
            look(i)
        left -= 1
        if 4 * left < 3 * len(alive):  # the rows of merged nodes go
            kept = np.flatnonzero(found[alive] == alive)
            place = np.cumsum(found[alive] == alive) - 1
            shared, weight, value, partner, alive = shared[np.ix_(kept, kept)], weight[kept], value[kept], place[partner[kept]], alive[kept]
    for i in range(n):  # a community is merged into a smaller node only
        found[i] = found[found[i]]
    return found


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Communities of one component's ``rows`` (u < v, w, m)."""
    m, nodes = float(rows["m"].iloc[0]), np.unique(np.concatenate([rows["u"].unique(), rows["v"].unique()]))
    a, b = np.searchsorted(nodes, rows["u"].to_numpy()), np.searchsorted(nodes, rows["v"].to_numpy())
    thick = len(nodes) <= MATRIX and 64 * len(rows) >= len(nodes) ** 2
    found = (_dense if thick else _heap)(a, b, rows["w"].to_numpy(), len(nodes), m)
    return pd.DataFrame({"node": nodes, "community": nodes[found]})


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): the pair of communities whose union raises the
    modularity most is merged until none does; ties go to the smallest pair. A
    community is named after its smallest node. ``edges``: (u, v, w) with both
    directions.

    Unlinked communities never gain by a merger, so components are
    independent once the total weight is known: one task a component, whose
    memory is bounded by that component's edges, or by its matrix where the
    edges fill one (``MATRIX``). For components beyond a
    worker's memory there is ``spread``.
    """
    linked = edges.where("u IS NOT NULL AND v IS NOT NULL AND u < v").groupBy("u", "v").agg(F.sum("w").alias("w"))
    total = linked.agg(F.sum("w").alias("m"))
    part = connected_components(linked, "u", "v").select(F.col("node").alias("u"), "component")
    kind = dict(edges.dtypes)["u"]
    return linked.join(part, "u").crossJoin(F.broadcast(total)).groupBy("component").applyInPandas(lambda rows: _merge(rows), f"node {kind}, community {kind}")


def spread(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by label propagation, for graphs of any size: in
    every round, half of the nodes (by a hash of node and round) take the label
    that most of their links' weight carries, the smallest of equals. It ends
    when two rounds in a row change nothing, or after ``rounds``: labels need
    not settle, and the method asks for no more."""
    both = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").groupBy("u", "v").agg(F.sum("w").alias("w")), "spread-edges")
    labels = materialize(both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")), "spread")
    still = 0
    for k in range(rounds):
        votes = both.join(labels.toDF("v", "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.max("w").alias("m"), F.collect_list(F.struct("w", "c")).alias("all"))
        best = best.select("node", F.array_min(F.transform(F.filter("all", lambda x: x["w"] == F.col("m")), lambda x: x["c"])).alias("c"))
        turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        fresh = materialize(labels.join(best, "node").select("node", F.when(turn, F.col("c")).otherwise(F.col("community")).alias("community"), (turn & (F.col("c") != F.col("community"))).alias("moved")), "spread")
        still = still + 1 if fresh.where("moved").isEmpty() else 0
        release(labels)
        labels = fresh.select("node", "community")
        labels._weftline_path = fresh._weftline_path
        if still == 2:
            break
    release(both)
    return labels
