"""Ranks on the graph of meetings without its edges.

A user's neighbours weigh what their events at its places within the window
weigh, so a round is a difference of running sums over each place's events in
time: its cost grows with the events, where the edges grow with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.rank import MOST
from weftline.session import materialize, release

#: A slice of a place's time, in windows: beyond it the place goes on in another row.
SLICE = 16
#: Users whose sums travel as one row.
BLOCK = 1 << 16


def _shape(users, window: int):
    """Rows of events of one slice -> one row: users in order of time, the
    events that are at home in the slice, and the range that each meets."""

    def shape(table: pa.Table) -> pa.Table:
        u, t, home = (table.column(c).to_numpy() for c in ("u", "t", "home"))
        order = np.argsort(t, kind="stable")
        u, t, home = np.searchsorted(users.value, u[order]), t[order], home[order]
        at = np.flatnonzero(home)
        lo, hi = np.searchsorted(t, t[at] - window, "left"), np.searchsorted(t, t[at] + window, "right")
        # a user's own events in the range: (user, place in time) as one number, sorted
        own = np.sort(u * len(u) + np.arange(len(u)))
        alike = np.searchsorted(own, u[at] * len(u) + hi) - np.searchsorted(own, u[at] * len(u) + lo)
        parts = [u, at, lo, hi, alike]
        return pa.table({c: pa.array([x.astype(np.int32).tobytes()], pa.binary()) for c, x in zip(("u", "at", "lo", "hi", "own"), parts, strict=True)})

    return shape


def _product(vector):
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = vector.value
        y, used = np.zeros(len(x)), False
        for batch in batches:
            for row in batch.to_pylist():
                u, at, lo, hi, own = (np.frombuffer(row[c], np.int32) for c in ("u", "at", "lo", "hi", "own"))
                sums = np.concatenate([[0.0], np.cumsum(x[u])])
                me = u[at]
                y += np.bincount(me, sums[hi] - sums[lo] - own * x[me], len(x))
                used = True
        for s in range(0, len(y) if used else 0, BLOCK):
            part = y[s : s + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "y"])

    return product


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(y) for y in table.column("y").to_pylist())
    return pa.table({"block": table.column("block").slice(0, 1), "y": pa.array([total.tobytes()], pa.binary())})


class Meetings:
    """The weights of ``meetings.links`` as a product with a vector. The driver
    and a worker hold one number a user."""

    def __init__(self, events: DataFrame, window: int):
        self.spark = events.sparkSession
        # written once: the users are looked up before the slices are made
        self.events = materialize(events.where("f % 2 = 1").select("u", "t", "k"), "meet")
        self.users = np.sort(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in self.events.select("u").distinct().toArrow().to_batches())]))
        held = self.spark.sparkContext.broadcast(self.users)
        part = lambda t: F.floor(t / F.lit(SLICE * window)).cast("long")
        near = F.array_distinct(F.array(part(F.col("t") - window), part(F.col("t")), part(F.col("t") + window)))
        cut = self.events.select("u", "t", "k", F.explode(near).alias("slice")).withColumn("home", part(F.col("t")) == F.col("slice"))
        rows = cut.groupBy("k", "slice").applyInArrow(_shape(held, window), "u binary, at binary, lo binary, hi binary, own binary")
        self.rows = materialize(rows, "meet-rows")
        release(self.events)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        held = self.spark.sparkContext.broadcast(x)
        y = np.zeros(len(x))
        found = self.rows.mapInArrow(_product(held), "block int, y binary").groupBy("block").applyInArrow(_added, "block int, y binary")
        for row in found.collect():
            y[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["y"])
        held.destroy()
        return y

    def frame(self, kept: np.ndarray, values: np.ndarray, name: str) -> DataFrame:
        table = pa.table({"node": pa.array(self.users[kept], pa.int64()), name: pa.array(values[kept], pa.float64())})
        return self.spark.createDataFrame(table)


def _settled(step: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tolerance: float) -> np.ndarray:
    for _ in range(MOST):
        before, x = x, step(x)
        if np.abs(x - before).sum() < tolerance:
            return x
    raise RuntimeError(f"scores still move after {MOST} rounds")


def pagerank(events: DataFrame, window: int, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(node, rank) as ``rank.pagerank`` over the edges of the meetings; users
    that meet nobody are no nodes."""
    graph = Meetings(events, window)
    total = np.rint(graph(np.ones(len(graph.users))))  # counts
    linked = total > 0
    n, share = max(int(linked.sum()), 1), np.where(linked, 1.0 / np.where(linked, total, 1.0), 0.0)
    rank = _settled(lambda r: np.where(linked, (1 - damping) / n + damping * graph(r * share), 0.0), linked / n, tolerance)
    release(graph.rows)
    return graph.frame(linked, rank, "rank")


def eigenvector(events: DataFrame, window: int, tolerance: float = 1e-9) -> DataFrame:
    """(node, score) as ``rank.eigenvector`` over the edges of the meetings."""
    graph = Meetings(events, window)
    linked = np.rint(graph(np.ones(len(graph.users)))) > 0

    def step(x: np.ndarray) -> np.ndarray:
        grown = x + graph(x)
        return grown / max(float(np.sqrt(grown @ grown)), 1e-300)

    score = _settled(step, linked.astype(float), tolerance)
    release(graph.rows)
    return graph.frame(linked, score, "score")
