"""Betweenness of dense graphs: searches from many sources at once, as matrix
products with the adjacency, a bit a pair of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes up to which the bits, 128 MB, are given to every worker.
MOST = 32_768
#: Dense: a link to every so many pairs of nodes.
SPARSE = 64
#: Sources searched at once, and columns of the adjacency unpacked at once.
SOURCES, COLUMNS = 256, 1024


def _rows(ids):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = ids.value
        for batch in batches:
            bits = []
            for near in batch.column("near"):
                row = np.zeros(len(nodes), bool)
                row[np.searchsorted(nodes, near.values.to_numpy(zero_copy_only=False))] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(bits, pa.binary())], ["u", "bits"])

    return pack


def _times(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """x times the adjacency, which is symmetric: a band of its rows at a time."""
    out = np.empty_like(x)
    for s in range(0, len(bits), COLUMNS):
        band = np.unpackbits(bits[s : s + COLUMNS], axis=1, count=len(bits)).astype(np.float64)
        out[:, s : s + COLUMNS] = x @ band.T
    return out


def depend(bits: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The dependencies of ``sources`` on every node, summed."""
    n = len(bits)
    rows = np.arange(len(sources))
    depth = np.full((len(sources), n), -1, np.int32)
    depth[rows, sources] = 0
    front = np.unpackbits(bits[sources], axis=1, count=n).astype(np.float64)
    paths, last = np.zeros((len(sources), n)), 0
    paths[rows, sources] = 1
    while True:
        front[depth >= 0] = 0
        fresh = front > 0
        if not fresh.any():
            break
        last += 1
        depth[fresh] = last
        paths += front
        if (depth >= 0).all():
            break
        front = _times(front, bits)
    need = np.zeros((len(sources), n))
    for level in range(last, 1, -1):
        below = np.where(depth == level, (1 + need) / np.where(paths > 0, paths, 1), 0.0)
        need += np.where(depth == level - 1, _times(below, bits) * paths, 0.0)
    return need.sum(axis=0)


def fits(links: int, nodes: int) -> bool:
    return nodes <= MOST and links * SPARSE >= nodes * nodes


def betweenness(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, need): ``links`` (u, v), both directions, once each."""
    spark = links.sparkSession
    ids = np.sort(nodes.toArrow().column(0).to_numpy())
    held = spark.sparkContext.broadcast(ids)
    near = links.groupBy("u").agg(F.collect_list("v").alias("near"))
    kind = dict(links.dtypes)["u"]
    table = near.mapInArrow(_rows(held), f"u {kind}, bits binary").toArrow()
    bits = np.zeros((len(ids), -(-len(ids) // 8)), np.uint8)
    for u, row in zip(table.column("u").to_numpy(), table.column("bits"), strict=True):
        bits[np.searchsorted(ids, u)] = np.frombuffer(row.as_buffer(), np.uint8)
    graph = spark.sparkContext.broadcast(bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(len(graph.value)), held.value
        for batch in batches:
            for s in batch.column("id").to_pylist():
                total += depend(graph.value, np.arange(s * SOURCES, min((s + 1) * SOURCES, len(names))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(total[at])], ["node", "need"])

    blocks = -(-len(ids) // SOURCES)
    found = spark.range(0, blocks, 1, blocks).mapInArrow(search, f"node {kind}, need double")
    return found.groupBy("node").agg(F.sum("need").alias("need"))
