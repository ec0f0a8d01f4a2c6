"""Pairs of users that share a place, tile by tile: no pair is shuffled.

Pairs grow with the square of a place's users, so a join that deals pairs by
(a, b) writes that square to disk. Here users are dealt into groups, and a
tile holds the events of two groups: every pair of users meets in exactly one
tile, which counts it and is done. What travels is each event once a group;
a tile works in blocks of users, so its memory is that of its events and of
one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An event in a tile: user, time, place, and whether it has a time (1) and is an error (2).
EVENT = np.dtype([("u", "<i8"), ("t", "<i8"), ("k", "<i4"), ("f", "i1")])
#: Events of a group, at most as a rule, and the fewest groups: 12 make 78 tiles.
GROUP, FEWEST = 1_500_000, 12
#: Pairs of events and pairs of users that a block holds.
PAIRS, CELLS = 4_000_000, 4_000_000
#: Rows of a batch of results.
ROWS = 500_000


def _pack(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, EVENT)
    for name in EVENT.names:
        out[name] = batch.column(name).to_numpy(zero_copy_only=False)
    return out


def _dealt(groups: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = _pack(batch)
            mixed = events["u"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            g = ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)
            found = np.unique(g)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([events[g == x].tobytes() for x in found], pa.binary())], ["g", "data"])

    return deal


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, then the same of at[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(at - (ends - n), n)


class Tile:
    """Meetings of users ``a`` with users ``b``: events at one place, within
    ``window`` of each other where one is given."""

    def __init__(self, a: np.ndarray, b: np.ndarray, same: bool, window: int | None):
        self.same = same
        self.users, ai = np.unique(a["u"], return_inverse=True)
        self.others, bi = np.unique(b["u"], return_inverse=True)
        order_a, order_b = np.lexsort((a["t"], a["k"])), np.lexsort((b["t"], b["k"]))
        a, b, ai, self.bi = a[order_a], b[order_b], ai[order_a], bi[order_b]
        lo, hi = np.searchsorted(b["k"], a["k"], "left"), np.searchsorted(b["k"], a["k"], "right")
        if window is not None:
            cuts = np.flatnonzero(a["k"][1:] != a["k"][:-1]) + 1
            for s, e in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if s == e:
                    continue
                base, times = lo[s], b["t"][lo[s] : hi[s]]
                lo[s:e] = base + np.searchsorted(times, a["t"][s:e] - window, "left")
                hi[s:e] = base + np.searchsorted(times, a["t"][s:e] + window, "right")
        by_user = np.argsort(ai, kind="stable")
        self.ai, self.lo, self.n, self.k = ai[by_user], lo[by_user], (hi - lo)[by_user], a["k"][by_user]
        self.dense = 32 * int(self.n.sum()) > len(self.users) * len(self.others)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of users whose work fits a block, one user at least."""
        work = np.cumsum(np.bincount(self.ai, self.n, len(self.users)))
        most, first = max(CELLS // max(len(self.others), 1), 1) if self.dense else len(self.users), 0
        while first < len(self.users):
            done = work[first - 1] if first else 0
            last = max(first + 1, min(first + most, int(np.searchsorted(work, done + PAIRS, "right"))))
            yield first, last
            first = last

    def met(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pair, place) of every meeting of a block, places falling within a
        user; a pair is (user - first) * others + other."""
        s, e = np.searchsorted(self.ai, [first, last])
        ends = np.cumsum(self.n[s:e])
        while s < e:
            done = ends[-(e - s)] - self.n[s]
            stop = max(s + 1, s + int(np.searchsorted(ends[len(ends) - (e - s) :], done + PAIRS, "right")))
            n, turned = self.n[s:stop][::-1], slice(s, stop)
            other = self.bi[_spread(self.lo[turned][::-1], n)]
            user, place = np.repeat(self.ai[turned][::-1], n), np.repeat(self.k[turned][::-1], n)
            if self.same:
                kept = user < other
                user, other, place = user[kept], other[kept], place[kept]
            yield (user - first) * len(self.others) + other, place
            s = stop

    def counted(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a block that met, with how often."""
        if self.dense:
            counts = np.zeros((last - first) * len(self.others), np.int64)
            for pair, _ in self.met(first, last):
                counts += np.bincount(pair, minlength=len(counts))
            pairs = np.flatnonzero(counts)
            return pairs, counts[pairs]
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for pair, _ in self.met(first, last):
            both = np.concatenate([pairs, pair])
            pairs, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(pair), np.int64)]), len(pairs)).astype(np.int64)
        return pairs, counts

    def ends(self, first: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.users[first + pairs // max(len(self.others), 1)], self.others[pairs % max(len(self.others), 1)]


def _links(a, b, same, window) -> Iterator[list[np.ndarray]]:
    tile = Tile(a[a["f"] & 1 > 0], b[b["f"] & 1 > 0], same, window)
    for first, last in tile.blocks():
        pairs, counts = tile.counted(first, last)
        u, v = tile.ends(first, pairs)
        yield [np.minimum(u, v), np.maximum(u, v), counts]


def _errors(events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(user, place, errors), sorted."""
    rows = events[events["f"] & 2 > 0]
    order = np.lexsort((rows["k"], rows["u"]))
    u, k = rows["u"][order], rows["k"][order]
    fresh = np.flatnonzero(np.append(True, (np.diff(u) != 0) | (np.diff(k) != 0))[: len(u)])
    return u[fresh], k[fresh].astype(np.int64), np.diff(np.append(fresh, len(u)))


def _calls(u: np.ndarray, v: np.ndarray, x: tuple, y: tuple) -> np.ndarray:
    """Errors of both users at the places where both have some, 0 if none."""
    lo, hi = np.searchsorted(x[0], u, "left"), np.searchsorted(x[0], u, "right")
    at, pair = _spread(lo, hi - lo), np.repeat(np.arange(len(u)), hi - lo)
    places = np.unique(y[1])
    if not len(at) or not len(places):
        return np.zeros(len(u), np.int64)
    owners = np.unique(y[0])
    held = np.searchsorted(owners, y[0]) * len(places) + np.searchsorted(places, y[1])
    who, where = np.searchsorted(owners, v[pair]), np.searchsorted(places, x[1][at])
    known = (who < len(owners)) & (where < len(places))
    who, where = np.minimum(who, len(owners) - 1), np.minimum(where, len(places) - 1)
    known &= (owners[who] == v[pair]) & (places[where] == x[1][at])
    wanted = who * len(places) + where
    spot = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    known &= held[spot] == wanted
    return np.bincount(pair[known], (x[2][at] + y[2][spot])[known], len(u)).astype(np.int64)


def _severe(least: int, places: int, errors: bool):
    """Pairs that met ``least`` times at ``places`` places, with their errors."""

    def kernel(a, b, same, window) -> Iterator[list[np.ndarray]]:
        tile = Tile(a[a["f"] & 1 > 0], b[b["f"] & 1 > 0], same, window)
        x, y = (_errors(a), _errors(b)) if errors else (None, None)
        names = np.unique(tile.k)
        for first, last in tile.blocks():
            pairs, counts = tile.counted(first, last)
            pairs, counts = pairs[counts >= least], counts[counts >= least]
            if not len(pairs):
                continue
            seen = np.empty(0, np.int64)  # (pair's number, place), once each
            for pair, place in tile.met(first, last):
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                hit = pairs[at] == pair
                seen = np.unique(np.concatenate([seen, at[hit] * len(names) + np.searchsorted(names, place[hit])]))
            cells = np.bincount(seen // len(names), minlength=len(pairs))
            pairs, counts, cells = pairs[cells >= places], counts[cells >= places], cells[cells >= places]
            u, v = tile.ends(first, pairs)
            for s in range(0, len(pairs), 100_000):
                p, q = u[s : s + 100_000], v[s : s + 100_000]
                yield [np.minimum(p, q), np.maximum(p, q), counts[s : s + 100_000], cells[s : s + 100_000], _calls(p, q, x, y) if errors else np.zeros(len(p), np.int64)]

    return kernel


def _devices(a, b, same, window) -> Iterator[list[np.ndarray]]:
    def once(events: np.ndarray) -> np.ndarray:
        users, places, _ = _errors(events)
        out = np.zeros(len(users), EVENT)
        out["u"], out["k"] = users, places
        return out

    tile = Tile(once(a), once(b), same, None)
    for first, last in tile.blocks():
        pairs, counts = tile.counted(first, last)
        low = np.full(len(pairs), np.iinfo(np.int32).max, np.int32)
        slot = None
        if tile.dense:
            slot = np.empty((last - first) * len(tile.others), np.int32)
            slot[pairs] = np.arange(len(pairs), dtype=np.int32)
        for pair, place in tile.met(first, last):
            at = slot[pair] if tile.dense else np.searchsorted(pairs, pair)
            np.minimum.at(low, at, place)
        u, v = tile.ends(first, pairs)
        yield [np.minimum(u, v), np.maximum(u, v), counts, low]


def _run(kernel, groups: int, window: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, dict[int, list]] = {}
        for batch in batches:
            for tile, g, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "g", "data")), strict=True):
                tiles.setdefault(tile, {}).setdefault(g, []).append(data)
        for tile in list(tiles):
            held = {g: np.frombuffer(b"".join(parts), EVENT) for g, parts in tiles.pop(tile).items()}
            i, j = divmod(tile, groups)
            none = np.empty(0, EVENT)
            for columns in kernel(held.get(i, none), held.get(j, none), i == j, window):
                for s in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + ROWS], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _tiled(events: DataFrame, kernel, window: int | None, **more: pa.DataType) -> DataFrame:
    """``kernel`` over every tile of ``events`` (u, t, k, f)."""
    groups = max(FEWEST, -(-events.count() // GROUP))
    dealt = events.select("u", "t", "k", "f").mapInArrow(_dealt(groups), "g int, data binary")
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    i, j = F.least("g", "o"), F.greatest("g", "o")
    # the diagonal and what lies above it, numbered row by row: a task a tile
    number = (i * (2 * groups - i - 1) / 2 + j).cast("int")
    dealt = pairs.select((i * groups + j).alias("tile"), "g", "data", number.alias("p")).repartitionById(groups * (groups + 1) // 2, F.col("p"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *more.items()])
    names = {pa.int64(): "bigint", pa.int32(): "int"}
    return dealt.select("tile", "g", "data").mapInArrow(_run(kernel, groups, window, schema), ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def links(events: DataFrame, window: int) -> DataFrame:
    """(a, b, amt): users a < b and how many of their events lie within
    ``window`` of each other at one place. ``events``: (u, t, k, f)."""
    return _tiled(events, _links, window, amt=pa.int64())


def co_locations(events: DataFrame, window: int, least: int = 3, places: int = 2, errors: bool = True) -> DataFrame:
    """(a, b, n, cells, calls): of ``links`` those with ``least`` meetings at
    ``places`` places, and the errors of both at places where both have some
    (0 without ``errors``)."""
    return _tiled(events, _severe(least, places, errors), window, n=pa.int64(), cells=pa.int64(), calls=pa.int64())


def shared_errors(events: DataFrame) -> DataFrame:
    """(a, b, devices, first_device): users with errors at one place."""
    return _tiled(events.where("f >= 2"), _devices, None, devices=pa.int64(), first_device=pa.int32())
