"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``WINDOW`` bytes only, most
significant digit first; groups that are still together at that depth are
exactly the windows that occur more than once, and a digit that leaves a suffix
alone ends its sorting. Three kinds of digit, from coarse to fine:

    1. The anchor. In every window the ``ANCHOR``-byte string with the
       smallest hash, the first of equals, is its anchor. Equal windows have
       equal anchors at the same place, so suffixes are first dealt by (anchor
       string, distance to it). Windows in a row share an anchor: they travel
       as one range, about one for 170 bytes, and a range whose anchor occurs
       once is done.
    2. The range. In two ranges of the same bytes and the same place of the
       anchor every suffix has an equal one in the other, so no digit of
       any pass could part them: they are repeated as a whole without a pass,
       whatever their number, and one of them goes on to stand for all, as a
       partner of ranges that differ.
    3. Passes over the suffixes of the ranges that differ from all others but
       share an anchor with some: eight bytes a digit, in byte order, groups
       kept in place and only those sorted that a digit splits.

Anchors and ranges are compared by 64-bit hashes of their bytes. Step 3 happens
inside a task for anchors with up to ``GROUP`` different ranges. For others the
suffixes become rows and a pass is an aggregation over (group, digit), with
hashes of ``PIECE`` bytes as digits and suffixes alone dropped between passes;
so no anchor, however common, needs a task that holds it whole.

Texts are UTF-8 bytes; a window lies in one document. Defined cases: a null
text is empty; a text shorter than a window loses nothing; rows that repeat,
identifier included, are documents of their own and repeat each other; a null
identifier is allowed; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table
from weftline.llm.role_repair import _runs
from weftline.llm.textvec import Powers, buffers, mix64, prefix_hash, slices
from weftline.session import materialize, release

WINDOW, ANCHOR, DIGIT, PIECE = 400, 64, 8, 100
GROUP = 20_000
#: Bits that hold a position while anchors are chosen; longer texts are cut
#: into stretches that overlap by a window less one byte.
POSITION_BITS = 22
STRETCH = (1 << POSITION_BITS) - (1 << 12)
ABSENT = -(1 << 63)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of
    blocks of that width."""
    n = len(a)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _raw(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = Powers.of(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def ranges(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, range hash, anchor position, first start, last start)
    of every range; positions count from the beginning of ``data``."""
    n = len(data)
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < window:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - anchor + 1)
    hashed = mix64(_raw(prefix, at, at + anchor))
    low = np.uint64((1 << POSITION_BITS) - 1)
    chosen = _sliding_min(hashed & ~low | at.astype(np.uint64), window - anchor + 1) & low
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1]
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= ends)
    if not len(starts):
        return none
    picked = chosen[starts].astype(np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (picked[1:] != picked[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    first, last, place = starts[head], starts[tail], picked[head]
    shape = (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return row[head], hashed[place], mix64(_raw(prefix, first, last + window) + mix64(shape)), place, first, last


def _stretches(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of the batch, offset in its text) of pieces that
    fit the position bits; the stretches of a long text overlap."""
    done = 0
    for piece in slices(batch, "text", 2 << 20):
        data, offsets = buffers(piece.column(piece.schema.get_field_index("text")))
        if len(data) <= STRETCH:
            yield data, offsets, np.arange(piece.num_rows) + done, np.zeros(piece.num_rows, dtype=np.int64)
        else:  # one long text
            for start in range(0, len(data), STRETCH - window + 1):
                part = data[start : start + STRETCH]
                yield part, np.array([0, len(part)]), np.array([done]), np.array([start])
        done += piece.num_rows


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """Every range of every document: (id, th, anchor, range, place, first,
    last), the last three as offsets in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows, base in _stretches(batch, window):
                row, anchor, whole, place, first, last = ranges(data, offsets, window)
                if not len(row):
                    continue
                move = base[row] - offsets[row]
                at = pa.array(rows[row])
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))]
                columns += [pa.array((x + move).astype(np.int64)) for x in (place, first, last)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "anchor", "range", "place", "first", "last"])

    return map_arrow(docs.select("id", "th", "text"), run, "id long, th long, anchor long, range long, place long, first long, last long")


def _digits(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number, high byte first."""
    padded = np.concatenate([data, np.zeros(DIGIT, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(DIGIT):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which suffixes of ``data`` (by number) share their first ``window``
    bytes with another of the same group, in sorted order. Most significant
    digit first: members of a group stand side by side; a digit that some
    member has different from the first one's sorts that group by it and cuts
    it; a suffix alone drops out."""
    digits = _digits(data)

    def paired(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of groups of two or more, and where each one's group starts,
        from the flags of the first members."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(new)))
        keep = np.repeat(size > 1, size)
        size = size[size > 1]
        return keep, np.repeat(np.cumsum(size) - size, size)

    def changes(*keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys[0]), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return new

    active = np.argsort(group, kind="stable")
    keep, first = paired(changes(group[active]))
    active = active[keep]
    for depth in range(0, window, DIGIT):
        if not len(active):
            break
        digit = digits[start[active] + depth]
        if window - depth < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - window + depth))
        differs = digit != digit[first]
        if differs.any():
            split = np.zeros(len(active), dtype=bool)
            split[first[differs]] = True
            at = np.flatnonzero(split[first])
            order = at[np.lexsort((digit[at], first[at]))]
            active[at], digit[at] = active[order], digit[order]
            keep, after = paired(changes(first, digit))
            active, first = active[keep], after
    return active


def _settle(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Step 3 for whole anchors: rows (anchor, id, th, place, first, last, many,
    bytes); yields (id, th, start, end) of repeated stretches of the ranges
    that are not repeated as a whole."""
    data = np.frombuffer(b"".join(r[7] for r in rows), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])[:-1]
    anchor, place, first, last = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 3, 4, 5))
    count = last - first + 1
    owner = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    away = (place - first)[owner] - step
    group = mix64(anchor[owner].view(np.uint64) ^ (away.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    found = radix_groups(data, base[owner] + step, group, window)
    found = np.sort(found[~np.array([r[6] for r in rows], dtype=bool)[owner[found]]])
    if not len(found):
        return
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(found)) - 1
    for a, b in zip(found[head].tolist(), found[tail].tolist(), strict=True):
        row = rows[owner[a]]
        yield row[1], row[2], row[4] + int(step[a]), row[4] + int(step[b]) + window


_SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=_SPANS)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of ``wanted`` ranges, one row each. Ranges of a document are
    gathered, as numbers, before the texts are joined."""
    struct = F.struct("anchor", "place", "first", "last", "many", "crowd")
    lists = wanted.groupBy(F.col("id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_list(struct).alias("wanted"))
    # Rows that repeat an identifier with its text are equal: any serves.
    texts = docs.join(lists, (F.col("id") == F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("id", "th", "text", "wanted")
    window = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, th, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for w in wanted:
                    rows.append((w["anchor"], i, th, w["place"], w["first"], w["last"], w["many"], data[w["first"] : w["last"] + window], w["crowd"]))
                    size += w["last"] - w["first"] + window
                    if size > 4 << 20:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 6, pa.bool_(), pa.binary(), pa.bool_()]
        names = ["anchor", "id", "th", "place", "first", "last", "many", "data", "crowd"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return map_arrow(texts, run, "anchor long, id long, th long, place long, first long, last long, many boolean, data binary, crowd boolean")


def _by_task(fetched: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for group in _runs(batches, 1):
            # Rows that repeat identifier and text bring their ranges again.
            group = list({(r[1], r[2], r[4]): r for r in group}.values())
            held += group
            size += sum(len(r[7]) for r in group)
            if size > 4 << 20:
                yield _spans_batch(list(_settle(held, window)))
                held, size = [], 0
        if held:
            yield _spans_batch(list(_settle(held, window)))

    rows = fetched.select("anchor", "id", "th", "place", "first", "last", "many", "data")
    return map_arrow(rows.repartition("anchor").sortWithinPartitions("anchor"), run, "id long, th long, start long, end long")


def _by_rows(fetched: DataFrame, window: int) -> DataFrame:
    """Step 3 with a row a suffix, for common anchors: each pass adds a digit
    to the group and drops the suffixes that it leaves alone."""
    pieces = range(0, window, PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, i, th, place, first, last, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = np.arange(last - first + 1)
                prefix, n = prefix_hash(np.frombuffer(data, dtype=np.uint8)), len(start)
                digits = np.stack([mix64(_raw(prefix, start + d, start + min(d + PIECE, window))) for d in pieces], axis=1).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(pieces)), pa.array(digits.ravel()))
                columns = [pa.array(np.full(n, anchor)), pa.array(place - first - start), listed, pa.array(np.full(n, i)), pa.array(np.full(n, th)), pa.array(first + start), pa.array(np.full(n, many))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "away", "digits", "id", "th", "start", "many"])

    rows = map_arrow(fetched.select("anchor", "id", "th", "place", "first", "last", "many", "data"), run, "anchor long, away long, digits array<long>, id long, th long, start long, many boolean")
    rows = rows.select(F.xxhash64("anchor", "away").alias("key"), "digits", "id", "th", "start", "many")
    for k in range(len(pieces)):
        rows = materialize(rows.withColumn("key", F.xxhash64("key", F.col("digits")[k])), "suffixes")
        # rows that repeat identifier and text bring their suffixes again
        twice = rows.groupBy("key").agg(F.min(F.struct("id", "th", "start")).alias("a"), F.max(F.struct("id", "th", "start")).alias("z")).where("a <> z").select("key")
        before, rows = rows, materialize(rows.join(twice, "key", "left_semi"), "suffixes")
        release(before)
    return rows.where("NOT many").select("id", "th", "start", (F.col("start") + window).alias("end"))


def _identified(docs: DataFrame) -> DataFrame:
    """(id, th, text): an identifier and a digest tell documents apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(ABSENT)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(id, th, start, end) of stretches of repeated windows of ``docs`` (id,
    th, text); stretches of a document may overlap."""
    anchored = materialize(_anchored(docs, window), "ranges")
    member = F.struct("id", "th", "place", "first", "last")
    whole = anchored.groupBy("anchor", "range").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("m"))
    whole = materialize(whole, "range-counts")
    shared = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    repeated = whole.where("n > 1").select("anchor", "range")
    spans = anchored.join(repeated, ["anchor", "range"], "left_semi").select("id", "th", F.col("first").alias("start"), (F.col("last") + window).alias("end"))

    # Anchors with several kinds of range, at least one of them unsettled.
    mixed = whole.join(shared, "anchor").select("anchor", "m.*", (F.col("n") > 1).alias("many"), (F.col("kinds") > group).alias("crowd"))
    fetched = materialize(_fetch(docs, mixed), "range-bytes")
    parts = _by_task(fetched.where("NOT crowd"), window)
    if not fetched.where("crowd").isEmpty():
        parts = parts.unionByName(_by_rows(fetched.where("crowd"), window))
    out = materialize(spans.unionByName(parts), "repeated-spans")
    for done in (anchored, whole, fetched):
        release(done)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of
    ``docs`` (doc_id, text); with ``kept`` also the bytes that stay, which may
    end inside a character."""
    known = _identified(docs)
    spans = repeated_spans(known, window, group)
    lists = spans.groupBy(F.col("id").alias("s_id"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = known.join(lists, (F.col("id") == F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = [removed(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def removed(i: int, text: str, found: list | None) -> tuple:
        data = memoryview(text.encode())
        runs: list[list[int]] = []
        for a, b in sorted((s["start"], s["end"]) for s in found or ()):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        digest, rest, at, left = hashlib.sha256(), [], 0, 0
        for a, b in [*runs, [len(data), len(data)]]:
            digest.update(data[at:a])
            left += a - at
            if kept:
                rest.append(data[at:a])
            at = b
        return (None if i == ABSENT else i, len(data), len(data) - left, len(runs), digest.hexdigest(), *([b"".join(rest)] if kept else []))

    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()][: 5 + kept]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + kept]
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)


def op8_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
