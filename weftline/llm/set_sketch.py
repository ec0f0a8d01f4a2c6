"""Near-duplicate groups by SetSketch.

A sketch holds ``REGISTERS`` numbers for a set. Every element walks along a
Poisson process of its own, seeded by its hash; each point falls on a random
register, which keeps the smallest value it gets, as a power of ``BASE``
rounded to an integer and cut off at both ends. Equal sets have equal
sketches, sketches of unions are register-wise maxima, and two registers agree
with nearly the Jaccard similarity of the sets. An element stops when its walk
has passed every register of its set, so large sets cost about one step an
element.

    1. Documents with equal sets are one class from the start.
    2. Classes that agree on one of ``BANDS`` bands of registers are
       candidates. At the threshold a pair is missed by every band with
       probability (1 - 0.8**5)**51 < 2e-9.
    3. A candidate's similarity is estimated by maximum likelihood from the
       registers that are larger, smaller and equal, and both set sizes; only
       a pair more than six standard errors below the threshold is dropped.
    4. What is left is verified on the full sets.

Every class is first compared with one other only, the smallest document of the
bucket that it shares most bands with. Verified links form components. Inside a
component no further comparison can change the result; what is left are classes
of different components in one bucket. Their sketches, compared in tiles of
bounded size, give families of components that may still be linked (a spanning
set of plausible pairs is enough), and inside a family every pair of classes of
different components is settled on full sets: shingle sets as 0/1 rows, all
intersections of two tiles as one matrix product. So a group of copies costs
one comparison a member, and no link between components is left out.

Defined cases: a null text, or one without words, is an empty set, linked with
nothing and kept; a document with fewer words than a shingle has its whole
sequence as its one shingle; rows that share an identifier are one document; a
row without an identifier has no component and is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table
from weftline.llm.role_repair import _runs
from weftline.llm.textvec import buffers, mix64, shingles, slices
from weftline.operators.components import connected_components
from weftline.session import materialize, reclaim, release

REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 51, 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members that a task verifies against one document's set; rows and shingles of a tile.
SALT, TILE, TILE_SHINGLES = 2000, 2048, 1 << 21
#: Pairs of sketches that a worker compares at once.
PAIRS = 4096
#: Bytes of text that a worker hashes at once; its temporaries are about 150 times as large.
SLICE = 1 << 20

_GOLD, _M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def sketch(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS, uint16) of the sets given as (row, element)."""
    lowest = np.full(n * REGISTERS, np.inf)
    bound = np.full(n, np.inf)
    row, seed = rows.astype(np.int64), values
    x = np.zeros(len(row))
    step = 0
    while len(row):
        step += 1
        r = mix64(seed + np.uint64(step * _GOLD & _M64))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * REGISTERS)
        alive = x <= bound[row]
        row, seed, x, r = row[alive], seed[alive], x[alive], r[alive]
        np.minimum.at(lowest, row * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64), x)
        if step % 4 == 1 or len(row) < 4096:
            touched = np.unique(row)
            bound[touched] = lowest.reshape(n, REGISTERS)[touched].max(axis=1)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(lowest) / math.log(BASE))
    return np.clip(np.where(np.isinf(lowest), 0, k), 0, TOP + 1).astype(np.uint16).reshape(n, REGISTERS)


def _agree(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b-1)/b): the share of registers that one set wins."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of registers of
    which u's are larger, or smaller, than v's, and the set sizes."""
    same = REGISTERS - more - less
    u = n_u / np.maximum(n_u + n_v, 1)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = _agree(u - v * j), _agree(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    for _ in range(40):  # the likelihood is concave in j
        left, right = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(left) < likelihood(right)
        lo, hi = np.where(up, left, lo), np.where(up, hi, right)
    return (lo + hi) / 2


def floor_of(percent: int) -> float:
    """Estimates below this are six standard errors under the threshold."""
    j = percent / 100
    return max(0.0, j - 6 * math.sqrt(j * (1 - j) / REGISTERS))


def reaches_floor(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``estimate`` is ``floor_of(percent)`` or more, for sizes whose
    ratio allows it. The likelihood is concave in the similarity, so its maximum
    lies above the floor just where its slope there is not negative."""
    j = floor_of(percent)
    u = n_u / np.maximum(n_u + n_v, 1)
    v = 1 - u
    slope = lambda x: (BASE - 1) / BASE / ((1 - x * (BASE - 1) / BASE) * math.log(BASE))
    a, b = _agree(u - v * j), _agree(v - u * j)
    da, db = -v * slope(u - v * j), -u * slope(v - u * j)
    return more * da / a + less * db / b - (REGISTERS - more - less) * (da + db) / np.maximum(1 - a - b, 1e-12) >= 0


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of register rows may reach the threshold."""
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    out = np.zeros(len(n_a), dtype=bool)
    at = np.flatnonzero(sized)
    if len(at):
        a, b = a[at], b[at]
        out[at] = reaches_floor((a > b).sum(1).astype(float), (a < b).sum(1).astype(float), n_a[at].astype(float), n_b[at].astype(float), percent)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, registers) of every row: the size of the
    set, a 128-bit digest of it and its sketch (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = buffers(batch.column(1))
                n = batch.num_rows
                rows, values = shingles(data, offsets, width)
                size = np.bincount(rows, minlength=n)
                total = [np.concatenate([[0], np.cumsum(mix64(values ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x51ED270B, 0x2545F4914F6CDD1D)]
                ends = np.cumsum(size)
                digest = [(t[ends] - t[ends - size]).view(np.int64) for t in total]
                packed = sketch(rows, values, n)
                registers = [packed[i].tobytes() if size[i] else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "registers"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, h1 long, h2 long, registers binary")


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the threshold. Members go
    to the document that they are compared with, at most about ``SALT`` a task
    and document; a task holds one such document's set."""
    salted = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    members = pairs.join(salted, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    centres = salted.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = members.unionByName(centres)
    shipped = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).select("a", "salt", "member", "id", "text")
    shipped = shipped.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id")

    def reaches(own: np.ndarray, held: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(held, own), len(held) - 1)
        common = int((held[at] == own).sum())
        return 100 * common >= percent * (len(own) + len(held) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, open_ = None, [], False
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = buffers(batch.column(4))
                rows, values = shingles(data, offsets, width)
                ends = np.cumsum(np.bincount(rows, minlength=batch.num_rows))
                begins = np.concatenate([[0], ends[:-1]])
                found = []
                for i, (a, member, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    own = values[begins[i] : ends[i]]
                    if not member:
                        # rows that repeat the centre's identifier: each set counts once
                        if a != current or not open_:
                            current, held, open_ = a, [], True
                        if len(own) and not any(np.array_equal(own, h) for h in held):
                            held.append(own.copy())
                        continue
                    open_ = False
                    if a == current and len(own) and any(reaches(own, h) for h in held):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(shipped, run, "a long, b long")


def _screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) less those that their sketches rule out; of an
    identifier that leads several classes any may hold a pair."""
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(sized).select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            keep = plausible(a, b, np.asarray(batch.column(2)), np.asarray(batch.column(3)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return map_arrow(joined, run, "a long, b long").distinct()


def _blocks(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """``rows`` (group, id, n, kind bool: of the group's largest component)
    with the tile pairs that they meet in: others with others, and others with
    the largest component, never that with itself. A tile of others is whole
    wherever it meets the largest component, so it need not meet itself."""
    size = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    tiles = size.withColumn("tiles", F.ceil(F.greatest(F.col("c") / TILE, F.col("s") / TILE_SHINGLES)).cast("int"))
    counts = tiles.groupBy(F.col(group).alias("g")).agg(
        F.coalesce(F.max(F.when(F.col(kind), F.col("tiles"))), F.lit(0)).alias("nb"), F.coalesce(F.max(F.when(~F.col(kind), F.col("tiles"))), F.lit(0)).alias("no")
    )
    placed = rows.join(counts, F.col(group).eqNullSafe(F.col("g"))).withColumn("t", F.pmod(F.xxhash64("id"), F.when(F.col(kind), F.col("nb")).otherwise(F.col("no"))).cast("int"))
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meet = F.when(F.col(kind), F.transform(up_to("no"), lambda u: F.struct(F.lit(1).alias("k"), F.col("t").alias("t1"), u.alias("t2")))).otherwise(
        F.concat(
            F.transform(F.filter(up_to("no"), lambda u: u != F.col("t")), lambda u: F.struct(F.lit(0).alias("k"), F.least("t", u).alias("t1"), F.greatest("t", u).alias("t2"))),
            F.transform(up_to("nb"), lambda u: F.struct(F.lit(1).alias("k"), u.alias("t1"), F.col("t").alias("t2"))),
        )
    )
    return placed.withColumn("meet", F.explode(meet)).select(*rows.columns, F.col("meet.k").alias("k"), F.col("meet.t1").alias("t1"), F.col("meet.t2").alias("t2"))


def _with_largest(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``largest``: whether a row is of its group's largest component."""
    count = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("c"))
    top = count.groupBy(F.col(group).alias("g")).agg(F.max_by("component", F.struct(F.col("c"), -F.col("component"))).alias("top"))
    return rows.join(top, F.col(group) == F.col("g")).withColumn("largest", F.col("component") == F.col("top")).drop("g", "top")


class _Union:
    """Component labels of a block's rows, merged as links are found."""

    def __init__(self, component: np.ndarray):
        self.label = component.copy()

    def merge(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.label[self.label == b] = a
        return True


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _plausible_families(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): components joined by a plausible pair of classes that share a
    bucket; enough of them to connect whatever such pairs connect.
    ``buckets``: (bucket, id, component)."""
    rows = _with_largest(buckets.join(classes.select("id", "n"), "id"), "bucket")
    rows = _blocks(rows, "bucket", "largest").join(classes.select("id", "n", "registers"), ["id", "n"])
    rows = rows.select("bucket", "k", "t1", "t2", "largest", "id", "component", "n", "registers")
    rows = rows.repartition("bucket", "k", "t1", "t2").sortWithinPartitions("bucket", "k", "t1", "t2", "n", "id")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        comp, size = (np.array([g[k] for g in group], dtype=np.int64) for k in (6, 7))
        registers = np.frombuffer(b"".join(g[8] for g in group), dtype=np.uint16).reshape(-1, REGISTERS)
        union, n = _Union(comp), len(group)
        reach = np.searchsorted(size, np.floor_divide(100 * size, percent), side="right")
        step = max(1, PAIRS // n)  # rows whose pairs are judged at once
        for top in range(0, n, step):
            i = np.arange(top, min(n, top + step))
            count = reach[i] - i - 1
            left = np.repeat(i, count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            apart = union.label[left] != union.label[right]
            left, right = left[apart], right[apart]
            for start in range(0, len(left), PAIRS):
                a, b = left[start : start + PAIRS], right[start : start + PAIRS]
                close = (registers[a] == registers[b]).sum(1) >= REGISTERS * floor_of(percent) * 0.9
                a, b = a[close], b[close]
                if len(a):
                    near = plausible(registers[a], registers[b], size[a], size[b], percent)
                    for k, m in zip(a[near].tolist(), b[near].tolist(), strict=True):
                        if union.merge(k, m):
                            yield int(comp[k]), int(comp[m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _runs(batches, 4):
            found += compare(group)
            if len(found) > 4096:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return map_arrow(rows, run, "a long, b long")


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(both):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        hit = both[at] == value
        return row[hit], at[hit]

    (ra, ca), (rb, cb) = places(a), places(b)
    for start in range(0, len(both), 8192):
        width = min(8192, len(both) - start)
        sides = []
        for row, col, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            dense = np.zeros((n, width), dtype=np.float32)
            use = (col >= start) & (col < start + width)
            dense[row[use], col[use] - start] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _settle(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes of different components of a family, enough of
    them to connect all that are linked. ``members``: (family, id, component,
    n)."""
    rows = _blocks(_with_largest(members, "family"), "family", "largest")
    rows = docs.select(F.col("doc_id").alias("d"), "text").join(rows, F.col("d") == F.col("id"))
    rows = rows.select("family", "k", "t1", "t2", "id", "component", "text")
    rows = rows.repartition("family", "k", "t1", "t2").sortWithinPartitions("family", "k", "t1", "t2", "id")

    def links(group: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        group.sort(key=lambda g: (len(g[2]), g[0]))
        ids, comp = (np.array([g[k] for g in group], dtype=np.int64) for k in (0, 1))
        size = np.array([len(g[2]) for g in group])
        union = _Union(comp)
        for p in range(0, len(group), 256):
            for q in range(p, len(group), 256):
                one, two = slice(p, p + 256), slice(q, q + 256)
                if 100 * size[one][-1] < percent * size[two][0]:
                    break
                if len(np.unique(np.concatenate([union.label[one], union.label[two]]))) < 2:
                    continue
                common = _intersections([g[2] for g in group[one]], [g[2] for g in group[two]])
                total = size[one][:, None] + size[two][None, :] - common
                for i, j in np.argwhere((100 * common >= percent * total) & (comp[one][:, None] != comp[two][None, :])).tolist():
                    if union.merge(p + i, q + j):
                        yield int(ids[p + i]), int(ids[q + j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = buffers(batch.column(6))
                set_row, values = shingles(data, offsets, width)
                ends = np.cumsum(np.bincount(set_row, minlength=batch.num_rows))
                begins = np.concatenate([[0], ends[:-1]])
                for i, (*block, doc, component) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                    if block != key:
                        found += links(group)
                        key, group = block, []
                    if ends[i] > begins[i]:
                        group.append((doc, component, values[begins[i] : ends[i]].copy()))
            if len(found) > 4096:
                yield _pairs(found)
                found = []
        found += links(group)
        yield _pairs(found)

    return map_arrow(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``
    (doc_id long, text string)."""
    return _judged(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the digest of every row's set, written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(sketches(docs, width), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.any_value("registers").alias("registers"))
    # An identifier that repeats with different texts may lead several classes.
    classes = materialize(classes, "classes")

    # Bands are hashed before they become rows: a row is two numbers, not a copy of the registers.
    hashed = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    buckets = materialize(classes.select("id", hashed.alias("bands")).select("id", F.explode("bands").alias("bucket")), "bands")
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("bucket", "a")
    crowded = materialize(buckets.join(shared, "bucket").select("bucket", "id", "a").distinct(), "buckets")
    release(buckets)

    # The texts of classes that share a bucket move once; what follows joins these.
    docs = materialize(docs.join(crowded.select(F.col("id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi"), "texts")

    # One comparison a class: with the smallest of the bucket it shares most.
    votes = crowded.where("id <> a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("bands"))
    first = votes.groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct(F.col("bands"), -F.col("a"))).alias("a")).select("a", "b")
    links = materialize(verify(docs, materialize(_screen(first, classes, percent), "pairs"), width, percent), "links")
    labels = materialize(connected_components(links, "a", "b"), "labels")
    reclaim(docs.sparkSession)

    named = crowded.select("bucket", "id").join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("bucket")
    mixed = materialize(named.join(mixed, "bucket", "left_semi"), "mixed")
    near = materialize(_plausible_families(mixed, classes, percent), "near")
    if not near.isEmpty():
        families = connected_components(near, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("family"))
        member = mixed.select("id", "component").distinct().join(families, F.col("component") == F.col("c")).drop("c").join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
        more = materialize(_settle(docs, materialize(member, "family-members"), width, percent), "links")
        if not more.isEmpty():
            labels = materialize(connected_components(links.union(more), "a", "b"), "labels")
    release(crowded)

    led = classes.join(labels, F.col("id") == F.col("node"), "left").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("k3"), F.coalesce("component", "id").alias("named"))
    joined = sketched.select("doc_id", "n_shingles", "h1", "h2").join(led, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n_shingles") == F.col("k3")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id"))
    out = joined.select("doc_id", "n_shingles", "h1", "h2", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "judged")
    for done in (sketched, classes, docs, links, labels, mixed, near):
        release(done)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` less the documents that are in a group and not its smallest;
    all columns kept. Documents that go are few columns wide: their
    identifiers are joined against the table. Where only some rows of an
    identifier go, those go that have the set of a row that goes."""
    judged = _judged(docs.select("doc_id", "text"), width, percent).where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "h1", "h2", "kept")
    ids = judged.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every"))
    rest = docs.join(ids.where("NOT some").select("__id"), F.col("doc_id") == F.col("__id"), "left_anti")
    mixed = materialize(ids.where("some AND NOT every").select("__id"), "mixed-ids")
    if mixed.isEmpty():
        return rest
    texts = docs.join(mixed, F.col("doc_id") == F.col("__id"), "left_semi").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    known = sketches(texts, width).select(F.col("doc_id").alias("__text"), "n_shingles", "h1", "h2")
    gone = judged.where("NOT kept").join(mixed, F.col("doc_id") == F.col("__id"), "left_semi").withColumnRenamed("doc_id", "__id")
    gone = gone.join(known, ["n_shingles", "h1", "h2"]).select("__id", "__text").distinct()
    return rest.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left_anti")


def op10_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
