"""Benchmark decontamination by greedy string tiling.

Test items that share a seed (``SEED_WORDS`` words in a row) with a document,
or as many ``MIN_MATCH``-grams as tiles of half the item must hold, are
compared with it by greedy string tiling: the longest match of still
unmarked words is marked in both texts, again and again, down to
``MIN_MATCH`` words, the matches of each length being found by Karp-Rabin
hashes. The share of an item's words that tiles cover is its coverage: a
passage whose parts stand in another order is covered as well as one that was
copied whole, since tiles need no order. A document is contaminated where the
coverage of any item reaches ``COVERAGE``.

Words are runs of letters and digits, lower-cased, so punctuation and case
don't hide a copy. The words of a document become numbers in the vocabulary of
the test items, all others -1; documents never move: items come to them, in
blocks of at most ``BLOCK_WORDS`` words that each task holds while the table
is read once per block (one block for tens of thousands of items).

Only the stretches of a document that can hold a tile are tiled: the runs
around shared ``MIN_MATCH``-grams of the item. Equal lengths are marked in
order of document position, then item position.

Defined cases: a null or empty text is clean; a null, empty or wordless item
matches nothing; an item of fewer than ``SEED_WORDS`` words is its own seed
and counts only when it occurs whole; repeated items and repeated documents
each count; empty tables give no hits; other columns are kept by
``remove_contaminated`` and not read here.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table
from weftline.llm.textvec import mix64

SEED_WORDS = 5
MIN_MATCH = 3
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def greedy_tiles(pattern: list, text: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(pattern position, text position, length) of the tiles. Works on any
    hashable tokens; None matches nothing."""
    p_marked, t_marked = [False] * len(pattern), [t is None for t in text]
    tiles: list[tuple[int, int, int]] = []
    modulus, base = (1 << 61) - 1, 1_000_003
    p_code, t_code = [hash(w) % modulus for w in pattern], [hash(w) % modulus for w in text]

    def windows(codes: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(position, rolling hash) of the windows without a marked token."""
        top, value, run = pow(base, size, modulus), 0, 0
        for i, code in enumerate(codes):
            if marked[i]:
                run, value = 0, 0
                continue
            value = (value * base + code) % modulus
            run += 1
            if run > size:
                value = (value - codes[i - size] * top) % modulus
            if run >= size:
                yield i - size + 1, value

    def longest() -> int:
        """An upper bound of the next length: the longest common unmarked run."""
        best, row = 0, {}
        places = defaultdict(list)
        for i, w in enumerate(pattern):
            if not p_marked[i]:
                places[w].append(i)
        for j, w in enumerate(text):
            if t_marked[j]:
                row = {}
                continue
            row = {i: row.get(i - 1, 0) + 1 for i in places.get(w, ())}
            best = max(best, max(row.values(), default=0))
        return best

    size = longest()
    while size >= min_match:
        at = defaultdict(list)
        for i, value in windows(p_code, p_marked, size):
            at[value].append(i)
        marked_any = False
        for j, value in list(windows(t_code, t_marked, size)):
            if any(t_marked[j : j + size]):
                continue
            for i in at.get(value, ()):
                if not any(p_marked[i : i + size]) and pattern[i : i + size] == text[j : j + size]:
                    p_marked[i : i + size] = [True] * size
                    t_marked[j : j + size] = [True] * size
                    tiles.append((i, j, size))
                    marked_any = True
                    break
        size = min(size, longest()) if marked_any else size - 1
    return tiles


def least_grams(length: int, min_match: int, threshold: float) -> int:
    """The fewest places of an item at which a gram of ``min_match`` words
    starts that also stands in the text, if tiles cover ``threshold`` of it:
    a tile of t words holds t - min_match + 1, and short tiles hold least."""
    start = max(min_match, math.ceil(threshold * length - 1e-9))
    return min((c - (min_match - 1) * (c // min_match) for c in range(start, length + 1)), default=1)


class ItemBlock:
    """A block of test items as a task holds it."""

    def __init__(self, items: list[tuple[int, list[str]]], seed_words: int, min_match: int, threshold: float = COVERAGE):
        self.seed_words, self.min_match, self.threshold = seed_words, min_match, threshold
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary: dict[str, int] = {}
        self.codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64) for _, words in self.items]
        self.word_hash = mix64(np.arange(1, len(self.vocabulary) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size = defaultdict(list)
        for n, codes in enumerate(self.codes):
            by_size[min(seed_words, len(codes))].append(n)
        for size, numbers in by_size.items():
            hashes = [self._grams(self.codes[n], size) for n in numbers]
            flat, owner = np.concatenate(hashes), np.repeat(numbers, [len(h) for h in hashes])
            order = np.argsort(flat, kind="stable")
            self.seeds[size] = (flat[order], owner[order])
        long = [n for n, codes in enumerate(self.codes) if len(codes) >= max(seed_words, min_match)]
        hashes = [self._grams(self.codes[n], min_match) for n in long]
        flat, owner = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), np.repeat(np.array(long, dtype=np.int64), [len(h) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.grams = (flat[order], owner[order])
        self.least = np.full(len(self.codes), np.iinfo(np.int64).max)
        self.least[long] = [least_grams(len(self.codes[n]), min_match, threshold) for n in long]

    def _grams(self, codes: np.ndarray, size: int) -> np.ndarray:
        """A hash of every window; windows with a foreign word get whatever
        their hash is and are masked by the caller."""
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        value = np.zeros(n, dtype=np.uint64)
        coded = self.word_hash[codes]
        for k in range(size):
            value = mix64(value * np.uint64(0xD6E8FEB86659FD93) + coded[k : k + n])
        return value

    def _shared(self, codes: np.ndarray, known: np.ndarray, size: int, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The owner of every place of an item whose gram stands in the text."""
        whole = np.flatnonzero(known[size:] - known[:-size] == size) if len(codes) >= size else np.zeros(0, dtype=np.int64)
        if not len(whole):
            return owner[:0]
        value = np.zeros(len(whole), dtype=np.uint64)
        for k in range(size):
            value = mix64(value * np.uint64(0xD6E8FEB86659FD93) + self.word_hash[codes[whole + k]])
        value = np.unique(value)
        lo, hi = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        n = hi - lo
        return owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(item, words covered, coverage) of every item that shares a seed or
        is covered by the threshold."""
        if not self.items or not text:
            return []
        words = tokens(text)
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        found: set[int] = set()
        for size, (values, owner) in self.seeds.items():
            found.update(self._shared(codes, known, size, values, owner).tolist())
        counts = np.bincount(self._shared(codes, known, self.min_match, *self.grams), minlength=len(self.codes))
        more = set(np.flatnonzero(counts >= self.least).tolist()) - found
        rows = [(n, *self._cover(n, codes)) for n in sorted(found | more)]
        return [(self.items[n][0], covered, share) for n, covered, share in rows if n in found or share >= self.threshold]

    def _cover(self, n: int, codes: np.ndarray) -> tuple[int, float]:
        item = self.codes[n]
        size = min(self.min_match, len(item))
        part = np.flatnonzero(np.isin(codes, item))
        # Runs of the item's words that are long enough for a tile, a gap between.
        cut = np.flatnonzero(np.diff(part) > 1) + 1
        text: list = []
        grams = set(map(tuple, np.lib.stride_tricks.sliding_window_view(item, size).tolist()))
        # A tile covers ``size`` words of the item at least, so there are at most
        # ``most`` of them. While fewer are laid, one of the first ``most``
        # copies of a run is untouched and offers at an earlier place whatever a
        # later copy does: the later ones never get a tile.
        most, seen = len(item) // size, Counter()
        for run in np.split(part, cut):
            if len(run) >= size:
                values = codes[run].tolist()
                windows = [tuple(values[k : k + size]) for k in range(len(values) - size + 1)]
                if any(w in grams for w in windows):
                    seen[key := tuple(values)] += 1
                    if seen[key] <= most:
                        text += [None, *values]
        covered = sum(length for _, _, length in greedy_tiles(item.tolist(), text, size))
        return covered, covered / len(item)


def blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items on the driver, a block of bounded size at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        words = tokens(row[1])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, min_match: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, n_covered, coverage) of every document and item that
    share a seed or reach ``COVERAGE``."""
    item_type, doc_type = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    schema = f"doc_id {doc_type}, item_id {item_type}, n_covered int, coverage double"
    source, out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    for block in blocks(items, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(ItemBlock(block, seed_words, min_match))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                rows = [(d, *hit) for d, t in enumerate(batch.column(1).to_pylist()) for hit in index.hits(t or "")]
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], items_arrow), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_covered", "coverage"])

        from pyspark.sql.pandas.types import to_arrow_type

        items_arrow = to_arrow_type(items.schema[item_id].dataType)
        part = map_arrow(source, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that cover some item by ``threshold`` or more;
    all columns kept."""
    at, out = docs.columns.index(text), docs
    for block in blocks(items, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(ItemBlock(block, SEED_WORDS, MIN_MATCH, threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                clean = [all(c < threshold for _, _, c in index.hits(t or "")) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = map_arrow(out, run, docs.schema)
    return out


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share a seed or reach ``COVERAGE``, with
    coverage and verdict."""
    hits = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumn("contaminated", F.col("coverage") >= COVERAGE)
