"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. File layout::

    block*  zstd of: entries, each  varint shared, varint unshared, varint size,
            key[shared:], ids (little-endian, ``width`` bytes each)
    index   per block: varint key length, last key, varint offset, varint
            length, varint entries
    bloom   bits, ``BLOOM_HASHES`` probes of ``BLOOM_BITS`` bits a key
    footer  fixed size: offsets and lengths of index and bloom, counts, width,
            crc32 of index and bloom, magic

A key shares a prefix with the one before it in its block; the first key of a
block is whole. A lookup asks the Bloom filter, bisects the block index and
reads one block. Keys are nine bytes that sort as the identifiers do: a null
flag, then the signed 64-bit number with its sign bit flipped, high byte first.

Shards come from a range partitioning by identifier, so that their order is
the global order; a task streams its rows into one file and keeps one block in
memory. Defined cases: a null text is empty and holds the end id alone; a null
identifier sorts before all others; rows that share an identifier stand side
by side, ordered by text; an empty table makes no shard; other columns are not
read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import BATCH_BYTES, map_arrow, table
from weftline.llm.pretokens import UnitCache, letters_of
from weftline.llm.storage import open_input, replacing
from weftline.llm.textvec import mix64, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Pre-tokens that the library gets at once.
UNITS_A_CALL = 20_000
MAGIC = b"WSST0001"
FOOTER = struct.Struct("<QQQQQQQBII8s")


def key_of(identifier: int | None) -> bytes:
    return b"\0" * 9 if identifier is None else b"\1" + struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit positions, one row a key: double hashing of a 64-bit mix."""
    number = np.frombuffer(b"".join(k[1:] for k in keys), dtype=">u8").astype(np.uint64) + np.frombuffer(b"".join(k[:1] for k in keys), dtype=np.uint8)
    one = mix64(number)
    two = mix64(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (one[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


class ShardWriter:
    """Append (key, ids) in key order to an open stream, then ``finish``."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.entries = self.ids = 0
        self.block, self.block_size, self.block_entries = [], 0, 0
        self.last = b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block_size >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.block_entries:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.block_entries += 1
        self.entries += 1
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)

    def _flush(self) -> None:
        if self.block_entries:
            data = self.pack(b"".join(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(data)) + _varint(self.block_entries))
            self.at += len(data)
            self.block, self.block_size, self.block_entries = [], 0, 0

    def finish(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-self.entries * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, dtype=bool)
        for i in range(0, len(self.keys), 1 << 16):
            bloom[_probes(self.keys[i : i + (1 << 16)], bits).ravel()] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.index), self.entries, self.ids, self.width, zlib.crc32(index), zlib.crc32(packed), MAGIC))


class ShardReader:
    """Reads a shard back: in order, or one document by binary search."""

    def __init__(self, path: str):
        self.file = open_input(path)
        end = self.file.size()
        parts = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        index_at, index_size, bloom_at, bloom_size, _, self.entries, self.ids, self.width, index_crc, bloom_crc, magic = parts
        index, bloom = self._at(index_at, index_size), self._at(bloom_at, bloom_size)
        if magic != MAGIC or zlib.crc32(index) != index_crc or zlib.crc32(bloom) != bloom_crc:
            raise ValueError(f"{path}: not a whole shard")
        self.bloom = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8), bitorder="little")
        self.last_keys, self.blocks, at = [], [], 0
        while at < len(index):
            size, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + size])
            offset, at = _read_varint(index, at + size)
            length, at = _read_varint(index, at)
            _, at = _read_varint(index, at)
            self.blocks.append((offset, length))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._at(*self.blocks[i]))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return bool(self.bloom[_probes([key], len(self.bloom))[0]].all())

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document under ``key``; usually one or none."""
        if not self.may_hold(key):
            return []
        found, i = [], bisect.bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            for k, ids in self.block(i):
                if k == key:
                    found.append(ids)
            if self.last_keys[i] != key:
                break
            i += 1
        return found

    def close(self) -> None:
        self.file.close()


class LibraryEncoder:
    """The tokenizers library's byte-level BPE over cached pre-tokens. A text
    that holds one of the vocabulary's added tokens goes to the library whole.

    Units go to the library as one sequence that is cut already; since every
    byte is a token and tokens spell their unit, the lengths of the tokens tell
    where each unit's ids end."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        from weftline.llm.piece_bpe import byte_letters

        self.library = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.bare = Tokenizer(Tokenizer.from_file(path).model)
        vocabulary = self.bare.get_vocab(False)
        if not set(self.letters.values()) <= vocabulary.keys():
            raise ValueError(f"{path}: not a byte-level vocabulary")
        self.spelled = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.spelled[number] = len(token)

        def special(text: str) -> bytes:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

        added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.cache = UnitCache(pattern, self._units, marks=added, special=special)
        self.width = 2 if max(self.library.get_vocab_size(True) - 1, END_ID) < 1 << 16 else 4

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, count = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(units), UNITS_A_CALL):
            part = letters_of(units.slice(start, UNITS_A_CALL), self.letters)
            found = np.array(self.bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            ends, wanted = np.cumsum(self.spelled[found]), np.cumsum([len(p) for p in part])
            last = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[last], wanted):
                raise ValueError("tokens don't spell their units")
            ids.append(found)
            count.append(np.diff(np.concatenate([[-1], last])))
        return np.concatenate(ids), np.concatenate(count)

    def encode(self, column: pa.Array) -> list[bytes]:
        return self.cache.encode(column)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write; one row per shard: its number, path and counts."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, first = task.partitionId(), next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        coder = encoder(path, pattern)
        last = np.asarray([end_id], dtype="<u4").tobytes()
        name = f"{folder}/shard-{number:06d}.sst"
        with replacing(name, str(task.taskAttemptId())) as out:
            shard = ShardWriter(out, coder.width)
            batch = first
            while batch is not None:
                for piece in slices(batch, "text", BATCH_BYTES):
                    for identifier, ids in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1)), strict=True):
                        shard.add(key_of(identifier), np.frombuffer(ids + last, dtype="<u4"))
                batch = next(batches, None)
            shard.finish()
        yield pa.RecordBatch.from_pydict({"shard": [number], "path": [name], "n_docs": [shard.entries], "n_ids": [shard.ids]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return map_arrow(ordered, run, "shard long, path string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """One row per document from the files: identifier, ``start`` over all
    shards, number of ids and their crc32. ``shards``: path and number of ids
    of every file, in order; a few bytes a file are all that the driver holds."""
    base, plan = 0, []
    for path, ids in shards:
        plan.append((path, base))
        base += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, start = plan[i]
                reader = ShardReader(path)
                rows: list = []
                for key, ids in reader:
                    rows.append((identifier_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                reader.close()
                yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=schema)

    if not plan:
        columns = [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
        return spark.createDataFrame([], T.StructType(columns))
    numbers = spark.range(0, len(plan), 1, len(plan))
    return map_arrow(numbers, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.session import scratch_path

    folder = scratch_path(spark, "sst")
    # One row a shard; sorted here, since a sort in Spark would sample its
    # input first and so write every shard twice.
    shards = sorted(write_shards(table(spark, sf_dir, "documents"), folder).collect(), key=lambda s: s["shard"])
    return read_shards(spark, [(s["path"], s["n_ids"]) for s in shards])
