"""Byte-level BPE through a sentencepiece model built from a rank file.

No tokenizer is trained: the model's protocol buffer is written directly. Each
token of the rank file becomes a piece, its bytes mapped to printable letters
one to one, scored by its negative rank, so that the merge with the highest
score is the merge with the lowest rank; the normaliser is the identity, no
blank is added and none is escaped. A pre-token that is a token as a whole is
that token at once, which is how rank files are read; the rest goes through
the model. Decoding maps ids back to bytes and joins them.

Defined cases: a null text is empty and has no ids; any text, however long, is
encoded whole, with no special tokens; repeated rows each get their row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import BATCH_BYTES, map_arrow, table
from weftline.llm.pretokens import UnitCache, letters_of
from weftline.llm.textvec import slices

RANKS = "byte_bpe_multi_50k.tiktoken"


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank. Ranks are dense from 0."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not dense")
    return [found[i] for i in range(len(found))]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """A printable letter for each byte: the byte's own where it prints, else
    one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces in rank order, then the unknown
    piece that the format asks for and that no text reaches."""
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        score = np.float32(-rank).tobytes()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + score + _flag(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(-len(tokens)).tobytes() + _flag(3, 2)))
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens)) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class PieceCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        letters = byte_letters()
        self.table = dict(enumerate(letters))
        self.whole = {"".join(letters[b] for b in t): [i] for i, t in enumerate(self.tokens)}
        self.cache = UnitCache(pattern, self._units)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        mapped = letters_of(units, self.table)
        out: list = [self.whole.get(u) for u in mapped]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.model.encode([mapped[i] for i in rest], num_threads=1) if rest else (), strict=True):
            out[i] = ids
        count = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter(chain.from_iterable(out), dtype="<u4", count=int(count.sum())), count

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        return self.cache.encode(column)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PieceCodec:
    return PieceCodec(path, pattern)


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row: the number of ids, the digest of the ids, and the digest of
    the bytes that the ids decode to; with ``keep_ids`` the ids themselves."""
    import public_tokenizers

    path, pattern = path or default_path(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, text, BATCH_BYTES):
                count, encoded, decoded, kept = [], [], [], []
                for ids in coder.encode(batch.column(1)):
                    values = np.frombuffer(ids, dtype="<u4")
                    count.append(len(values))
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(values)).hexdigest())
                    if keep_ids:
                        kept.append(values.astype(np.int32))
                columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(doc_id, text), run, schema)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
