"""Secret scans.

Three patterns find secrets whose form is known. Beside them, candidate runs
are scored by two character Markov models, one of random strings and one of
ordinary identifiers: the log-likelihood ratio per character and in total
decides. Both models are trained here, from labelled samples (``training``):
random strings over the alphabets of keys, and identifiers put together, in the
usual styles, from the whole words of a public multilingual vocabulary. One word
in ``HELD_WORDS`` is never trained on, so tests can measure on unseen words.

A base span is the whole match, key word included; it is never moved or
dropped. Assignments cut a run, since what stands before a key word is a name;
what is left is scored whole, and of a run that passes, the parts outside base
spans are reported where they themselves look more random than ordinary.

Defined cases: a null text is empty and has no spans; a text of any length is
scanned whole; repeated rows each get their own row; an empty table gives an
empty result; other columns are carried by ``redact`` and not read here.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table

#: The kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that the models look at; shorter ones carry too little evidence.
MIN_RUN = 16
#: Short runs that are spelled like a word, in letters of one case after the
#: first, aren't scored: long words of other languages pass the bounds.
SHORT, WORDLIKE = 20, re.compile(r"[A-Za-z](?:[a-z]+|[A-Z]+)")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A run is reported above both: nats per character, and nats in total.
PER_CHAR, IN_TOTAL = 0.7, 20.0

#: The vocabulary whose words the ordinary sample is made of; of these words,
#: one in so many is kept out of the training.
WORDS, HELD_WORDS = "byte_bpe_multi_50k.tiktoken", 5
#: Labelled samples a class.
SAMPLE = 15_000
#: Letters of a run, in the models' order; 0 stands for the start.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = np.zeros(128, dtype=np.int64)
_INDEX[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)


@lru_cache(maxsize=2)
def words(held: bool = False, path: str | None = None) -> tuple[str, ...]:
    """Whole words of three or more ASCII letters in the vocabulary's order;
    those kept out of the training, or the rest."""
    import public_tokenizers

    from weftline.llm.piece_bpe import read_ranks

    tokens = read_ranks(path or public_tokenizers.path(WORDS))
    found = dict.fromkeys(t[1:].decode().lower() for t in tokens if len(t) > 3 and t[:1] == b" " and t[1:].isalpha() and t.isascii())
    return tuple(w for w in found if (zlib.crc32(w.encode()) % HELD_WORDS == 0) == held)


def training(seed: int = 7, size: int = SAMPLE, held: bool = False) -> list[tuple[str, int]]:
    """Labelled samples: 1 a random string, 0 an ordinary identifier. ``size``
    of each; the same for any input, so a document's result never depends on
    the corpus around it."""
    rng, ordinary = random.Random(seed), words(held)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = (upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + "234567", upper + digits, lower + digits, digits + "abcdef", digits + "ABCDEF")
    out = []
    for _ in range(size):
        letters = rng.choice(alphabets)
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(16, 48))), 1))
        parts = [rng.choice(ordinary) for _ in range(rng.randint(1, 6))]
        style = rng.randrange(8)
        if style == 0:
            name = "_".join(parts)
        elif style == 1:
            name = "-".join(parts)
        elif style == 2:
            name = "".join(p.title() for p in parts)
        elif style == 3:
            name = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 4:
            name = "_".join(parts).upper()
        elif style == 5:
            name = "/".join(parts)
        elif style == 6:
            name = "-".join(p.title() for p in parts)
        else:
            name = "".join(parts)
        if rng.random() < 0.3:
            name += rng.choice(["", "_", "-"]) + rng.choice(["1", "2", "v2", "2023", "2024", "01", "10", "64", "3000", "20240115"])
        out.append((name, 0))
    return out


@lru_cache(maxsize=1)
def log_ratio() -> np.ndarray:
    """log P(c | two before) under the random model less the same under the
    ordinary one. Both models of order two lean on those of order one and zero
    where a context was seldom seen."""
    n = len(LETTERS) + 1
    models = []
    samples = training()
    for label in (0, 1):
        own = [_INDEX[np.frombuffer(b"\0\0" + t.encode(), dtype=np.uint8)] for t, y in samples if y == label]
        flat = np.concatenate(own)
        inner = np.ones(len(flat), dtype=bool)
        starts = np.cumsum([0, *map(len, own)])[:-1]
        inner[starts] = inner[starts + 1] = False
        at = np.flatnonzero(inner)
        counts = np.bincount((flat[at - 2] * n + flat[at - 1]) * n + flat[at], minlength=n**3).reshape(n, n, n).astype(float)
        pairs = counts.sum(axis=0)
        pairs[0] = np.bincount(flat[at[flat[at - 1] == 0]], minlength=n)
        single = counts.sum(axis=(0, 1)) + 1.0
        single[0] = 0
        low = single / single.sum()
        one = (pairs + 20 * low) / (pairs.sum(axis=1, keepdims=True) + 20)
        models.append((counts + 10 * one) / (counts.sum(axis=2, keepdims=True) + 10))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log(models[1]) - np.log(models[0]))


def ratios(run: str) -> np.ndarray:
    """The log-likelihood ratio of each character after the two before."""
    codes = _INDEX[np.frombuffer(b"\0\0" + run.encode(), dtype=np.uint8)]
    return log_ratio()[codes[:-2], codes[1:-1], codes[2:]]


def score(run: str) -> float:
    """The total log-likelihood ratio of a run, random over ordinary."""
    return float(ratios(run).sum())


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of start..end that no span covers; ``spans`` are in order."""
    out = []
    for s, e in spans:
        if s < end and start < e:
            if start < s:
                out.append((start, s))
            start = max(start, e)
    if start < end:
        out.append((start, end))
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order; kind indexes ``KINDS``."""
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found = list(base)
    waiting, at = [], 0
    for m in RUN.finditer(text):
        # runs and base spans are both in order: each span is met by the runs
        # that it touches only, and leaves when a run starts behind it
        while at < len(base) and base[at][0] < m.end():
            waiting.append(base[at])
            at += 1
        waiting = near = [w for w in waiting if w[2] > m.start()]
        for start, end in outside(*m.span(), [(s, e) for s, k, e in near if k == 0]):
            free = outside(start, end, [(s, e) for s, k, e in near if k]) if end - start >= MIN_RUN else []
            if not free or (end - start < SHORT and WORDLIKE.fullmatch(text, start, end)):
                continue
            each = ratios(text[start:end])
            total = float(each.sum())
            if total > IN_TOTAL and total > PER_CHAR * (end - start):
                found += [(s, 3, e) for s, e in free if len(free) == 1 and (s, e) == (start, end) or each[s - start : e - start].sum() > 0]
    found.sort()
    return found


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the spans as structs, and the counts and digests of them."""
    spans_type = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t or "") for t in batch.column(1).to_pylist()]
            bases = [[s for s in spans if s[1] < 3] for spans in found]
            struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[1] == k for s in spans) for spans in bases], pa.int64()) for k in range(3)]
            columns.append(pa.array([hashlib.sha256(render(b).encode()).hexdigest() for b in bases], pa.string()))
            columns.append(pa.array([render(spans) for spans in found], pa.string()))
            columns.append(pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in found], struct))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {spans_type}"
    return map_arrow(docs.select(doc_id, text), run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by ``<KIND>``; overlaps count once,
    under the kind that starts first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked and ``length`` (if there is
    such a column) brought up to date for the texts that changed; a null text
    stays null. No row goes, no column is added."""
    at = docs.columns.index(text)
    length_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            spans = [find(t) if t else [] for t in old]
            if any(spans):
                new = [mask(t, s) if s else t for t, s in zip(old, spans, strict=True)]
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.column(at).type)
                if length_at is not None:
                    sizes = [len(t) if s else n for t, s, n in zip(new, spans, batch.column(length_at).to_pylist(), strict=True)]
                    columns[length_at] = pa.array(sizes, batch.column(length_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return map_arrow(docs, run, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = scan(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.size("found").cast("long").alias("n_spans"))
