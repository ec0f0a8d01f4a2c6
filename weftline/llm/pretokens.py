"""Encode whole texts through a cache of their repeating units.

A byte-level BPE merges inside pre-tokens only, so a text's ids are the ids of
its pre-tokens in order. Texts are first cut at single blanks: `` word`` with
its blank is a run of whole pre-tokens whatever stands around it, as long as
the piece neither is empty nor begins or ends in white space. Where a piece
does, the whole text takes the general path, the pattern itself. Either way
each unit's ids come from the tokenizer library.

The cut, the search for known pieces and the gathering of ids are columnar: a
piece met before costs a probe of a hash table. Of the pieces that are new,
words of Latin letters are one unit, and such words with ASCII marks behind
them two (both by the pattern, which is checked when a cache is made); only
what is left reaches Python. Known pieces and units are bounded in number: the
cache changes speed, not results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Known pieces, about 25 bytes each, and units, about 200 bytes each in either
#: of two generations. Pieces that the last column didn't use go at the bound.
PIECES, UNITS = 600_000, 150_000
#: Bytes of known pieces: long ones count too.
PIECE_BYTES = 32 << 20
#: Letters of the Latin script that every Unicode version calls letters, and
#: the ASCII marks without the apostrophe.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-&(-/:-@\[-`{-~"
PLAIN, TAILED = f"^[{LETTERS}]+$", f"^[{LETTERS}]+[{MARKS}]+$"
STEM, TAIL = f"^[{LETTERS}]+", f"[{MARKS}]+$"

#: Units to their ids in a row, and how many ids each has.
Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def letters_of(units: pa.Array, table: dict[int, str]) -> list[str]:
    """Every unit with its bytes as letters; ``table``: byte -> letter."""
    size = np.asarray(pc.binary_length(units)).astype(np.int64)
    ends = np.cumsum(size)
    data = b"".join(units.cast(pa.binary()).to_pylist()) if len(units) else b""
    mapped = data.decode("latin-1").translate(table)
    return [mapped[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


class Generations:
    """A dictionary of at most two generations; the older one goes when the
    younger is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: list) -> list:
        """The keys that are in neither; those found in the old one move."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out


class UnitCache:
    """``marks`` are strings whose presence sends a text to ``special``."""

    def __init__(self, pattern: str, encode: Encode, limit: int = PIECES, marks: tuple[str, ...] = (), special: Callable[[str], bytes] | None = None):
        self.findall = regex.compile(pattern).findall
        self.encode_units, self.marks, self.special, self.limit = encode, marks, special, limit
        marks_too = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
        self.simple = self.findall(" aZÀÖØöøſ") == [" aZÀÖØöøſ"] and self.findall(" a" + marks_too) == [" a", marks_too]
        self.units = Generations(min(limit, UNITS))
        self._hold(pa.array([], pa.string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4"))

    def _hold(self, known: pa.Array, size: np.ndarray, pool: np.ndarray) -> None:
        """Known pieces, how many ids each has (-1: the piece is odd), and the
        ids of all in a row."""
        self.known, self.size, self.pool = known, size, pool
        self.begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)

    def _add(self, pieces: pa.Array, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = len(self.known) + np.arange(len(pieces))
        self._hold(pa.concat_arrays([self.known, pieces]), np.concatenate([self.size, size]), np.concatenate([self.pool, ids]))
        return at

    def _fill(self, units: set[str]) -> dict[str, bytes]:
        missing = self.units.missing(list(units))
        if missing:
            ids, count = self.encode_units(pa.array(missing, pa.string()))
            ends = np.cumsum(count).tolist()
            self.units.young.update((u, ids[a:b].tobytes()) for u, a, b in zip(missing, [0, *ends], ends, strict=False))
        return self.units.young

    def general(self, texts: list[str]) -> list[bytes]:
        """Texts by the pattern alone."""
        cut = [self.findall(t) for t in texts]
        unit = self._fill({u for units in cut for u in units})
        return [b"".join([unit[u] for u in units]) for units in cut]

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Adds pieces; their numbers."""
        out = np.zeros(len(fresh), dtype=np.int64)
        plain = np.asarray(pc.match_substring_regex(fresh, PLAIN)) & self.simple
        tailed = np.asarray(pc.match_substring_regex(fresh, TAILED)) & self.simple
        words = fresh.filter(pa.array(plain))
        ids, count = self.encode_units(pc.binary_join_element_wise("", words, " "))
        out[plain] = self._add(words, count, ids)
        if tailed.any():
            pieces = fresh.filter(pa.array(tailed))
            stem = self._places(pc.replace_substring_regex(pieces, TAIL, ""))
            tail = pc.replace_substring_regex(pieces, STEM, "").dictionary_encode()
            ids, count = self.encode_units(tail.dictionary)
            place = np.stack([stem, len(self.known) + np.asarray(tail.indices)], axis=1).ravel()
            # the marks stand behind the known pieces while both halves are gathered
            held = (self.known, self.size, self.pool)
            self._hold(self.known, np.concatenate([self.size, count]), np.concatenate([self.pool, ids]))
            both, end = self._gather(place)
            self._hold(*held)
            out[tailed] = self._add(pieces, np.diff(np.concatenate([[0], end[1::2]])), both)
        odd = ~plain & ~tailed
        if odd.any():
            pieces = fresh.filter(pa.array(odd))
            cut = [self.findall(" " + p) if p and p[0].strip() and p[-1].strip() else None for p in pieces.to_pylist()]
            unit = self._fill({u for us in cut if us for u in us})
            ids = [b"" if us is None else b"".join([unit[u] for u in us]) for us in cut]
            size = np.array([-1 if us is None else len(x) >> 2 for us, x in zip(cut, ids, strict=True)], dtype=np.int64)
            out[odd] = self._add(pieces, size, np.frombuffer(b"".join(ids), dtype="<u4"))
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The number of every piece among the known ones."""
        found = pc.index_in(pieces, value_set=self.known)
        place = np.asarray(found.fill_null(-1)).astype(np.int64)
        if found.null_count:
            new = pieces.filter(found.is_null()).dictionary_encode()
            place[place < 0] = self._learn(new.dictionary)[np.asarray(new.indices)]
        return place

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces in a row, and where each piece's end."""
        length = np.maximum(self.size[place], 0)
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.begin[place] - (end - length), length) + np.arange(total)], end

    def _forget(self, place: np.ndarray) -> None:
        if len(self.known) > self.limit or self.known.nbytes > PIECE_BYTES:
            keep = np.unique(place)
            pool, _ = self._gather(keep)
            self._hold(self.known.take(pa.array(keep)), self.size[keep], pool)

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of every text of a string column, as little-endian uint32;
        null is empty."""
        column = column.fill_null("").cast(pa.string())
        cut, n = pc.split_pattern(column, " "), len(column)
        flat, first = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
        first = first - first[0]
        head = flat.take(pa.array(first[:-1])).to_pylist()  # every text has one piece at least
        tail = np.ones(len(flat), dtype=bool)
        tail[first[:-1]] = False
        place = self._places(flat.filter(pa.array(tail)))
        row = np.repeat(np.arange(n), np.diff(first) - 1)
        irregular = np.zeros(n, dtype=bool)
        irregular[row[self.size[place] < 0]] = True
        gathered, end = self._gather(place)
        self._forget(place)
        border = np.concatenate([[0], end])[first - np.arange(n + 1)].tolist()

        for i, h in enumerate(head):
            irregular[i] |= not h[-1].strip() if h else first[i + 1] - first[i] > 1
        marked = np.zeros(n, dtype=bool)
        for mark in self.marks:
            marked |= np.asarray(pc.match_substring(column, mark))
        heads_done = self.general([("" if odd else h) for h, odd in zip(head, irregular.tolist(), strict=True)])
        out = [h + gathered[a:b].tobytes() for h, a, b in zip(heads_done, border, border[1:], strict=False)]
        slow = np.flatnonzero(irregular & ~marked).tolist()
        if slow:
            for i, done in zip(slow, self.general([column[i].as_py() for i in slow]), strict=True):
                out[i] = done
        for i in np.flatnonzero(marked).tolist():
            out[i] = self.special(column[i].as_py())
        return out
