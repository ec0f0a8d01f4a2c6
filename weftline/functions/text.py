"""Text functions as columns: digits, scripts, phonetic keys, amounts.

All but ``romanize`` are built-in expressions and stay in generated code.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Latin letters of the Devanagari consonants in code order
#: from U+0915 (- where a letter has none), of consonants with a dot below, of
#: the independent vowels and of the vowel signs.
_CONSONANTS = "k kh g gh ng ch chh j jh n t th d dh n t th d dh n - p ph b bh m y r - l l - v sh sh s h".split()
_DOTTED = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "d", "ढ": "dh", "फ": "f"}
_VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a aa i ee u oo ri e ai o au".split(), strict=True))
_SIGNS = dict(zip("ािीुूृेैोौ", "aa i ee u oo ri e ai o au".split(), strict=True))
_NASAL, _BREATH, _SILENT, _DOT = "ंँ", "ः", "्", "़"

CONSONANTS = {chr(0x915 + k): latin for k, latin in enumerate(_CONSONANTS) if latin != "-"}
DIGITS = "".join(chr(0x966 + k) for k in range(10))
_SYLLABLE = re.compile(f"([{''.join(CONSONANTS)}])({_DOT}?)([{''.join(_SIGNS)}{_SILENT}]?)")
_RUN = re.compile("[ऀ-ॿ]+")


def _syllable(m: re.Match) -> str:
    letter, dot, sign = m.groups()
    head = _DOTTED.get(letter, CONSONANTS[letter]) if dot else CONSONANTS[letter]
    return head + ("" if sign == _SILENT else _SIGNS.get(sign, "a"))


_REST = str.maketrans({**_VOWELS, **_SIGNS, **dict.fromkeys(_NASAL, "n"), _BREATH: "h", **{c: str(k) for k, c in enumerate(DIGITS)}})


def _run(m: re.Match) -> str:
    latin = _SYLLABLE.sub(_syllable, unicodedata.normalize("NFC", m[0])).translate(_REST)
    latin = re.sub(r"([aeiou])\1+", r"\1", latin)
    return re.sub(r"\ba\b", "", latin).strip()


def romanized(text: str | None) -> str:
    """Devanagari runs in Latin letters, the rest as it is. Consonants carry a
    short a unless a vowel sign or the silencing sign follows."""
    return _RUN.sub(_run, text or "")


@F.pandas_udf(T.StringType())
def _romanize(column: pd.Series) -> pd.Series:
    return column.map(romanized)


def has_devanagari(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u0900-\\u097F]"), F.lit(False))


def romanize(c: Column) -> Column:
    """``romanized`` of a column; rows without Devanagari stay in the JVM."""
    return F.when(has_devanagari(c), _romanize(F.when(has_devanagari(c), c))).otherwise(F.coalesce(c, F.lit("")))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, "0123456789")


def script(c: Column) -> Column:
    return F.when(has_devanagari(c), "devanagari").otherwise("latin")


def skeleton(c: Column) -> Column:
    """Phonetic key of a Latin word: letters only, ph as f, near letters as
    one, no vowel or y after the head, runs of a letter as one."""
    letters = F.translate(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", ""), "ph", "f"), "qzwx", "kjvk")
    tail = F.regexp_replace(F.substring(letters, 2, 1 << 20), "[aeiouy]", "")
    return F.regexp_replace(F.concat(F.substring(letters, 1, 1), tail), r"(.)\1+", "$1")


def name_key(c: Column) -> Column:
    """Sorted skeletons of a name's words, whatever their order."""
    words = F.split(romanize(c), r"[\s.]+")
    return F.array_sort(F.filter(F.transform(words, skeleton), lambda k: k != ""))


#: What the words for round numbers multiply by.
UNITS = {"crore": 10_000_000, "cr": 10_000_000, "lakhs": 100_000, "lakh": 100_000, "l": 100_000, "thousand": 1_000, "k": 1_000}
AMOUNT = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|cr|lakhs|lakh|l|thousand|k)?\b"


def amount(c: Column) -> Column:
    """The first amount of a text in whole units: digits, commas, and a word
    for a round number; null where there is none."""
    number = F.regexp_replace(F.regexp_extract(c, AMOUNT, 1), ",", "")
    word, times = F.lower(F.regexp_extract(c, AMOUNT, 2)), F.lit(1)
    for name, value in UNITS.items():
        times = F.when(word == name, value).otherwise(times)
    return F.when(number != "", (number.cast("decimal(30,4)") * times).cast("long"))


def context(text: Column, start: Column, end: Column, window: int = 90) -> Column:
    """The words around text[start:end] (code points from 0), on one line, with
    dots where the text goes on."""
    a, b = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(text))
    inner = F.translate(F.substring(text, a + 1, b - a), "\n", " ")
    return F.concat(F.when(a > 0, "...").otherwise(""), inner, F.when(b < F.length(text), "...").otherwise(""))


def encrypt(c: Column, key: bytes) -> Column:
    """AES-GCM under a key of 16, 24 or 32 bytes, base64."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM")))


def decrypt(c: Column, key: bytes) -> Column:
    """The text again; null where the key or the bytes are wrong."""
    return F.try_aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")
