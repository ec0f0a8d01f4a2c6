"""Name similarity and the grouping of records into entities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import materialize

THRESHOLD = 0.75
#: Words of a name that name nobody.
NOISE = {"mr", "mrs", "shri", "smt", "alias", "urf", "one", "accused", "subject"}


#: Spellings of one name word.
VARIANTS = {"shaikh": "sheikh", "fareed": "farid", "bhosle": "bhosale", "quraishi": "qureshi", "seth": "sethi", "kr": "kumar", "chouhan": "chauhan", "jhadav": "jadhav", "yadhav": "yadav"}


def skeleton(word: str) -> str:
    """Phonetic key: letters, ph as f, near letters as one, no vowel or y after
    the head, no doubled letter."""
    letters = re.sub("[^a-z]", "", word.lower()).replace("ph", "f").translate(str.maketrans("qzwx", "kjvk"))
    return re.sub(r"(.)\1+", r"\1", letters[:1] + re.sub("[aeiouy]", "", letters[1:]))


def words(name: str | None) -> list[str]:
    found = (re.sub("[^a-z]", "", w) for w in re.split(r"[\s.]+", (name or "").lower()))
    return [VARIANTS.get(w, w) for w in found if w and w not in NOISE]


def keys(name: str | None) -> list[str]:
    """What a name is blocked on: the keys of its words of four letters or more."""
    return sorted({skeleton(w) for w in words(name) if len(w) >= 4})


def _fits(x: str, y: str) -> bool:
    short, long = sorted((x, y), key=len)
    return long.startswith(short) if len(short) == 1 else skeleton(x) == skeleton(y)


def similarity(a: str | None, b: str | None) -> float:
    """0 to 1. Names without a common key are unlike. Else the share of the
    longer name's words that find a partner, each partner used once; a name of
    two written-out words all found in the other counts as 1 (0.85 where the
    other has two or more words besides)."""
    left, right = words(a), words(b)
    if left == right:
        return 1.0 if left else 0.0
    if not set(keys(a)) & set(keys(b)):
        return 0.0
    free, paired = list(right), 0
    for x in left:
        partner = next((y for y in free if _fits(x, y)), None)
        if partner is not None:
            free.remove(partner)
            paired += 1
    few, many = sorted((len(left), len(right)))
    if few == paired >= 2 and len(keys(a if len(left) <= len(right) else b)) >= 2:
        return 1.0 if many - few < 2 else 0.85
    return paired / many


def resolve(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, entity) of ``records`` (id long, name string, identifiers
    array<string>): records that share an identifier, or whose names are
    similar, are one entity, named after its smallest record.

    Identifiers give stars. Names are compared once each, however many records
    bear them, and only with names of a common key; so work grows with the
    square of the different names of a key, not of its records. A null name or
    identifier links nothing.
    """
    records = records.select(F.col("id").cast("long").alias("id"), "name", "identifiers").where("id IS NOT NULL")
    held = records.select("id", F.explode(F.array_distinct("identifiers")).alias("k")).where("k IS NOT NULL")
    stars = held.join(held.groupBy("k").agg(F.min("id").alias("first")), "k").select("first", "id")
    names = records.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("first"))
    same = records.join(names, "name").select("first", "id")
    blocked = materialize(names.select("name", F.col("first").alias("id"), F.explode(F.pandas_udf(lambda s: s.map(keys), "array<string>")("name")).alias("k")), "name-keys")
    left, right = (blocked.select("k", F.col("id").alias(i), F.col("name").alias(n)) for i, n in (("a", "an"), ("b", "bn")))
    pairs = left.join(right, "k").where("an < bn").select("a", "b", "an", "bn").distinct()
    scored = F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float), "double")
    near = pairs.where(scored("an", "bn") >= threshold).select("a", "b")
    links = stars.union(same).union(near).toDF("a", "b").where("a <> b")
    found = connected_components(links, "a", "b")
    return records.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("entity"))
