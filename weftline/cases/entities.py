"""Observations of people as entities: who is who, why, and under what name.

Linking is ``operators.names.resolve`` on romanised names: shared identifiers
as stars, names compared once each within phonetic blocks. Then one aggregation
an entity.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import has_devanagari, romanize
from weftline.operators.names import THRESHOLD, keys, resolve, similarity, words
from weftline.operators.numbering import numbered
from weftline.session import materialize


@F.pandas_udf(T.IntegerType())
def full_words(names: pd.Series) -> pd.Series:
    """Written-out words of a name."""
    return names.map(lambda n: sum(len(w) > 1 for w in words(n))).astype("int32")


@F.pandas_udf(T.IntegerType())
def known_words(names: pd.Series) -> pd.Series:
    return names.map(lambda n: len(words(n))).astype("int32")


def with_ids(observed: DataFrame) -> DataFrame:
    """Observations that name somebody, numbered in an order of their own, so
    that entities come out the same whatever the order of the input."""
    named = observed.withColumn("name", F.trim("name")).withColumn("latin", romanize(F.col("name")))
    named = named.where(F.col("name").isNotNull()).where(known_words("latin") > 0)
    return materialize(numbered(named, ["source_type", "source_id", "name", F.to_json(F.struct("phones", "accounts", "vehicles"))], "id"), "observed")


def decisions(observed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, reason, score) of every two spellings that are one person, each
    reason once: all that qualify, whatever was joined before. Cross-spelling
    ones first by ``same``."""
    held = observed.select("id", "name", F.explode(F.array_distinct(F.concat("phones", "accounts"))).alias("ident")).where("ident IS NOT NULL AND ident <> ''")
    first = held.groupBy("ident").agg(F.min_by("name", "id").alias("a"), F.min("id").alias("_first"))
    shared = held.join(first, "ident").where("id <> _first").select("a", F.col("name").alias("b"), F.concat(F.lit("shared identifier "), "ident").alias("reason"), F.lit(1.0).alias("score"))
    blocked = F.pandas_udf(lambda s: s.map(keys), "array<string>")
    alike = F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float), "double")
    names = observed.groupBy("name").agg(F.min("latin").alias("latin"), F.min("id").alias("id"))
    block = materialize(names.withColumn("k", F.explode(blocked("latin"))), "decision-keys")
    side = lambda s: block.select("k", F.col("id").alias(f"i{s}"), F.col("name").alias(s), F.col("latin").alias(f"l{s}"))
    pairs = side("a").join(side("b"), "k").where("ia < ib").select("a", "b", "la", "lb").distinct().withColumn("score", alike("la", "lb")).where(F.col("score") >= threshold)
    by_name = pairs.select("a", "b", F.format_string("name match %s ~ %s (score %.2f)", "a", "b", "score").alias("reason"), F.round("score", 2).alias("score"))
    return shared.unionByName(by_name).dropDuplicates(["a", "b", "reason"]).withColumn("same", F.col("a") == F.col("b"))


def entities(observed: DataFrame, decided: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(entity, id, label, aliases, phones, accounts, vehicles, sources,
    merge_evidence) of ``with_ids``; ``records`` (source_id, prior_cases,
    offence_categories, active_period, police_district) adds the criminal
    record: null where nobody looked, 0 where nothing was found. The label is
    the spelling with most written-out words, Latin before Devanagari, then the
    longest; ids are P0001 ... in the order of each entity's first observation."""
    linked = observed.select("id", F.col("latin").alias("name"), F.concat("phones", "accounts").alias("identifiers"))
    member = observed.join(resolve(linked), "id")
    deva = has_devanagari(F.col("name"))
    # among Latin spellings of equal length the first stands
    weight = F.struct(full_words("latin").alias("full"), (~deva).alias("is_latin"), F.length("name").alias("size"), (-F.col("id")).alias("first"))
    flat = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x != "")))
    rolled = member.withColumn("w", weight).groupBy("entity").agg(
        F.max_by(F.when(deva, F.initcap("latin")).otherwise(F.col("name")), "w").alias("label"), F.array_sort(F.collect_set("name")).alias("names"), flat("phones").alias("phones"), flat("accounts").alias("accounts"), flat("vehicles").alias("vehicles"),
        F.array_sort(F.collect_set(F.concat_ws(":", "source_type", "source_id"))).alias("sources"),
    )
    rolled = rolled.withColumn("aliases", F.array_except("names", F.array("label"))).drop("names")
    if decided is not None:
        owner = member.groupBy("name").agg(F.min("entity").alias("entity"))
        why = decided.join(owner, F.col("a") == F.col("name")).groupBy("entity").agg(F.array_sort(F.collect_set("reason")).alias("merge_evidence"))
        rolled = rolled.join(why, "entity", "left").withColumn("merge_evidence", F.coalesce("merge_evidence", F.array().cast("array<string>")))
    if records is not None:
        fields = ["prior_cases", "offence_categories", "active_period", "police_district"]
        # the last record that says something wins, field by field
        said = member.where("source_type = 'criminal_record'").select("entity", "id", "source_id").join(records.select("source_id", *fields), "source_id")
        last = said.groupBy("entity").agg(*(F.max_by(c, F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "-"), F.col("id"))).alias(c) for c in fields))
        rolled = rolled.join(last, "entity", "left")
    return numbered(rolled, ["entity"], "_n").withColumn("id", F.format_string("P%04d", "_n")).drop("_n")


def mode_of(rows: DataFrame, keys_: list[str], value: str) -> DataFrame:
    """The most frequent value of every group; ties go to the smallest."""
    count = rows.groupBy(*keys_, value).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*keys_).orderBy(F.desc("n"), value)
    return count.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
