"""A training corpus from raw documents: quality rules, near-duplicates,
benchmark decontamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``.

Defined cases, for every stage: a null text counts as empty where it is read and
stays null where it is kept; the first stage drops null, empty and short texts,
for they fail the rules; rows without an identifier are never near-duplicates of
others; rows that repeat, identifier included, share their fate; ties between
copies go to the smallest identifier; texts of any length are read whole; extra
columns, whatever their names, are carried along by all stages but the last; an
empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table
from weftline.llm.host_rules import keep_good
from weftline.llm.piece_bpe import encode_decode
from weftline.llm.secrets import redact
from weftline.llm.set_sketch import keep_one
from weftline.llm.tiling import remove_contaminated
from weftline.session import materialize, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 0.8 or more of their five-word shingles
    in common, the one with the smallest identifier stays."""
    return keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half or more of a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become placeholders; every document stays."""
    return redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests."""
    return encode_decode(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: Near-duplicate groups, tilings and ids are beyond SQL; tests/llm holds
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage's table goes once the next
    one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
