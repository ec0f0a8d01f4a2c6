"""A hash-chained audit log: entries that name the digest of the one before."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FIELDS = "at who role action payload".split()
SCHEMA = "seq long, at string, who string, role string, action string, payload string, prev_hash string, hash string"
START = "0" * 64


def _digest() -> F.Column:
    """SHA-256 of an entry as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct("seq", *FIELDS, "prev_hash"), {"ignoreNullFields": "false"}), 256)


def append(spark: SparkSession, entries: Iterable[dict], last: Row | None = None) -> DataFrame:
    """``entries`` (dicts of FIELDS) chained after the row ``last``. Every digest needs the one
    before it, so a batch of entries is chained by one fold in one row; a log
    grows by small batches."""
    seq, hashed = (last["seq"], last["hash"]) if last else (0, START)
    rows = [tuple(e.get(f) for f in FIELDS) for e in entries]
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    batch = spark.createDataFrame([(rows,)], f"entries array<struct<{', '.join(f'{f}: string' for f in FIELDS)}>>")
    entry = "named_struct('seq', {n} + size(done) + 1L, " + ", ".join(f"'{f}', e.{f}" for f in FIELDS) + ", 'prev_hash', {prev})"
    made = entry.format(n=f"{seq}L", prev=f"coalesce(try_element_at(done, -1).hash, '{hashed}')")
    kind = f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    step = f"concat(done, transform(array({made}), s -> named_struct('seq', s.seq, {', '.join(f'{chr(39)}{f}{chr(39)}, s.{f}' for f in [*FIELDS, 'prev_hash'])}, 'hash', sha2(to_json(s, map('ignoreNullFields', 'false')), 256))))"
    return batch.select(F.explode(F.expr(f"aggregate(entries, cast(array() as {kind}), (done, e) -> cast({step} as {kind}))")).alias("r")).select("r.*")


def verify(log: DataFrame) -> DataFrame:
    """One row (intact, entries, broken_at): the first entry whose digest or
    link is wrong, that is missing its forerunner, or that shares its number.
    The forerunner is met by an equality on the number, not by one global
    window. An empty log is intact."""
    before = log.groupBy((F.col("seq") + 1).alias("next")).agg(F.min("hash").alias("before"), F.count(F.lit(1)).alias("copies"))
    met = log.join(before, F.col("seq") == F.col("next"), "left")
    linked = F.when(F.col("seq") == 1, F.col("prev_hash") == START).otherwise((F.col("prev_hash") == F.col("before")) & (F.col("copies") == 1))
    good = F.coalesce(linked & (F.col("hash") == _digest()), F.lit(False))
    return met.agg(F.coalesce(F.every(good), F.lit(True)).alias("intact"), F.count(F.lit(1)).alias("entries"), F.min(F.when(~good, F.col("seq"))).alias("broken_at"))
