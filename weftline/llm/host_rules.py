"""Quality rules at host level.

Document rules come first (word count, repeated three-word windows and the
descriptive counts beside them). Their failures are then counted by host, the
hosts' failure rates are shrunk with a beta prior whose two parameters are
estimated from the hosts themselves, and the verdict on a host goes back to its
documents: a document stays if it passes its own rules and its host is sound.

The prior is fitted by the method of moments on the hosts' rates, weighted by
their sizes. A host is rejected when its shrunk rate is above ``HOST_RATE`` and
stays above it after ``HOST_MARGIN`` posterior standard deviations are taken
off; a host of a few documents is thus pulled to the common rate and kept.

Defined cases: a null text has no words and fails; a null host belongs to no
host, takes no part in the fit and gets no host verdict; repeated rows count
once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table
from weftline.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_RATE = 0.5
HOST_MARGIN = 3.0
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def measure(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20\x09-\x0D only
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    duplicates = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                duplicates += 1
            elif line.strip(BLANKS):
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count: dict = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            covered = 0  # end of the words counted so far
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return n, chars, symbols, duplicates, repeated


def failed(n_words: int, n_repeat_words: int, min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> bool:
    return n_words < min_words or 100 * n_repeat_words > max_percent * n_words


def measures(docs: DataFrame, keys: list[str], text: str = "text", min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``keys`` and the five counts and the base verdict of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(len(keys)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keys))]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            columns.append(pa.array([failed(r[0], r[4], min_words, max_percent) for r in rows], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])

    schema = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keys)
    return map_arrow(docs.select(*keys, text), run, f"{schema}, {MEASURES}")


def host_verdicts(counted: DataFrame, host: str, rate: float = HOST_RATE, margin: float = HOST_MARGIN) -> DataFrame:
    """One row per host from rows of (host, base_failed): counts, the shrunk
    rate and the verdict. One partial aggregation by host; the fit is a second
    aggregation over hosts and joins back as a single row."""
    hosts = counted.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    p = F.col("host_failed") / F.col("host_docs")
    fit = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("host_docs").alias("total"),
        F.sum(F.col("host_docs") * F.col("host_docs")).alias("squares"),
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"),
        F.sum(F.col("host_docs") * p * p).alias("second"),
    )
    # Between-host variance: the weighted spread of the rates, less what
    # binomial sampling explains. strength = a + b of the beta prior.
    spread = F.col("second") / F.col("total") - F.col("mean") * F.col("mean")
    noise = F.col("mean") * (1 - F.col("mean")) * F.col("k") / F.col("total")
    between = F.greatest(spread - noise, F.lit(0.0))
    strength = F.when(F.col("mean") * (1 - F.col("mean")) <= 0, F.lit(2.0)).otherwise(
        F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1e4))
    )
    prior = fit.select(F.col("mean").alias("prior_mean"), strength.alias("prior_strength"))
    n = F.col("host_docs") + F.col("prior_strength")
    shrunk = (F.col("host_failed") + F.col("prior_mean") * F.col("prior_strength")) / n
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("host_rate", shrunk)
        .withColumn("host_bad", F.col("host_rate") - F.lit(margin) * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + 1)) > F.lit(rate))
        .drop("prior_mean", "prior_strength")
    )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts, base verdict and final verdict of every row of ``docs``."""
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = materialize(measures(counted, ["doc_id", "host"]), "host-rules")
    # Written first: its size is known when the join is planned, so documents
    # move by host only where rejected hosts are many.
    bad = materialize(host_verdicts(counted, "host").where("host_bad").select(F.col("host").alias("bad_host")), "bad-hosts")
    judged = counted.join(bad, counted["host"] == bad["bad_host"], "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns kept.

    The rules run twice over the texts, once for the hosts' counts and once to
    filter: that costs less than carrying every text through a shuffle.
    """
    counted = measures(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), ["host"])
    bad = materialize(host_verdicts(counted, "host").where("host_bad").select(F.col("host").alias("__bad_host")), "bad-hosts")
    sound = docs.join(bad, F.col(host) == F.col("__bad_host"), "left_anti")
    at = sound.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not failed(r[0], r[4]) for r in rows], pa.bool_()))

    return map_arrow(sound, run, sound.schema)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = quality_rules(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same counts and verdicts in DuckDB SQL. Words are ASCII-blank separated
#: runs; a window's key is its three words with their positions kept apart.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS key
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, key) > 1),
pos AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, sum(c - 1) AS n FROM lines GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN pos USING (rid) LEFT JOIN dup USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
fit AS (SELECT count(*) AS k, sum(n) AS total, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS second FROM h),
pr AS (SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 2.0 ELSE
         least(greatest(mean * (1 - mean) / greatest(greatest(second - mean * mean - mean * (1 - mean) * k / total, 0), 1e-9) - 1, 2.0), 1e4) END AS s FROM fit),
v AS (SELECT source, (f + mean * s) / (n + s) AS r, n + s AS ns FROM h, pr),
bad AS (SELECT source FROM v WHERE r - 3.0 * sqrt(r * (1 - r) / (ns + 1)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad USING (source)
"""
