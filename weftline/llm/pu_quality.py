"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents that ``labels.quality`` marks 1 in the
training folds; everything else is unlabelled web text. A small network is
fitted by the non-negative unbiased risk: with prior p, the risk of calling
unlabelled text negative, less p times the same risk on positives, estimates
the negatives' risk and is kept from going below zero. The prior is estimated
first, from a positive-against-unlabelled fit: above a threshold where almost
only positives are left, the share of unlabelled text over the share of
positives tends to the prior; the smallest upper bound of it is taken.

Features of whole texts are computed once and written. The means and scales
that standardise them, and the shares of unlabelled text that the prior rests
on, are of every training row. Only the gradient fit sees a bounded sample
(``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, chosen by a hash of identifier
and features; equal rows count once): what it loses is detail of the decision
border where the corpus is larger, not the level of the scores, which the prior
sets. Every document is scored. Features come from the text alone.

Defined cases: a null or empty text has zero features and gets the score that
these have; a null identifier is not held out and never in the sample;
repeated rows are scored alike; without any positive in the training folds
every score is 0.5; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table
from weftline.llm.textvec import buffers, prefix_hash, shingles, slices, span_hash, words
from weftline.session import materialize, release

MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
FOLDS, HELD_OUT = 3, 1
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 40, 512, 5e-3, 11

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "shout", "bar", "stop", "comma", "newline", "non_ascii",
    "short_words", "long_words", "distinct_words", "adjacent_equal", "repeat_2", "repeat_3", "symbol_words", "empty",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz")
_SYMBOL, _SHOUT, _BAR, _STOP, _COMMA, _LINE = _mask("#*$%&<>"), _mask("!"), _mask("|"), _mask("."), _mask(","), _mask("\n")
_HIGH = np.arange(256) >= 0xC0


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = buffers(column)
    n = len(offsets) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    s, e, row = words(data, offsets)
    count = np.bincount(row, minlength=n).astype(float)
    safe = np.maximum(count, 1)
    length = e - s
    by_row = lambda values: np.bincount(row, weights=values, minlength=n) / safe
    hashed = span_hash(prefix_hash(data), s, e) if len(s) else np.zeros(0, dtype=np.uint64)
    same = np.zeros(len(s))
    if len(s) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    symbol_total = np.concatenate([[0], np.cumsum((_SYMBOL | _SHOUT)[data], dtype=np.int64)])
    with_symbol = (symbol_total[e] > symbol_total[s]).astype(float) if len(s) else np.zeros(0)
    distinct = [np.bincount(shingles(data, offsets, k)[0], minlength=n).astype(float) for k in (1, 2, 3)]
    windows = [np.maximum(count - k, 1) for k in (0, 1, 2)]
    letters = np.maximum(per_row(_LETTER), 1)
    columns = [
        np.log1p(count), by_row(length) / 10, per_row(_UPPER) / letters, 10 * per_row(_DIGIT) / size, per_row(_SYMBOL) / safe, per_row(_SHOUT) / safe,
        per_row(_BAR) / safe, per_row(_STOP) / safe, per_row(_COMMA) / safe, per_row(_LINE) / safe, per_row(_HIGH) / size,
        by_row(length <= 2), by_row(length >= 12), distinct[0] / windows[0], by_row(same),
        1 - np.minimum(distinct[1] / windows[1], 1), 1 - np.minimum(distinct[2] / windows[2], 1), by_row(with_symbol), (count == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """To twelve decimals: the last digits depend on a batch's size."""
        return np.round(1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40))), 12)


def _train(z: np.ndarray, positive: np.ndarray, prior: float | None, seed: int) -> list[np.ndarray]:
    """Adam on mini-batches. With a prior: the non-negative unbiased risk under
    the sigmoid loss; without: plain logistic loss, positive against
    unlabelled, both classes weighted alike."""
    rng = np.random.default_rng(seed)
    d = z.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 2e-4
        order = rng.permutation(u)
        for start in range(0, len(order), BATCH):
            bu = order[start : start + BATCH]
            bp = rng.choice(p, min(BATCH, len(p)), replace=False)
            x = z[np.concatenate([bp, bu])]
            is_p = np.arange(len(x)) < len(bp)
            hidden = np.tanh(x @ weights[0] + weights[1])
            s = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3][0], -40, 40)))
            share = np.where(is_p, 1 / len(bp), 1 / len(bu))
            if prior is None:
                slope = (s - is_p) * share
            else:
                # sigmoid loss: 1-s of calling it positive, s of calling it negative
                negative_risk = s[~is_p].mean() - prior * s[is_p].mean()
                if negative_risk >= 0:
                    slope = s * (1 - s) * share * np.where(is_p, -2 * prior, 1.0)
                else:  # take back what would drive it below zero
                    slope = s * (1 - s) * share * np.where(is_p, prior, -1.0)
            back = slope[:, None] * weights[2] * (1 - hidden**2)
            grads = [x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-5 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def estimate_prior(positive: np.ndarray, cut: np.ndarray, above: np.ndarray, n: int, delta: float = 0.1) -> float:
    """The smallest upper confidence bound of share(unlabelled above t) over
    share(positive above t), over all thresholds t; ``above``: the shares of
    ``n`` unlabelled margins at or above each of ``cut``."""
    qp = 1 - np.searchsorted(np.sort(positive), cut, side="left") / len(positive)
    slack = lambda n: np.sqrt(np.log(4 / delta) / (2 * n))
    usable = qp > 0.05
    bound = (above[usable] + (slack(n) + slack(len(positive))) * np.sqrt(qp[usable] * (1 - qp[usable]) + 1e-4)) / qp[usable]
    at = int(np.argmin(bound))
    return float(np.clip(above[usable][at] / qp[usable][at], 0.02, 0.98))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row, as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "x"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, x binary")


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, len(FEATURES))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every feature, over all rows: a batch gives its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(0)), pa.array((x * x).sum(0)), pa.array(np.full(x.shape[1], len(x)))], names=["k", "s", "q", "n"])

    sums = map_arrow(rows.select("x"), run, "k int, s double, q double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    found = sums.toPandas().sort_values("k")
    n = np.maximum(found["n"].to_numpy(), 1)
    mean = found["s"].to_numpy() / n
    scale = np.sqrt(np.maximum(found["q"].to_numpy() / n - mean * mean, 0))
    # sums depend on their order in the last digits
    return np.round(mean, 9), np.where(scale < 1e-6, 1.0, np.round(scale, 9))


def _shares_above(rows: DataFrame, model: Network, cut: np.ndarray) -> tuple[np.ndarray, int]:
    """The share of all rows whose margin is at or above each of ``cut`` (at
    most one number for every positive of the sample), and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.bincount(np.searchsorted(cut, model.margin(_unpack(batch.column(0))), side="right"), minlength=len(cut) + 1)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["k", "n"])

    found = map_arrow(rows.select("x"), run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    count = np.bincount(found["k"], weights=found["n"], minlength=len(cut) + 1)
    total = int(count.sum())
    return (total - np.cumsum(count)[:-1]) / max(total, 1), total


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Network | None:
    """Fit on the training folds of ``docs`` (doc_id, text)."""
    held = materialize(with_features(docs), "features")
    model = learn_features(held, labels, max_positive, max_unlabelled)
    release(held)
    return model


def learn_features(rows: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Network | None:
    """The same from (doc_id, x). The sample is a hash slice whose share comes
    from exact counts, equal rows taken once, so its size stays near the bounds
    at any scale and however often an identifier repeats."""
    train = F.col("doc_id").isNotNull() & ~held_out()
    trusted = labels.where(train & (F.col("quality") == 1)).select("doc_id").distinct()
    corpus = rows.where(train)
    positive = corpus.join(trusted, "doc_id", "left_semi")

    def sample(part: DataFrame, salt: str, most: int) -> np.ndarray:
        n = part.select("doc_id").count()
        place = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("x")), F.lit(1 << 30))
        chosen = part.where(place < int(min(1.0, most / max(n, 1)) * (1 << 30))).dropDuplicates(["doc_id", "x"]).limit(2 * most).toPandas()
        chosen = chosen.assign(x=chosen["x"].map(bytes)).sort_values(["doc_id", "x"], kind="stable")
        return np.frombuffer(b"".join(chosen["x"]), dtype=np.float64).reshape(-1, len(FEATURES))

    p = sample(positive, "p", max_positive)
    u = sample(corpus, "u", max_unlabelled) if len(p) else p
    if not len(p) or not len(u):
        return None
    mean, scale = _moments(corpus)
    z = np.clip((np.concatenate([p, u]) - mean) / scale, -8, 8)
    is_p = np.arange(len(z)) < len(p)
    ranker = Network(mean, scale, _train(z, is_p, None, SEED), 0.5)
    margins = ranker.margin(p)
    cut = np.unique(margins)
    prior = estimate_prior(margins, cut, *_shares_above(corpus, ranker, cut))
    return Network(mean, scale, _train(z, is_p, prior, SEED + 1), prior)


def score(docs: DataFrame, model: Network | None) -> DataFrame:
    """Every row of (doc_id, text) with its score."""
    return score_features(with_features(docs), model)


def score_features(rows: DataFrame, model: Network | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else model.score(_unpack(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_arrow(rows.select("doc_id", "x"), run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = materialize(with_features(docs.select("doc_id", "text")), "features")
    model = learn_features(rows, labels.select("doc_id", "quality"))
    return score_features(rows, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
