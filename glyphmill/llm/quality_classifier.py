"""Regularised quadratic discriminant quality classifier (operator 2).

Each class has a mean and a covariance over transformed document statistics.  Covariances are shrunk towards the
identity in units of the pooled standard deviation, factorised once (Cholesky), and a document's score is the logistic
of the difference of the two Mahalanobis log densities plus log priors.  The sums that the fit needs are added up on
the cluster over all labelled rows; the driver gets 2 * (1 + d + d * d) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import bucket_of, drop_table, map_batches, write_table

SYMBOLS = b"#*$%&<>"
STATISTICS = (
    "log_words", "symbols", "bars", "bangs", "upper", "distinct_words", "runs", "word_length", "stops", "repeated_lines", "digits", "distinct_pairs",
)

#: Share of the identity in each shrunk covariance, and the scale of the log density difference.
SHRINKAGE = 0.1
TEMPERATURE = 3.0
THRESHOLD = 0.3
#: Up to so many labelled ids (2 MB) are broadcast to find their documents; beyond, they are joined.
LOOKUP_ROWS = 200_000


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = [_mask(c) for c in (SYMBOLS, b"|", b"!", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:?", bytes(range(48, 58)))]


def _distinct_counts(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.diff(kernels.distinct_sorted(hashes, firsts)[1])


def _lines(data: np.ndarray, bounds: np.ndarray, words: np.ndarray, firsts: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line with a word, as the chained hash of its words, and offsets per text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    first = np.searchsorted(word_at, starts)
    used = np.concatenate((first[1:], [len(words)])) > first
    first, starts = first[used], starts[used]
    if len(first) == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    lengths = np.diff(np.append(first, len(words)))
    place = np.arange(first[0], len(words)) - np.repeat(first, lengths)
    salted = kernels.mix(words[first[0] :] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(salted, first - first[0]), np.searchsorted(starts, bounds)


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of whole texts, one row per text (nulls and empty texts: zeros)."""
    out = np.zeros((len(texts), len(STATISTICS)))
    texts = kernels.plain(texts)
    for start, stop in kernels.runs(texts):
        part = texts[start:stop]
        data, bounds = kernels.buffer(part)
        words, firsts, word_at = kernels.word_hashes(part, places=True)
        n = np.maximum(np.diff(firsts), 1).astype(float)
        counts = []
        for mask in _CLASSES:
            total = np.concatenate(([0], np.cumsum(mask[data])))
            counts.append(np.diff(total[bounds]))
        symbols, bars, bangs, upper, lower, stops, digits = counts
        same = np.concatenate(([0], np.cumsum(words[1:] == words[:-1]), [0]))[: len(words) + 1] if len(words) else np.zeros(1)
        repeats = same[np.maximum(firsts[1:] - 1, 0)] - same[np.minimum(firsts[:-1], max(len(words) - 1, 0))]
        pairs, pair_firsts = kernels.shingle_hashes(words, firsts, 2)
        lines, line_firsts = _lines(data, bounds, words, firsts, word_at)
        n_lines = np.maximum(np.diff(line_firsts), 1)
        columns = (
            np.log1p(np.diff(firsts)),
            np.sqrt(symbols / n),
            np.sqrt(bars / n),
            np.sqrt(bangs / n),
            np.sqrt(upper / np.maximum(upper + lower, 1)),
            np.log(np.maximum(_distinct_counts(words, firsts), 1)) / np.log(n + 1),
            np.sqrt(np.maximum(repeats, 0) / n),
            np.log((symbols + upper + lower + stops + digits + 1) / n),
            np.sqrt(stops / n),
            np.sqrt(1 - _distinct_counts(lines, line_firsts) / n_lines) * (np.diff(line_firsts) > 0),
            np.sqrt(digits / n),
            np.log(np.maximum(_distinct_counts(pairs, pair_firsts), 1)) / np.log(n + 1),
        )
        block = np.stack(columns, axis=1)
        block[np.diff(firsts) == 0] = 0
        out[start:stop] = block
    return out


@dataclass(frozen=True)
class QuadraticModel:
    """Class means, inverted lower Cholesky factors of the covariances, and the constant of the density difference."""

    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiteners: tuple[np.ndarray, np.ndarray]
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x / self.scale
        distance = []
        for mean, whitener in zip(self.means, self.whiteners, strict=True):
            y = (z - mean) @ whitener.T
            distance.append((y * y).sum(axis=1))
        gap = 0.5 * (distance[0] - distance[1]) + self.offset
        return 1 / (1 + np.exp(-np.clip(gap / TEMPERATURE, -30, 30)))


def _moments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
    label = batch.column(1).to_numpy(zero_copy_only=False)
    for c in np.unique(label):
        part = x[label == c]
        values = np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["label", "k", "v"])


def fit_quality(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = SHRINKAGE) -> QuadraticModel:
    """Fit on rows of `features(id, x)` that have a label 0 or 1 (null ids and other labels are left out).

    A class without rows takes the other's moments, so scores fall back to the prior.  A row with several labels counts once
    with each.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    found = map_batches(features.join(marks, "id").select("x", "label"), _moments, "label int, k int, v double")
    sums = {(r.label, r.k): r.v for r in found.groupBy("label", "k").agg(F.sum("v").alias("v")).collect()}
    d = len(STATISTICS)
    raw = [np.array([sums.get((c, k), 0.0) for k in range(1 + d + d * d)]) for c in (0, 1)]
    if not (raw[0][0] + raw[1][0]):
        return QuadraticModel(np.ones(d), (np.zeros(d),) * 2, (np.eye(d),) * 2, 0.0)
    n = [r[0] for r in raw]
    pooled = raw[0] + raw[1]
    mean = pooled[1 : 1 + d] / pooled[0]
    variance = np.maximum(np.diag(pooled[1 + d :].reshape(d, d)) / pooled[0] - mean**2, 0)
    scale = np.sqrt(np.where(variance > 1e-9, variance, 1.0))
    means, whiteners, logs = [], [], []
    for c in (0, 1):
        own = raw[c] if n[c] else pooled
        m = own[1 : 1 + d] / own[0]
        cov = own[1 + d :].reshape(d, d) / own[0] - np.outer(m, m)
        cov = cov / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(d)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        means.append(m / scale)
        whiteners.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    prior = np.log((n[1] + 1) / (n[0] + 1))
    return QuadraticModel(scale, tuple(means), tuple(whiteners), float(logs[0] - logs[1] + prior))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, x)`: the statistics of every row."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = statistics(batch.column(1))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["id", "x"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), fn, "id long, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout_mod: int = 5) -> DataFrame:
    """One row per row of `docs`: `(id_col, held_out, score, predicted)`.

    Rows whose crc32(id as text) is 0 modulo `holdout_mod` are never learned from.  Null and empty texts get the score
    of zero statistics; a null id counts as held out; repeated rows are scored each; extra columns are ignored; an
    empty table gives an empty result.
    """
    features = write_table(quality_features(docs, id_col, text_col))
    held = bucket_of(F.col("id"), holdout_mod) == 0
    model = fit_quality(features.filter(~held), labels, id_col, label_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    scored = map_batches(features, fn, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout_mod: int = 5) -> DataFrame:
    """Rows of `docs`, all columns as they were, whose score reaches the threshold.

    Null and empty texts have the score of zero statistics; repeated rows stay or go together; rows with a null id are
    judged but not learned from; without labels all rows stay; further columns, whatever their names, are kept as they
    are; an empty table gives an empty result.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("glyphmill_id")).distinct()
    if ids.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        ids = F.broadcast(ids)
    learned = docs.select(id_col, text_col).filter(bucket_of(F.col(id_col), holdout_mod) != 0)
    learned = learned.join(ids, F.col(id_col).cast("long") == F.col("glyphmill_id"), "left_semi")
    # written, so that no task holds the Python workers of the statistics and of the moments side by side
    features = write_table(quality_features(learned, id_col, text_col))
    model = fit_quality(features, labels, id_col, label_col)
    drop_table(features)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(model.score(statistics(batch.column(at))) >= THRESHOLD))

    return map_batches(docs, fn, docs.schema)
