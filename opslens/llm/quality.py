"""Document quality: random Fourier features, ridge regression, isotonic scores.

Each text becomes a vector of statistics (length, words, characters of each
kind, repetition).  Random Fourier features of the standardised statistics
approximate a Gaussian kernel; ridge regression on them is fitted from normal
equations that every partition sums over all its labelled rows; an isotonic
fit over binned scores turns the regression value into a probability.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

FEATURES = 256  # random Fourier features
RIDGE = 1.0
BINS = 1000  # score bins of the isotonic fit
SEED = 11

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_sd", "upper", "lower", "digit", "space",
    "punctuation", "symbol", "pipe", "beyond_ascii", "control", "upper_words", "symbol_words", "distinct_words",
    "top_word", "repeated_lines", "distinct_lines", "line_length", "sentence_ends", "repeated_pairs",
)

# Kinds of bytes.
_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCT, _SYMBOL, _HIGH, _CONTROL, _CONTINUE = range(9)


def _kind(b: int) -> int:
    c = chr(b)
    if 0x80 <= b < 0xC0:
        return _CONTINUE
    if b >= 0xC0:
        return _HIGH
    if c.isupper():
        return _UPPER
    if c.islower():
        return _LOWER
    if c.isdigit():
        return _DIGIT
    if c in " \t\n\r\x0b\x0c":
        return _SPACE
    if c in ".,;:!?'\"()-":
        return _PUNCT
    return _CONTROL if b < 0x20 or b == 0x7F else _SYMBOL


_KIND = bytes(_kind(b) for b in range(256))


def statistics(text: bytes) -> np.ndarray:
    """The vector of STATISTICS of a text; zeros for an empty one."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    kinds = np.bincount(np.frombuffer(text.translate(_KIND), np.uint8), minlength=9)
    chars = max(1, len(text) - int(kinds[_CONTINUE]))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct_lines = len(set(lines))
    pairs = len(set(zip(words, words[1:])))
    out[:] = (
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(),
        kinds[_UPPER] / chars, kinds[_LOWER] / chars, kinds[_DIGIT] / chars, kinds[_SPACE] / chars,
        kinds[_PUNCT] / chars, kinds[_SYMBOL] / chars, text.count(b"|") / n, kinds[_HIGH] / chars,
        kinds[_CONTROL] / chars, sum(map(bytes.isupper, words)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words) / n, len(counts) / n,
        max(counts.values(), default=0) / n, (len(lines) - distinct_lines) / max(1, len(lines)),
        distinct_lines / max(1, len(lines)), np.log1p(chars / max(1, len(lines))),
        (text.count(b".") + text.count(b"!") + text.count(b"?")) / n, 1 - (pairs + 1) / n if len(words) > 1 else 0.0,
    )
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        rows = [statistics(texts[i].as_py() or b"") for i in range(batch.num_rows)]
        flat = np.concatenate(rows) if rows else np.empty(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS), flat)],
            names=["doc_id", "stats"],
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array<double>, as STATISTICS) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, _statistics, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray  # (statistics, features)
    phase: np.ndarray
    weights: np.ndarray  # (features + 1,), the intercept last
    edges: np.ndarray  # regression values, ascending
    levels: np.ndarray  # probability at each edge, ascending


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))


def _features(x: np.ndarray, model: QualityModel) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    f = np.sqrt(2 / model.omega.shape[1]) * np.cos(z @ model.omega + model.phase)
    return np.hstack([f, np.ones((len(f), 1))])


def _normal_rows(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """This partition's share of the normal equations, one row per matrix row."""
    size = model.omega.shape[1] + 1
    total = np.zeros((size, size + 1))
    seen = False
    for batch in batches:
        if batch.num_rows:
            f = _features(_matrix(batch.column("stats")), model)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total += f.T @ np.column_stack([f, y])
            seen = True
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"]
        )


def _sum_rows(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    sums = np.sum([np.asarray(s) for s in group.column("sums").to_pylist()], axis=0)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})


def _values(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value = _features(_matrix(batch.column("stats")), model) @ model.weights
        score = np.interp(value, model.edges, model.levels) if len(model.edges) else np.full(len(value), 0.5)
        score = np.clip(score, 0.0, 1.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(value), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=[batch.schema.names[0], "value", "score", "predicted"],
        )


def isotonic(value: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rising fit of ones/n over points in order of value (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for count, positive in zip(n.tolist(), ones.tolist()):
        blocks.append([positive, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][2] += c
    return np.concatenate([np.full(int(c), a / b) for a, b, c in blocks]) if blocks else np.empty(0)


def fit_quality_model(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS) -> QualityModel:
    """Fit on all rows of ``labelled`` (stats, y in 0..1; rows with nulls are
    left out).  What reaches the driver are means, the summed normal equations
    and the counts of at most ``bins`` score bins.  Without rows every score is 0.5."""
    rows = labelled.where("y is not null and stats is not null").select("stats", F.col("y").cast("double").alias("y"))
    k = len(STATISTICS)
    row = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)],
    ).first()
    rng = np.random.default_rng(SEED)
    omega = rng.standard_normal((k, features)) / np.sqrt(k)  # kernel width: sqrt(k) standard deviations
    phase = rng.uniform(0, 2 * np.pi, features)
    none = np.empty(0)
    if not row["n"]:
        return QualityModel(np.zeros(k), np.ones(k), omega, phase, np.zeros(features + 1), none, none)
    mean = np.array([row[f"m{i}"] for i in range(k)])
    scale = np.array([row[f"s{i}"] for i in range(k)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), omega, phase, np.zeros(features + 1), none, none)
    parts = map_arrow(rows, lambda it: _normal_rows(it, model), "row long, sums array<double>")
    sums = parts.groupBy("row").applyInArrow(_sum_rows, "row long, sums array<double>").orderBy("row").toArrow()
    system = np.array(sums.column("sums").to_pylist())
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    scored = map_arrow(
        rows.select(F.col("y"), "stats"), lambda it: _values(it, model), "y double, value double, score double, predicted int"
    )
    # regression values of a 0/1 target, in bins over a fixed range
    width = 3.0 / bins
    binned = (
        scored.select(F.floor((F.least(F.greatest("value", F.lit(-1.0)), F.lit(2.0)) + 1) / width).alias("bin"), "value", "y")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.avg("value").alias("value"))
        .orderBy("bin")
        .toPandas()
    )
    model.edges = binned["value"].to_numpy()
    model.levels = isotonic(model.edges, binned["n"].to_numpy(), binned["ones"].to_numpy())
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) for rows of ``document_statistics``."""
    out = map_arrow(
        stats.select("doc_id", "stats"),
        lambda it: _values(it, model),
        "doc_id long, value double, score double, predicted int",
    )
    return out.select("doc_id", "score", "predicted")


def quality_scores(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """Quality of every whole text, learned from labelled rows.

    ``docs`` needs doc_id (long) and text, ``labels`` doc_id and quality (0 or
    1); other columns are ignored.  ``learn`` is a condition on doc_id that
    says which labels may be learned.  Returns one row per document row:
    doc_id, score, predicted.  A null or empty text has all-zero statistics
    and a score like any other.  Label rows that repeat a doc_id all count;
    labels without a document or a value are left out; without any, every
    score is 0.5.  Documents that repeat a doc_id are scored each by its text.
    """
    stats = written(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    return score_quality(stats, fit_quality_model(stats.join(known.where(learn), "doc_id")))
