"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the bag of the byte n-grams (NGRAMS long, A-Z lowered, other ASCII
than letters as spaces) of its whole length, each hashed to one of 2**LOG2
rows of an embedding table.  The average embedding goes through a linear
softmax.  Table and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows.  A temperature, fitted on a part
of the sample kept from training, calibrates the probabilities; a text whose
calibrated probability is below a threshold found there is rejected.

The average and the softmax are linear, so for prediction the table is folded
with the softmax weights into one score per n-gram row and language.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release_memory, relieve_driver

NGRAMS = (2, 3, 4)  # bytes in a subword
LOG2 = 14  # log2 rows of the embedding table
DIMENSIONS = 16
PER_LANGUAGE = 800  # labelled rows sampled of each language, about
SAMPLE_ROWS = 20_000  # labelled rows sampled at all, at most
MAX_LANGUAGES = 1000  # languages learned at most, the most frequent ones
STEPS = 1500  # batches of gradient descent, whatever the sample
REJECTED_SHARE = 0.001  # of rightly predicted calibration rows below the threshold
CHUNK = 1 << 20  # bytes scored at a time
UNDETERMINED = "und"

# Letters and bytes beyond ASCII stay, the rest is a space.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (rows + 1, languages): score of each n-gram row; the bias last
    temperature: float
    threshold: float


def subwords(text: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Table rows of the n-grams of a text that start in [lo, hi)."""
    hi = len(text) if hi is None else hi
    x = np.frombuffer(text[lo : hi + max(NGRAMS) - 1].translate(_LETTERS), np.uint8).astype(np.uint32)
    out = []
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if n > len(x):
            break
        code = code[: len(x) - n + 1] | (x[n - 1 :] << np.uint32(8 * (n - 1)))
        if n in NGRAMS:
            seed = np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out.append((code[: hi - lo] * np.uint32(0x9E3779B1) + seed) >> np.uint32(32 - LOG2))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


# --- training -----------------------------------------------------------------

def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, counts = [], []
        for text in batch.column("text").to_pylist():
            r, n = np.unique(subwords((text or "").encode()), return_counts=True)
            rows.append(r.astype(np.int32))
            counts.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("order"), pa.array(rows, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.int32()))],
            names=["lang", "order", "rows", "counts"],
        )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_language_model(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS
) -> LanguageModel:
    """Train on ``labelled`` (doc_id, text, lang; null texts and langs are left
    out).  The sample holds about ``per_language`` rows of each language,
    drawn by a hash of doc_id and text, of at most MAX_LANGUAGES languages and
    ``sample_rows`` rows; its n-gram counts reach the driver.  Without labelled rows nothing is learned
    and every text is undetermined."""
    rows = labelled.where("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("order")
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return LanguageModel([], np.zeros((1, 0), np.float32), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["n"])])
    drawn = rows.where((F.pmod("order", F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")])
    sample = map_arrow(drawn, _bags, "lang string, order long, rows array<int>, counts array<int>")
    sample = sample.orderBy("order", "lang").limit(sample_rows).toArrow()
    names = sample.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), 1.0, 0.0)
    y = np.array([languages.index(n) for n in names])
    lists = [sample.column(c).combine_chunks() for c in ("rows", "counts")]
    offsets = np.asarray(lists[0].offsets)
    rows, counts = (x.values.to_numpy() for x in lists)
    counts = counts.astype(np.float32)
    bags = [(rows[lo:hi], counts[lo:hi]) for lo, hi in zip(offsets, offsets[1:])]
    del sample, lists
    relieve_driver(labelled.sparkSession)
    kept = [i for i, (r, _) in enumerate(bags) if len(r)]
    held = set(kept[::5])  # for calibration
    train = [i for i in kept if i not in held] or kept
    release_memory()
    table, weights, bias = _descend([bags[i] for i in train], y[train], len(languages), steps)
    folded = table @ weights.T

    def logits(some):
        return np.array([bags[i][1] @ folded[bags[i][0]] / bags[i][1].sum() for i in some]).reshape(-1, len(languages)) + bias

    check = sorted(held) or train
    z, right = logits(check), y[check]

    def loss(t):
        return -np.log(_softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean()

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 61)), key=loss)
    del bags, rows, counts
    release_memory()
    p = _softmax(z / temperature)
    sure = np.sort(p.max(axis=1)[p.argmax(axis=1) == right])
    # no clean text should be lost: half of the least confidence that all but
    # a small share of the rightly predicted rows reach
    threshold = float(sure[int(REJECTED_SHARE * len(sure))]) / 2 if len(sure) else 0.0
    return LanguageModel(languages, np.vstack([folded, bias]).astype(np.float32), temperature, threshold)


def _descend(bags, y: np.ndarray, k: int, steps: int, rate: float = 0.5, size: int = 16):
    """Stochastic gradient descent over small batches, the rate falling to zero."""
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << LOG2, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((k, DIMENSIONS), np.float32), np.zeros(k, np.float32)
    step = 0
    while step < steps and bags:
        order = rng.permutation(len(bags))
        for lo in range(0, min(len(order), (steps - step) * size), size):
            some = order[lo : lo + size]
            step += 1
            speed = rate * (1 - step / (steps + 1))
            mean = np.stack([bags[i][1] @ table[bags[i][0]] / bags[i][1].sum() for i in some])
            error = _softmax(mean @ weights.T + bias)
            error[np.arange(len(some)), y[some]] -= 1
            back = error @ weights
            weights -= speed * error.T @ mean
            bias -= speed * error.mean(axis=0)
            for g, i in zip(back, some):
                rows, counts = bags[i]
                # rows of a bag are distinct
                table[rows] -= (speed * 20 / counts.sum()) * counts[:, None] * g
    return table, weights, bias


# --- prediction ---------------------------------------------------------------

_RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def _logits(text: bytes, scores: np.ndarray) -> np.ndarray:
    """Mean score of the n-grams of a text, whole, a chunk at a time."""
    total, n = np.zeros(scores.shape[1]), 0
    for lo in range(0, len(text), CHUNK):
        rows = subwords(text, lo, min(lo + CHUNK, len(text)))
        if len(rows) < len(scores):
            total += scores[rows].sum(axis=0)
        else:
            total += np.bincount(rows, minlength=len(scores) - 1) @ scores[:-1]
        n += len(rows)
    return total / max(n, 1) + scores[-1]


def _judge(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    """Language, calibrated probability, and whether the text is rejected."""
    if text is None or not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0, True
    p = _softmax(_logits(text.encode(), model.scores)[None, :] / model.temperature)[0]
    best = int(p.argmax())
    return model.languages[best], min(1.0, float(p[best])), bool(p[best] < model.threshold)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        rows = [_judge(texts[i].as_py(), shared.value) for i in range(batch.num_rows)]
        names, scores, rejected = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred (``und`` if the text is
    null, has no letter, or nothing was learned), score (calibrated probability,
    0 for ``und``) and rejected (``und``, or below the threshold).  Only the
    text is looked at; other columns are ignored, rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, lambda it: _predict(it, shared), _RESULT)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            mask = [not _judge(texts[i].as_py(), shared.value)[2] for i in range(batch.num_rows)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows kept from learning: crc32 of the id as text leaves 1 modulo 3
    (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
