"""Word passages that occur more than once, removed wherever they stand.

Every window of WINDOW consecutive words has a Rabin-Karp hash.  Most windows
are unique, so before they are counted they are sieved by an anchor: the
smallest hash among the GRAM-word grams inside the window.  Equal windows have
equal anchors, and one anchor serves many neighbouring windows, so

1. anchors (about one per twelve words) are counted in Spark; those that occur
   more than once fill a bit filter of fixed size;
2. windows whose anchor passes go, packed by anchor, to the anchor's
   partition, where equal windows are counted and give intervals of starts;
3. intervals merge per document into maximal removal intervals.

Repeats inside a batch are combined before any shuffle: a batch sends each of
its distinct windows once, so a passage that a third of all documents share
costs one row per batch.  Two windows count as equal when both their anchor
hash and their window hash (64 bits each) are equal.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, longs, map_arrow, written
from .hashing import hash_words, ngrams, rolling, sliding

WINDOW = 35  # words in a window
GRAM = 12  # words in an anchor
FILTER_BITS = 25  # log2 bits of the filter for repeated anchors


def _anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, gram hashes, and the anchor of every window."""
    h = hash_words(words)
    grams = ngrams(h, gram)
    return h, grams, sliding(grams, window - gram + 1, np.minimum)


def _chosen(grams: np.ndarray, anchors: np.ndarray, span: int) -> np.ndarray:
    """Grams that are the anchor of some window (ties included)."""
    edge = np.zeros(span - 1, np.uint64)
    return grams[sliding(np.concatenate([edge, anchors, edge]), span, np.maximum) == grams]


def _count_anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            words = text.split() if text else ()
            if len(words) >= window:
                _, grams, anchors = _anchors(words, window, gram)
                found.append(_chosen(grams, anchors, window - gram + 1))
        if found:
            anchor, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"]
            )


# anchor, document (id and text hash), first start, and the hashes of the
# windows from there; without hashes: starts lo..hi are known to repeat
_PACKED = "anchor long, doc_id long, mark long, lo long, hi long, hashes binary"


def _packed(anchor, doc, mark, lo, hi, hashes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()),
         pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(hashes, pa.binary())],
        names=["anchor", "doc_id", "mark", "lo", "hi", "hashes"],
    )


def _intervals(at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive positions ``at``, cut also where ``breaks`` changes."""
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(breaks) != 0))
    return np.r_[at[0], at[cut + 1]], np.r_[at[cut], at[-1]]


def _pack_windows(batches: Iterator[pa.RecordBatch], bits: np.ndarray, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
        texts = batch.column("text")
        doc, start, anchor, hashes = [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            words = text.split() if text else ()
            if len(words) < window:
                continue
            h, _, anchors = _anchors(words, window, gram)
            at = np.flatnonzero(in_filter(bits, anchors))
            if len(at):
                doc.append(np.full(len(at), i))
                start.append(at)
                anchor.append(anchors[at])
                hashes.append(rolling(h, window)[at])
        if not doc:
            continue
        doc, start = np.concatenate(doc), np.concatenate(start)
        anchor, hashes = np.concatenate(anchor).view(np.int64), np.concatenate(hashes)
        # combine inside the batch: the first of equal windows speaks for all
        order = np.lexsort((hashes, anchor))
        a, h = anchor[order], hashes[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(np.diff(np.r_[np.flatnonzero(new), len(order)]) > 1, np.diff(np.r_[np.flatnonzero(new), len(order)]))
        place = doc * (1 << 40) + start
        row_id, row_mark = np.array([x if x is not None else 0 for x in ids], np.int64), np.array(marks, np.int64)
        null = np.array([x is None for x in ids])

        def id_column(rows):
            return pa.array(row_id[rows], pa.int64(), mask=null[rows])

        at = np.flatnonzero(again)
        if len(at):
            lo, hi = _intervals(place[at], doc[at])
            rows = lo >> 40
            yield _packed(row_mark[rows], id_column(rows), row_mark[rows], lo & ((1 << 40) - 1),
                          hi & ((1 << 40) - 1), pa.nulls(len(lo), pa.binary()))
        at = np.flatnonzero(first)
        lo, hi = _intervals(place[at], anchor[at])
        rows, length = lo >> 40, hi - lo + 1
        ends = np.cumsum(length)
        sent, data = anchor[at], hashes[at].tobytes()
        packed = pa.Array.from_buffers(
            pa.binary(), len(lo), [None, pa.py_buffer(np.r_[0, ends * 8].astype(np.int32).tobytes()), pa.py_buffer(data)]
        )
        yield _packed(sent[ends - length], id_column(rows), row_mark[rows], lo & ((1 << 40) - 1),
                      hi & ((1 << 40) - 1), packed)


_SPANS = "doc_id long, mark long, lo long, hi long"


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of the windows that occur more than once. Sorted by anchor."""
    held: pa.Table | None = None
    for batch in batches:
        known = batch.column("hashes").is_null()
        if (done := batch.filter(known)).num_rows:
            yield done.select(["doc_id", "mark", "lo", "hi"])
        rest = batch.filter(pa.compute.invert(known))
        if not rest.num_rows:
            continue
        held = pa.Table.from_batches([*(held.to_batches() if held is not None else ()), rest])
        anchors = longs(held.column("anchor"))
        cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
        if cut:
            yield from _repeated(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None:
        yield from _repeated(held)


def _repeated(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), np.uint64)
    lo, hi = longs(rows.column("lo")), longs(rows.column("hi"))
    length = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), length)
    anchor = longs(rows.column("anchor"))[row]
    start = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + lo[row]
    order = np.lexsort((h, anchor))
    a, b = anchor[order], h[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    at = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    if len(at):
        begin, end = _intervals(start[at] + row[at] * (1 << 40), row[at])
        rows = rows.take(pa.array(begin >> 40))
        mask = (1 << 40) - 1
        yield from pa.table(
            {"doc_id": rows.column("doc_id"), "mark": rows.column("mark"), "lo": begin & mask, "hi": end & mask}
        ).to_batches()


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Intervals (doc_id, mark, lo, hi) of starts of windows that occur more
    than once; ``mark`` is the hash of the text. ``docs``: doc_id, mark, text
    (binary)."""
    spark = docs.sparkSession
    anchors = map_arrow(docs.select("text"), lambda it: _count_anchors(it, window, gram), "anchor long, n long")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bit_filter(repeated, "anchor", FILTER_BITS))
    packed = map_arrow(docs, lambda it: _pack_windows(it, bits.value, window, gram), _PACKED)
    return map_arrow(packed.repartition("anchor").sortWithinPartitions("anchor"), _count_windows, _SPANS)


_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<lo: long, hi: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        n_words, n_removed, removed, kept = [], [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or b"").split()
            cover = []
            for s in sorted((s["lo"], s["hi"] + window) for s in spans[i].as_py() or ()):
                if cover and s[0] <= cover[-1][1]:
                    cover[-1] = (cover[-1][0], max(cover[-1][1], s[1]))
                else:
                    cover.append(s)
            n_words.append(len(words))
            n_removed.append(sum(hi - lo for lo, hi in cover))
            removed.append([{"lo": lo, "hi": hi} for lo, hi in cover])
            for lo, hi in reversed(cover):
                del words[lo:hi]
            text = b" ".join(words)
            kept.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "removed", "kept"],
        )


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Remove every word that a repeated window covers.

    ``docs`` needs doc_id (long) and text (string); other columns are ignored.
    Words are runs of other characters than ASCII white space, unchanged.
    Windows are judged on the input: all occurrences of a repeated passage go,
    the first one too.  Returns one row per input row: doc_id, n_words,
    n_removed, removed (maximal word intervals, end exclusive) and kept (the
    words left, joined by one space; with ``digest`` the hex SHA-256 of that).
    A null text has no words; a text shorter than a window loses none.  Rows
    that repeat (doc_id, text) are occurrences of their own, so all their
    windows repeat; a null doc_id is kept as it is.  An empty table gives an
    empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("mark"),
        F.col("text").cast("binary").alias("text"),
    )
    spans = (
        written(repeated_windows(rows, window, gram), "windows")
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    )
    joined = rows.alias("r").join(
        spans.alias("s"), F.expr("r.mark = s.mark and r.doc_id <=> s.doc_id"), "left"
    ).select("r.doc_id", "r.text", "s.spans")
    out = map_arrow(joined, lambda it: _cut(it, window, digest), _RESULT)
    return out.withColumn("kept", F.col("kept").cast("string"))
