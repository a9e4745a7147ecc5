"""Benchmark passages inside documents, found by one Aho-Corasick automaton.

Test items are normalised to words (A-Z lowered; ASCII digits and letters and
everything beyond ASCII are word characters) and cut into windows of WINDOW
words.  All windows form one automaton, which scans each normalised document
once; hits are mapped back to words and to code-point offsets of the original.

The automaton is broadcast, so its size is checked first: test sets with more
than SHARD_CHARS characters of windows are dealt into several automata, which
scan the documents one after the other; the hits so far are written between
two scans, so that a task holds one automaton at a time.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

WINDOW = 10  # words in a window
SHARD_CHARS = 4_000_000  # window characters in one automaton (about 45 bytes of memory each)

# Byte classes of the word pattern; other bytes become spaces.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, items = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.append(b" ".join(words[i : i + window]))
                items.append(item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.binary()), pa.array(items, pa.int64())], names=["window", "item_id"]
        )


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, windows: list[tuple[bytes, list[int]]]) -> ahocorasick.Automaton:
    """Built once per Python worker; bytes stand as Latin-1 characters."""
    if key not in _BUILT:
        _BUILT.clear()  # one at a time: they are large
        auto = ahocorasick.Automaton()
        for i, (window, _) in enumerate(windows):
            auto.add_word(f" {window.decode('latin-1')} ", (i, window.count(b" ") + 1))
        if windows:
            auto.make_automaton()
        _BUILT[key] = auto
    return _BUILT[key]


_HITS = "doc_id long, text binary, hits array<struct<lo: long, hi: long>>, items array<long>"
_RESULT = (
    "doc_id long, n_words long, n_hit long, items array<long>, "
    "spans array<struct<start: long, end: long>>"
)
_HIT_TYPE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], shard, key: str, last: bool) -> Iterator[pa.RecordBatch]:
    windows = shard.value
    auto = _automaton(key, windows)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        hits, items, counts = [], [], []
        for i in range(batch.num_rows):
            words = words_of(texts[i].as_py())
            found = [(h["lo"], h["hi"]) for h in batch.column("hits")[i].as_py() or ()]
            named = set(batch.column("items")[i].as_py() or ())
            if words and windows:
                line = b" ".join([b"", *words, b""])
                matches = list(auto.iter(line.decode("latin-1")))
                if matches:
                    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                    ends = np.searchsorted(spaces, [end for end, _ in matches])
                    for end, (_, (k, size)) in zip(ends.tolist(), matches):
                        found.append((end - size, end))
                        named.update(windows[k][1])
            counts.append(len(words))
            hits.append(_merged(found))
            items.append(sorted(named))
        if not last:
            yield pa.RecordBatch.from_arrays(
                [ids, texts, pa.array([[{"lo": a, "hi": b} for a, b in h] for h in hits], _HIT_TYPE),
                 pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "text", "hits", "items"],
            )
            continue
        spans = [original_offsets(texts[i].as_py(), h) if h else [] for i, h in enumerate(hits)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array([sum(b - a for a, b in h) for h in hits], pa.int64()),
             pa.array(items, pa.list_(pa.int64())),
             pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN_TYPE)],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(spans)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point intervals of the original text for intervals of words."""
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # code points before each byte: bytes that do not continue a character
    before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[starts[lo]]), int(before[ends[hi - 1]])) for lo, hi in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Words of every document that lie in a window of a test item.

    ``docs`` needs doc_id (long) and text, ``benchmark`` item_id (long) and
    text (strings); other columns are ignored.  An item with fewer words than
    a window, but not none, is one window.  Returns one row per document row:
    doc_id, n_words, n_hit (words inside some occurrence), items (sorted ids
    of the items with an occurring window) and spans (code-point intervals of
    the hit passages, end exclusive).  A null or empty text has no words and
    no hits, test items without id or words match nothing, and items that
    repeat an id or a text count together.  Empty tables give no hits.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("item_id is not null")
    windows = written(
        map_arrow(items, lambda it: _windows(it, window), "window binary, item_id long")
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items")),
        "test-windows",
    )
    chars = windows.agg(F.coalesce(F.sum(F.length("window") + 8 * F.size("items")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.expr("cast(array() as array<struct<lo: long, hi: long>>)").alias("hits"),
        F.expr("cast(array() as array<long>)").alias("items"),
    )
    for k in range(shards):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k)
        # at most about shard_chars characters, by the check above
        rows = [(bytes(r["window"]), sorted(r["items"])) for r in part.collect()]
        shard = docs.sparkSession.sparkContext.broadcast(rows)
        key, last = uuid.uuid4().hex, k == shards - 1
        out = map_arrow(out, lambda it, s=shard, n=key, z=last: _scan(it, s, n, z), _RESULT if last else _HITS)
        if not last:
            out = written(out, "hits")
    return out
