"""Byte-level BPE by a local rank file, and back to bytes.

The tiktoken library encodes each text by the ranks of a file; long texts are
cut before that into pieces at boundaries that the splitting pattern always
respects, so that no single call grows with the text.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

PIECE = 1 << 16  # characters given to the encoder at a time, about

# A pattern match never holds white space after another character, and in a
# run of white space before another character only the last one can go on.
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\s)(?=\s\S)")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoder of a rank file (base64 token, space, rank a line), without
    special tokens; read once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts of a text at safe boundaries, each the first one after ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path, pattern)
    for batch in batches:
        texts = batch.column("text")
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            ids = [encode(texts[i].as_py() or "", enc) for i in range(lo, lo + some.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array<int>).

    ``docs`` needs doc_id (long) and text (string); other columns are ignored.
    A null text is empty and has no ids; doc_id may be null or repeat, rows
    are independent.  ``path`` names a rank file that every executor has.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, lambda it: _encode(it, path, pattern), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path, pattern)
    for batch in batches:
        ids = batch.column("ids")
        raw = [enc.decode_bytes(ids[i].as_py() or []) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"]
        )


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Raw bytes of (doc_id, ids); null ids are empty. Pieces of characters
    stay as they are, nothing is replaced."""
    return map_arrow(
        encoded.select("doc_id", "ids"), lambda it: _decode(it, path, pattern), "doc_id long, bytes binary"
    )


@lru_cache(maxsize=4)
def _numerals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path, pattern)
    numeral = _numerals(enc.max_token_value + 1).__getitem__
    for batch in batches:
        texts = batch.column("text")
        n, ids_hash, text_hash = [], [], []
        for i in range(batch.num_rows):
            ids = encode(texts[i].as_py() or "", enc)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(numeral, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoding and decoding in one pass, as digests: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by a space) and decoded_sha256 (bytes
    decoded from those ids). Rows as in ``bpe_encode``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(
        rows,
        lambda it: _digest(it, path, pattern),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
