"""Token ids of a corpus as entropy-coded binary files.

Documents, in ascending doc_id order, become ids of a tokenizer file plus one
end id each.  Runs of documents form segments of about SEGMENT ids; a segment
is coded with one static table of frequencies counted over all its ids.  Its
ids are cut into blocks, each a range asymmetric numeral system (rANS) of LANES
interleaved states.  A block starts from stored states (its checkpoint) and has
checksums of its states and words and of its ids, so all blocks decode independently.

Segment layout (little-endian)::

    "RANS" | u16 version | u16 scale bits | u32 documents | u32 symbols | u32 blocks
    documents: i64 doc_id | u8 doc_id is null | u64 ids with the end id
    symbols:   u32 id | u32 frequency
    blocks:    u64 offset from the start of the segment
    each block: u32 ids | u32 lanes | u32 words | u32 crc32 of ids | u32 crc32 of states and words
                u64 states (one a lane) | u32 words

Segments are rows of Parquet files that Spark writes, so that any store that
Spark reaches can hold them; part and number give their order.
"""
from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow

SEGMENT = 1 << 21  # ids in a segment, about
BLOCK = 1 << 19  # ids in a block
LANES = 2048
SCALE = 18  # log2 of the sum of frequencies, at least
CACHED = 700_000  # pieces and pre-tokens whose ids a worker keeps, about twice as many
TOGETHER = 5000  # texts whose distinct pieces are looked up together
MAGIC, VERSION = b"RANS", 2

_U = np.uint64
_LOW = _U(1 << 31)  # states stay in [2**31, 2**63)
_HEADER = struct.Struct("<4sHHIII")
_BLOCK = struct.Struct("<IIIII")


# --- rANS ---------------------------------------------------------------------

def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive frequencies in proportion to positive counts, summing to 2**scale."""
    total = int(counts.sum())
    freq = np.maximum(1, (counts.astype(np.float64) * (1 << scale) / total).astype(np.int64))
    rest = (1 << scale) - int(freq.sum())
    while rest:
        k = int(freq.argmax())
        step = rest if rest > 0 else -min(-rest, max(1, int(freq[k]) // 2))
        freq[k] += step
        rest -= step
    return freq.astype(np.uint64)


def encode_block(at: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """States and words of a block of symbol numbers; lane k holds every LANES-th from k."""
    state = np.full(LANES, _LOW, np.uint64)
    words = []
    shift, bits = _U(63 - scale), _U(scale)
    for lo in range((len(at) - 1) // LANES * LANES, -1, -LANES):
        s = at[lo : lo + LANES]
        f, c = freq[s], start[s]
        x = state[: len(s)]
        full = x >= f << shift
        words.append(x[full].astype(np.uint32))  # the low 32 bits
        x = np.where(full, x >> _U(32), x)
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + c
    words.reverse()
    return state, np.concatenate(words) if words else np.empty(0, np.uint32)


def decode_block(n: int, state: np.ndarray, words: np.ndarray, slots: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int) -> np.ndarray:
    """Symbol numbers of a block; the inverse of ``encode_block``."""
    out = np.empty(n, np.int64)
    state, at = state.copy(), 0
    mask, bits = _U((1 << scale) - 1), _U(scale)
    for lo in range(0, n, len(state)):
        x = state[: min(len(state), n - lo)]
        slot = x & mask
        s = slots[slot]
        out[lo : lo + len(x)] = s
        x = freq[s] * (x >> bits) + slot - start[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _U(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return out


def encode_segment(doc_ids: list[int | None], texts: list[bytes]) -> bytes:
    """A segment of documents, each given as its ids in 32-bit little-endian."""
    data = b"".join(texts)
    ids = np.frombuffer(data, "<u4")
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    at, counts = (np.cumsum(counts > 0) - 1)[ids], counts[symbols]
    scale = max(SCALE, int(len(symbols) - 1).bit_length() + 2)
    freq = frequencies(counts, scale)
    start = np.cumsum(freq) - freq
    head = [
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], "u1").tobytes(),
        np.array([len(t) // 4 for t in texts], "<u8").tobytes(),
        symbols.astype("<u4").tobytes(),
        freq.astype("<u4").tobytes(),
    ]
    blocks = []
    for lo in range(0, len(ids), BLOCK):
        some = at[lo : lo + BLOCK]
        state, words = encode_block(some, freq, start, scale)
        state, words = state.astype("<u8").tobytes(), words.astype("<u4").tobytes()
        blocks.append(
            _BLOCK.pack(len(some), LANES, len(words) // 4, zlib.crc32(data[lo * 4 : (lo + len(some)) * 4]), zlib.crc32(state + words))
            + state + words
        )
    offset = _HEADER.size + sum(map(len, head)) + 8 * len(blocks)
    offsets = offset + np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join(
        [_HEADER.pack(MAGIC, VERSION, scale, len(doc_ids), len(symbols), len(blocks)), *head,
         offsets.astype("<u8").tobytes(), *blocks]
    )


class Segment:
    """A segment read back; ``block(k)`` decodes one block on its own."""

    def __init__(self, data: bytes):
        magic, version, self.scale, docs, symbols, blocks = _HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        self.data, at = data, _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.symbols = take("<u4", symbols)
        self.freq = take("<u4", symbols).astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.offsets = take("<u8", blocks)
        self.slots = np.repeat(np.arange(symbols), self.freq.astype(np.int64))

    def block(self, k: int) -> np.ndarray:
        at = int(self.offsets[k])
        n, lanes, n_words, ids_crc, words_crc = _BLOCK.unpack_from(self.data, at)
        at += _BLOCK.size
        state = np.frombuffer(self.data, "<u8", lanes, at)
        words = np.frombuffer(self.data, "<u4", n_words, at + state.nbytes)
        if zlib.crc32(words, zlib.crc32(state)) != words_crc:
            raise ValueError(f"block {k}: its states or words are damaged")
        ids = self.symbols[decode_block(n, state, words, self.slots, self.freq, self.start, self.scale)]
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError(f"block {k}: its ids are not those that were written")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids (end id included) of every document, in order."""
        ids = np.concatenate([self.block(k) for k in range(len(self.offsets))])
        end = np.cumsum(self.lengths)
        for doc_id, lo, hi in zip(self.doc_ids, end - self.lengths, end):
            yield doc_id, ids[lo:hi]


# --- tokenizer ----------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable
    Latin-1 stays, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Results of a function, kept while they are used: when CACHED are new,
    those not used since the last time are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def age(self) -> None:
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()


class ByteTokenizer:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Byte-level BPE never merges across the pattern's pre-tokens, and these never
    reach across a space that follows another character than white space.  So
    texts are cut at such spaces, and the library's model is asked once for
    each distinct pre-token while it is remembered.  Of many texts together,
    each distinct piece is looked up once.

    With ``added_tokens`` the ids are those of the library's own encoding: an
    added token of the file that stands in a text is one id, and the text
    between two of them is encoded on its own.  Without, special tokens are
    spelled out like any other text.
    """

    _CUT = regex.compile(r"(?<=\S) ")
    _UNSAFE = regex.compile(r"\s ")

    def __init__(self, path: str, pattern: str, added_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        # tokens that take in white space or need a word's edge are the library's to find
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.letters = _byte_letters()
        model, split = self.tokenizer.model, regex.compile(pattern)

        def of_token(token: str) -> bytes:
            word = token.translate(self.letters) if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in model.tokenize(word)]).tobytes()

        def of_piece(piece: str, lead: str = " ") -> bytes:
            core = piece.rstrip(",.;:!?")
            if core.isalpha() and max(core) < "ɐ":
                if lead and len(core) == len(piece):
                    return of_token(lead + core)
                out = self.pieces[core] if lead else self.tokens[core]
                return out + self.tokens[piece[len(core) :]] if len(core) < len(piece) else out
            if not piece or max(piece) < "ɐ":
                return b"".join(map(self.tokens.__getitem__, split.findall(lead + piece)))
            # letters and marks of other scripts are the library's to tell apart
            return array("I", self.tokenizer.encode(lead + piece, add_special_tokens=False).ids).tobytes()

        self.tokens, self.pieces = _Remembered(of_token), _Remembered(of_piece)
        self.first = lambda piece: of_piece(piece, "")

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit little-endian bytes."""
        self.tokens.age()
        self.pieces.age()
        if self.special is None or not self.special.search(text):
            return self._between(text)
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[t] if t in self.added else self._between(t) for t in self.special.split(text))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every text in turn (none for null) as 32-bit little-endian bytes."""
        for lo in range(0, len(texts), TOGETHER):
            some = texts.slice(lo, TOGETHER)
            out, plain = [b""] * len(some), []
            for i, text in enumerate(some.to_pylist()):
                if text and ((self.special is not None and self.special.search(text)) or self._UNSAFE.search(text)):
                    out[i] = self.encode(text)
                elif text:
                    plain.append(i)
            for i, ids in zip(plain, self._together(some.take(pa.array(plain, pa.int64())))):
                out[i] = ids
            yield from out

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts without added tokens that may be cut at every space."""
        self.tokens.age()
        self.pieces.age()
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy()
        pieces, first = cut.values, at[:-1]
        heads = pieces.take(pa.array(first)).to_pylist()
        later = np.ones(len(pieces), bool)
        later[first] = False
        later = pieces.filter(pa.array(later)).dictionary_encode()
        known = [self.pieces[x] for x in later.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(size)], np.frombuffer(b"".join(known), "<u4"))
        ids = lists.take(later.indices).flatten().to_numpy()
        end = np.r_[0, np.cumsum(size[later.indices.to_numpy()])][at - np.arange(len(at))]
        for head, lo, hi in zip(heads, end, end[1:]):
            yield (self.first(head) if head else b"") + ids[lo:hi].tobytes()

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        cut = self._CUT.split(text) if self._UNSAFE.search(text) else text.split(" ")
        head = self.first(cut[0]) if cut[0] else b""
        return head + b"".join(map(self.pieces.__getitem__, cut[1:]))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, added_tokens: bool = False) -> ByteTokenizer:
    return ByteTokenizer(path, pattern, added_tokens)


# --- on Spark -----------------------------------------------------------------

_SEGMENTS = "part int, number int, n_docs long, n_tokens long, payload binary"


def _segments(
    batches: Iterator[pa.RecordBatch], path: str, pattern: str, end_id: int, added_tokens: bool
) -> Iterator[pa.RecordBatch]:
    coder, end = tokenizer(path, pattern, added_tokens), struct.pack("<I", end_id)
    part, number, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

    def flush() -> pa.RecordBatch:
        values = [part, number, len(docs), size // 4, encode_segment(docs, held)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types)], names=["part", "number", "n_docs", "n_tokens", "payload"]
        )

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for doc_id, found in zip(ids, coder.encode_all(batch.column("text"))):
            docs.append(doc_id)
            held.append(found + end)
            size += len(held[-1])
            if size >= 4 * SEGMENT:
                yield flush()
                number, docs, held, size = number + 1, [], [], 0
    if docs:
        yield flush()


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, added_tokens: bool = False
) -> None:
    """Encode every whole text and write the segments to ``path``.

    ``docs`` needs doc_id (long) and text (string); other columns are ignored.
    A null text is empty and has the end id alone.  Rows come in ascending
    order of doc_id (null first), then text; rows that repeat stay.  An empty
    table writes no segments.  With ``added_tokens`` the ids are the library's
    own, in which added tokens of the file count; without, special tokens are
    plain text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, lambda it: _segments(it, tokenizer_path, pattern, end_id, added_tokens), _SEGMENTS).write.parquet(path)


_READ = "part int, number int, place long, doc_id long, skipped long, n_tokens long, ids_crc32 long, ids array<int>"


def _decoded(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, skipped = [], 0
            for place, (doc_id, ids) in enumerate(Segment(batch.column("payload")[i].as_py()).documents()):
                rows.append((doc_id, place, skipped, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                skipped += len(ids)
            doc_id, place, skip, n, crc, ids = zip(*rows)
            size = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("part")[i].as_py()] * size, pa.int32()),
                 pa.array([batch.column("number")[i].as_py()] * size, pa.int32()), pa.array(place, pa.int64()),
                 pa.array(doc_id, pa.int64()), pa.array(skip, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                names=["part", "number", "place", "doc_id", "skipped", "n_tokens", "ids_crc32", "ids"],
            )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the segments at ``path``: one row per document with doc_id, start
    (ids of all documents before it), n_tokens (end id included), ids_crc32
    (of all its ids in 32-bit little-endian) and, if asked for, ids.  Damaged
    blocks raise an error."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # one small row for about SEGMENT ids: their order is that of the files
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select(
        "part", "number", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base")
    )
    read = map_arrow(segments.select("part", "number", "payload"), lambda it: _decoded(it, with_ids), _READ)
    return read.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("skipped")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )
