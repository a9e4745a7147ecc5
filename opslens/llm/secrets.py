"""Secrets in texts: fixed patterns, and assignments read by a small lexer.

Beside three patterns (sensitive name and value, access key, long hex run), an
assignment-aware lexer reads source and configuration syntax: around every
``=``, ``:``, ``:=`` or ``=>`` it takes the target name on the left and the value
on the right, a sum of quoted strings, names and bare words.  Names bound to
literals are constants: a later use of the name stands for its literals, so a
key that reaches ``password`` through another name is found where it is
written.  A literal is reported if the sensitivity of its target's name times
its own strength as a key reaches MIN_SCORE.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MIN_SCORE = 0.5
KINDS = ("assign", "access", "hex", "literal")  # order of ties

# The patterns of the three base kinds and their least lengths.
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MAYBE = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Sensitivity of the parts of a name, between 0 and 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "cert": 0.6, "key": 0.5,
    "salt": 0.5, "dsn": 0.6,
}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"),
                   ("encryption", "key"), ("auth", "key")}
PLACEHOLDERS = {"changeme", "example", "placeholder", "redacted", "none", "null", "true", "false", "undefined",
                "todo", "yourpassword", "password", "secret", "token"}

_SIGN = re.compile(r":=|=>|=(?![=~>])|:(?![:/=])")
_LEFT = re.compile(r"([\"']?)([A-Za-z_][A-Za-z0-9_.\-]*)\1[\]]?[ \t]*$")
_LEFT_REACH = 160  # characters before the sign that can hold the target name
MAX_PARTS = 256  # literals that a name passes on
_SPACE = re.compile(r"[ \t]*")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?|([A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9+/_.=\-])")
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-~!@%^&*]+")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int]


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words (snake, kebab, dotted or camel case)."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(pair in SENSITIVE_PAIRS for pair in zip(parts, parts[1:])):
        best = 1.0
    return best


def literal_score(value: str) -> float:
    """How much a literal looks like a key: length, spread of characters, mixture."""
    if len(value) < 8 or value.lower() in PLACEHOLDERS or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = (any(c.islower() for c in value) + any(c.isupper() for c in value)
               + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value))
    score = min(1.0, len(value) / 16) * 0.4 + min(1.0, entropy / 3.5) * 0.4 + min(1.0, (classes - 1) / 2) * 0.2
    return score if classes > 1 else score * 0.5


def _value(text: str, at: int, constants: dict[str, list[Span]], bare: list[int]) -> list[Span]:
    """Spans of the literals that make up the value at a position. ``bare``
    holds the last run of bare characters, so that signs inside one do not read
    it again."""
    spans: list[Span] = []
    at = _SPACE.match(text, at).end()
    while True:
        if m := _STRING.match(text, at):
            spans.append(m.span(m.lastindex))
        elif (m := _REFERENCE.match(text, at)) and (m[1] or m[2]) in constants:
            spans += constants[m[1] or m[2]]
        elif bare[0] <= at < bare[1] or (m := _BARE.match(text, at)):
            if not bare[0] <= at < bare[1]:
                bare[:] = m.span()
            spans.append((at, bare[1]))
            m = None
        else:
            return spans
        if not (j := _JOIN.match(text, m.end() if m else bare[1])):
            return spans
        at = j.end()


def assignments(text: str) -> Iterator[tuple[str, list[Span]]]:
    """(target name, spans of its literals) in order, constants propagated:
    each literal of a name once, MAX_PARTS at most."""
    constants: dict[str, list[Span]] = {}
    bare = [0, 0]
    for sign in _SIGN.finditer(text):
        left = _LEFT.search(text[max(0, sign.start() - _LEFT_REACH) : sign.start()])
        if left is None:
            continue
        spans = _value(text, sign.end(), constants, bare)
        if spans:
            # a name stands for each of its literals once, however it was put together
            constants[left[2]] = list(dict.fromkeys(spans))[:MAX_PARTS]
            yield left[2], spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base kinds."""
    found = []
    low = text.lower()
    if any(word in low for word in _MAYBE):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def literal_spans(text: str, least: float = MIN_SCORE) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of literals that reach the least score."""
    found = set()
    for name, spans in assignments(text):
        weight = name_score(name)
        if weight >= least and weight * literal_score("".join(text[a:b] for a, b in spans)) >= least:
            found |= {(a, 3, b) for a, b in spans if b > a}
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_RESULT = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
)


def _scan(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        counts: list[list[int]] = [[], [], [], []]
        digests, listed = [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            base = base_spans(text)
            more = literal_spans(text, least)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base) if k < 3 else len(more))
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            listed.append(_listed(sorted(base + more)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()),
             pa.array(listed, pa.string()), pa.array(counts[3], pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
        )


def secret_scan(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Secrets of every whole text.

    ``docs`` needs doc_id (long) and text (string); other columns are ignored.
    Returns one row per input row: doc_id, n_assign, n_access, n_hex,
    base_sha256 (of the base spans), spans (all spans as kind:start:end in
    code points, end exclusive, by start and kind) and n_literal (those the
    lexer adds).  A null text is empty and has none; doc_id may be null or
    repeat, rows are independent.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, lambda it: _scan(it, least), _RESULT)
