"""64-bit hashes of words, n-grams and windows of one text, in numpy."""
from __future__ import annotations

import numpy as np
import xxhash

# Words hashed so far in this Python worker; emptied between texts when full,
# so its memory is bounded by MAX_WORDS plus the words of one text.
MAX_WORDS = 300_000

_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > MAX_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """Empty the store at the end of a task: workers live on, beside the JVM's heap."""
    _HASHES.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(i: int) -> np.uint64:
    """The i-th of a family of odd 64-bit multipliers."""
    return _U(xxhash.xxh3_64_intdigest(b"multiplier %d" % i) | 1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (none if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += h[i : i + m] * _odd(i)
    return mix(total)


def sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, apart from every n-gram hash."""
    total = _U(len(h))
    with np.errstate(over="ignore"):
        for i, x in enumerate(h):
            total = total * _odd(1000) + x * _odd(i + 1)
    return mix(np.array([total], np.uint64))[0]


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every window of n consecutive words: differences of
    prefix sums of ``h[i] * B**i``, shifted back by ``B**-start``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_BASE, len(h)), out=prefix[1:])
    return mix((prefix[n:] - prefix[:m]) * _powers(_INVERSE, m))


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every n consecutive values."""
    out, width = x, 1
    while width * 2 <= n:
        out = pick(out[: len(out) - width], out[width:])
        width *= 2
    if width < n:
        step = n - width
        out = pick(out[: len(out) - step], out[step:])
    return out
