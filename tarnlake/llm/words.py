"""Word and shingle hashes over text bytes, vectorised with numpy.  Runs inside tasks, a text at a time.

A word's hash is a polynomial in its bytes, taken as a difference of running sums, so that no word becomes
a Python object.  Texts of any length are walked in blocks that end between words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


def word_table(separators: bytes | None = None) -> np.ndarray:
    """Which byte values belong to words: all but the separators, or letters, digits and non-ASCII bytes."""
    t = np.ones(256, bool)
    if separators is not None:
        t[list(separators)] = False
    else:
        t[:128] = [chr(i).isalnum() for i in range(128)]
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words_in(data: np.ndarray, in_word: np.ndarray, lower: np.ndarray, stem: int = 0):
    """(starts, ends, hashes) of the words of one text, given as bytes.

    With ``stem``, a fourth array has the hashes of the words' first ``stem`` bytes, in values of their own.
    """
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and in_word[data[end]] and in_word[data[end - 1]]:
            end += 1
        block = data[at:end]
        edge = np.diff(in_word[block].astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p, inv = _powers(len(block) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower[block].astype(np.uint64) + np.uint64(1)) * p[: len(block)])])
        h = mix((sums[e] - sums[s]) * inv[s] ^ mix((e - s).astype(np.uint64)))
        part = (s + at, e + at, h)
        if stem:
            cut = np.minimum(e, s + stem)
            part += (mix((sums[cut] - sums[s]) * inv[s] + np.uint64(0x2545F4914F6CDD1D)),)
        parts.append(part)
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return (none, none, *[np.zeros(0, np.uint64)] * (2 if stem else 1))
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, the whole sequence is the one run."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    total = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - w + 1 + i])
    return np.unique(total)


def text_bytes(value) -> np.ndarray:
    """Bytes of an Arrow string scalar (null: empty)."""
    buf = value.as_buffer()
    return np.zeros(0, np.uint8) if buf is None or buf.size == 0 else np.frombuffer(buf, np.uint8)
