"""Karp-Rabin hashes of words and of windows of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_MASK = (1 << 64) - 1


def _mixed(n: int) -> int:
    """A well mixed 64-bit number made of a counter."""
    n = (n * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    n = ((n ^ (n >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    n = ((n ^ (n >> 27)) * 0x94D049BB133111EB) & _MASK
    return n ^ (n >> 31)


_BYTE_VALUE = np.array([_mixed(n) for n in range(256)], dtype=np.uint64)
_BYTE_BASE, _WORD_BASE, OTHER_BASE = _mixed(1000) | 1, _mixed(1001) | 1, _mixed(1002) | 1

SPACES = bytes([0x20, *range(0x09, 0x0E)])
IN_WORD = np.array([b not in SPACES for b in range(256)])
IN_PLAIN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])  # no punctuation


def _powers(base: int, many: int) -> np.ndarray:
    out = np.full(many, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers, so that any of their bits serve."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: Sequence[bytes], in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all UTF-8 texts, and each text's number of words.

    A word is a run of bytes that ``in_word`` holds for. Its hash is a polynomial in
    its bytes, so it is the same wherever the word stands.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = in_word[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    first_of_text = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, first_of_text), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(begins[-1] + lengths[-1]) - np.repeat(begins, lengths)
    terms = _BYTE_VALUE[data[inside]] * _powers(_BYTE_BASE, int(lengths.max()))[place]
    return scramble(np.add.reduceat(terms, begins)), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, size: int, base: int = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each ``size`` words in a row of one text, and each text's number.

    The window's polynomial in ``base``, an odd number, is put together from windows
    of 1, 2, 4, ... words, as the binary digits of ``size`` say.
    """
    many = np.maximum(counts - size + 1, 0)
    total = len(words) - size + 1
    if total <= 0:
        return np.empty(0, np.uint64), many
    part, width = words, 1  # hashes of windows of `width` words
    sums, done = np.zeros(total, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            power = np.uint64(pow(base, done, 1 << 64))
            if size & width:
                sums += part[done:done + total] * power
                done += width
            if done == size:
                break
            part = part[:len(part) - width] + part[width:] * np.uint64(pow(base, width, 1 << 64))
            width *= 2
    ends = np.repeat(np.cumsum(counts), counts)[:total]
    inside = np.arange(total) + size <= ends
    return scramble(sums[inside]), many
