"""64-bit fingerprints of words and word shingles, computed over whole Arrow batches with NumPy.

Texts are read as UTF-8 bytes. A word's fingerprint is a polynomial over its (lower-cased) bytes, taken
from prefix sums modulo 2**64, so a batch needs a few vector passes and no loop over words. Memory is
bounded by the batch: bytes are worked on in blocks of ``BLOCK`` (or one word, if a word is longer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA5CB9243D9B8E5A1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_powers = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return mix(lower + np.uint64(1))


VALUES = _byte_values()


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for positions 0..n-1."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK)
        steps = np.ones(size, np.uint64)
        back = np.ones(size, np.uint64)
        steps[1:], back[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
        _powers = (np.multiply.accumulate(steps), np.multiply.accumulate(back))
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans ``[starts, ends)``, which must be sorted and must not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        base = int(starts[i])
        block = data[base : int(ends[j - 1])]
        up, down = power_tables(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(VALUES[block] * up, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and where each begins (one more entry than texts); null is empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes that do not cross texts, and the first word of each text."""
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(is_word))]
    begin[edges] = is_word[edges]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[edges - 1] = is_word[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shingle_sets(texts: pa.Array, words: int):
    """For each text the sorted distinct fingerprints of its shingles of ``words`` words.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D. A text with fewer words
    (but not none) has one shingle, its whole word sequence; a text without words has none.
    """
    data, offsets = text_bytes(texts)
    starts, ends, first = spans(~_BLANK[data], offsets)
    hashes = span_hashes(data, starts, ends)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * (_STEPS[k % len(_STEPS)] + np.uint64(2 * k))
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            found = np.sort(rolled[a : b - words + 1])
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            yield found[keep]
        elif b > a:
            few = hashes[a:b] * (_STEPS[: b - a] if b - a <= len(_STEPS) else mix(np.arange(b - a, dtype=np.uint64)))
            yield mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
