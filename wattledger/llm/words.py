"""Vectorised hashing of the words of many texts.

A batch of texts becomes one byte buffer. A prefix sum of ``table[byte] * base**i`` modulo 2**64 gives the hash of any
span as a difference, so words are found and hashed by a dozen array operations and never become Python objects.
Everything here runs inside tasks, on one chunk of about a megabyte (or one longer text) at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_LETTERS = np.zeros(256, bool)
_LETTERS[128:] = True
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _LETTERS[_first:_last + 1] = True
_TYPOGRAPHY = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64 bits: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base & _MASK, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """Words of a chunk: hash, byte span, and where the words of each text start."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # len(texts) + 1
    text_at: np.ndarray  # byte at which each text starts
    prefix: np.ndarray
    inverse: np.ndarray

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans."""
        return mix((self.prefix[end] - self.prefix[begin]) * self.inverse[begin])


def hash_words(texts: list[str], letters: bool = False) -> Words:
    """Words are maximal runs without white space (0x09-0x0D, 0x20), or with ``letters`` of letters and digits."""
    if letters:
        texts = [_TYPOGRAPHY.sub(" ", t.lower()) for t in texts]
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    inside = (_LETTERS if letters else _SPACE)[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:-1], out=prefix[1:])
    offsets = np.concatenate([np.searchsorted(begin, text_at), [len(begin)]])
    words = Words(np.zeros(0, np.uint64), begin, end, offsets, text_at, prefix, inverse)
    words.hashes = words.spans(begin, end)
    return words


def chunks(texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about ``limit`` characters each; a longer text is a chunk of its own, never cut."""
    part: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if part and size + len(text) > limit:
            yield first, part
            part, first, size = [], i, 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield first, part


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text, in order."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out += h[j:j + len(out)] * _STEPS[j]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the offsets by text. A text of fewer words is one run; an empty one has none."""
    counts = np.diff(words.offsets)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    h = words.hashes
    full = runs(h, k)
    out = np.zeros(offsets[-1], np.uint64)
    local = np.arange(len(out)) - np.repeat(offsets[:-1], sizes)
    start = np.repeat(words.offsets[:-1], sizes) + local
    long = np.repeat(counts >= k, sizes)
    out[long] = full[start[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        part = h[words.offsets[i]:words.offsets[i + 1]]
        out[offsets[i]] = mix((part * _STEPS[:len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return out, offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every slice sorted and without repeats."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
