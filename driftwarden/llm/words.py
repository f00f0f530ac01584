"""Words, word hashes and document spans of text batches, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is what
`bytes.split()` yields.  Words are hashed to 64 bits with a polynomial over their bytes
(prefix sums, so a whole batch is hashed without a loop over words) and a final mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BATCH_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below at least n; the usual size is kept for the worker's life."""
    size = 1 << max(BATCH_BYTES.bit_length(), int(n).bit_length())
    if size in _powers:
        return _powers[size]
    out = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(size, base, U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if not _powers:
        _powers[size] = tuple(out)
    return tuple(out)


def lower_ascii(raw: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves all other bytes, hence UTF-8 sequences, alone."""
    return raw.lower()


def batches(texts: Sequence[str | None], lower: bool = False) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of documents of about BATCH_BYTES: (first, past last, joined bytes, byte offset of each)."""
    first, parts, size, offsets = 0, [], 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if parts and size + len(raw) > BATCH_BYTES:
            yield first, i, b"\n".join(parts), np.array(offsets, np.int64)
            first, parts, size, offsets = i, [], 0, []
        offsets.append(size)
        parts.append(lower_ascii(raw) if lower else raw)
        size += len(raw) + 1
    if parts:
        yield first, first + len(parts), b"\n".join(parts), np.array(offsets, np.int64)


def hashed(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of joined documents and, per document, the index of its first word (one more at the end)."""
    data = np.frombuffer(raw, np.uint8)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[:len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return words, np.append(np.searchsorted(starts, offsets), len(starts))


def documents(texts: Sequence[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of every text, in order."""
    for first, last, raw, offsets in batches(texts, lower):
        words, bounds = hashed(raw, offsets)
        for i in range(last - first):
            yield words[bounds[i]:bounds[i + 1]]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; the whole sequence as one if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, U64)
    for j in range(n):
        out = out * U64(BASE) + words[j:len(words) - n + 1 + j]
    return mix(out + U64(n))


def fingerprint(values: np.ndarray) -> bytes:
    """128-bit digest of an array, for equality of whole documents."""
    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
