"""Substring deduplication with a compressed FM-index per shard.

The segments of a shard (see `repeats`) form one text over word ranks.  Its Burrows-Wheeler
transform is kept in a wavelet matrix of packed bit vectors, with a block count for each 64
bits.  The segments are then streamed through a backward search: from the end of a pattern to the left
the interval of suffixes that start with the words so far is narrowed, and the smallest
doc_id in that interval is looked up.  As soon as no smaller document is left the match ends, and no
window that holds the words so far needs a look.  A match of 50 words is reported.  After a match the pattern is the next
`LONGEST` words, up to 50 windows in one: all windows that lie in its matched part are reported at once.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame

from driftwarden.llm.repeats import NONE, WINDOW, Segments, remove_repeats

U64 = np.uint64
LONGEST = 2 * WINDOW - 1


class WaveletMatrix:
    """Rank queries over a sequence of small integers; one packed bit vector per bit, highest first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            bit = ((values >> shift) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[:len(bit)] = bit
            blocks = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks).astype(np.int64))))
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, blocks, counts, zeros))
            values = np.concatenate((values[~bit], values[bit]))
        symbols = np.arange(1 << self.bits, dtype=np.int64)
        self.first = self._follow(symbols, np.zeros(len(symbols), np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, blocks, counts, zeros in self.levels:
            mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
            ones = counts[i >> 6] + np.bitwise_count(blocks[i >> 6] & mask)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before position i."""
        return self._follow(symbol, i) - self.first[symbol]


class FMIndex:
    """Backward search over a text of small positive integers with 0 as separator, and the least owner of an interval."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        rank, step = text, 1
        while step < LONGEST:       # order by the first 128 symbols
            after = np.zeros(len(rank), np.int64)
            after[:len(rank) - step] = rank[step:] + 1
            _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.matrix = WaveletMatrix(text[order - 1])
        counts = np.bincount(text, minlength=1 << self.matrix.bits)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.least = [owner[order]]
        while 2 << (len(self.least) - 1) <= len(text):
            row, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(row[:-half], row[half:]))

    def extend(self, symbol, low, high):
        """The interval of symbol + pattern, from the pattern's interval."""
        base = self.before[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)

    def least_owner(self, low, high):
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def least_by_search(seg: Segments) -> list[np.ndarray]:
    """For every window of every segment a doc_id of the shard that has it and is smaller than those of all documents with this very
    segment, if there is one; else the smallest of those."""
    known: dict[bytes, int] = {}
    which = np.empty(len(seg.key), np.int64)
    for s in range(len(seg.key)):
        body = seg.flat[seg.offset[s]:seg.offset[s + 1]].tobytes()
        which[s] = known.setdefault(body, len(known))
    size = np.zeros(len(known), np.int64)
    lowest = np.full(len(known), NONE)
    np.minimum.at(lowest, which, seg.doc)
    size[which] = np.diff(seg.offset)
    codes = np.concatenate([np.frombuffer(b, np.int64) for b in known])
    offset = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(offset[-1] + 1, np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = codes + 1
    owner = np.append(np.repeat(lowest, size + 1), NONE)
    index = FMIndex(text, owner)

    windows = size - WINDOW + 1
    found = [np.full(n, first, np.int64) for n, first in zip(windows.tolist(), lowest.tolist())]
    at = np.zeros(len(size), np.int64)          # the first window without an answer
    known_from, known_to = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)      # windows behind it that have one
    end = np.full(len(size), WINDOW)            # the pattern is [left, end)
    left = end.copy()
    low, high = np.zeros(len(size), np.int64), np.full(len(size), len(text))
    best = np.full(len(size), NONE)             # the least owner of the pattern so far
    active = np.arange(len(size))
    while len(active):
        left[active] -= 1
        symbol = text[offset[active] + left[active]]
        low[active], high[active] = index.extend(symbol, low[active], high[active])
        smallest = index.least_owner(low[active], high[active])
        ended = smallest >= lowest[active]
        done = ~ended & (left[active] == at[active])
        for c, value in zip(active[done].tolist(), smallest[done].tolist()):
            found[c][at[c]:end[c] - WINDOW + 1] = value
        over = active[ended]
        for c in over[left[over] + 1 <= end[over] - WINDOW].tolist():       # the part matched so far holds whole windows
            known_from[c], known_to[c] = left[c] + 1, end[c] - WINDOW + 1
            found[c][known_from[c]:known_to[c]] = best[c]
        best[active] = smallest
        # behind a match a long pattern, before a break the words up to it, else one window
        single = end[active] - at[active] == WINDOW
        matched, broken = active[done], active[ended & ~single]
        at[matched] = end[matched] - WINDOW + 1
        skipped = active[ended & single]
        at[skipped] = left[skipped] + 1
        again = active[done | ended]
        inside = (known_from[again] <= at[again]) & (at[again] < known_to[again])
        at[again[inside]] = known_to[again[inside]]
        end[skipped] = at[skipped] + WINDOW
        end[matched] = np.minimum(at[matched] + LONGEST, size[matched])
        end[broken] = np.where(left[broken] - at[broken] >= WINDOW, left[broken], at[broken] + WINDOW)
        left[again], low[again], high[again] = end[again], 0, len(text)
        active = active[at[active] < windows[active]]
    return [found[c] for c in which.tolist()]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Words of 50-word windows that also start in a document with a smaller doc_id; see `remove_repeats`."""
    return remove_repeats(docs, least_by_search)
