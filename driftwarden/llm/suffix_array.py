"""Suffix-array deduplication over a sparse suffix array.

Only suffixes that begin at an anchor (a content-selected minimiser position, see `repeats`) are kept:
about one in 22.  Per shard they are sorted by their words, neighbours are compared (the
array of common prefix lengths), and matches are extended to the left by a second sorted array over
the reversed words before the anchor.  Two windows with their anchor l words in are equal just if the
suffixes share 50 - l words and the reversed parts share l, which are runs of the two
arrays without a smaller common length.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame

from driftwarden.llm.repeats import NONE, WINDOW, Segments, remove_repeats, without_repeats


def _depth_classes(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix length with the predecessor; -1 where the key changes) of the sorted rows."""
    order = np.lexsort((*rows.T[::-1], key))
    same = rows[order][1:] == rows[order][:-1]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) if rows.shape[1] else np.zeros(len(same), int)
    common[key[order][1:] != key[order][:-1]] = -1
    return order, common


def _class_of(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(common < depth)))
    return out


def least_by_suffixes(seg: Segments) -> list[np.ndarray]:
    """For every window of every segment the smallest doc_id of the shard that has it."""
    lead, size = seg.lead.astype(np.int64), np.diff(seg.offset)

    def part(index, held):
        # the words at `index`, 0 where the segment has none
        safe = np.clip(index, 0, len(seg.flat) - 1)
        return np.where(held, seg.flat[safe] + 1, 0)

    right = np.arange(WINDOW)
    anchor = seg.offset[:-1] + lead
    suffix = part(anchor[:, None] + right, lead[:, None] + right < size[:, None])
    left = np.arange(1, int(lead.max(initial=0)) + 1)
    before = part(anchor[:, None] - left, left <= lead[:, None])
    by_suffix, by_before = _depth_classes(seg.key, suffix), _depth_classes(seg.key, before)
    least = [np.full(n, NONE, np.int64) for n in seg.count.tolist()]
    for offset in range(int(lead.max(initial=0)) + 1):
        window = lead - offset
        rows = np.flatnonzero((window >= 0) & (window < seg.count))
        if not len(rows):
            continue
        a, b = _class_of(*by_suffix, WINDOW - offset)[rows], _class_of(*by_before, offset)[rows]
        order = np.lexsort((seg.doc[rows], b, a))
        a, b, docs = a[order], b[order], seg.doc[rows][order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.repeat(docs[starts], np.diff(np.append(starts, len(a))))
        for s, w, value in zip(rows[order].tolist(), window[rows][order].tolist(), first.tolist()):
            least[s][w] = value
    return least


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Words of passages of 50 or more words that a document with a smaller doc_id has too; see `remove_repeats`."""
    return remove_repeats(docs, least_by_suffixes)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with those passages cut out of `text`; see `without_repeats`."""
    return without_repeats(docs, least_by_suffixes)
