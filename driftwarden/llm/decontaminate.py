"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of other characters than letters and digits as
one space.  An item of length L may differ by k = floor(`rate` * L) edits.  Cut into k + 1 pieces, one
piece must occur unchanged in any passage within that distance, at its own place give
or take k.  An Aho-Corasick automaton finds the pieces in one pass over a document; the stretch around a
hit is verified with Myers' bit-parallel edit distance.  Items of fewer than `EXACT_CHARS` characters are one piece
without a budget, which must stand between word boundaries.

Documents are read where they lie, without a shuffle.  The items are the stated query set: they
are dealt by hash to blocks of about `BLOCK_CHARS` characters, and every block is broadcast
and run over all documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.frames import bounded_batches

RATE = 0.08
LEAST_CHARS, EXACT_CHARS = 8, 24
BLOCK_CHARS = 8_000_000
OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return OTHER.sub(" ", text.lower()).strip() if isinstance(text, str) else ""


def budget_of(item: str, rate: float) -> int:
    return int(rate * len(item)) if len(item) >= EXACT_CHARS else 0


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 parts of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def search(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of `text`, the first of equals; None beyond `budget`.

    Myers: the column of the edit table is kept as two bit vectors of its vertical steps of +1 and -1.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    plus, minus, score, best = full, 0, len(pattern), None
    for j, c in enumerate(text):
        same = masks.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        right_plus = minus | ~(diagonal | plus) & full
        right_minus = plus & diagonal
        if right_plus & top:
            score += 1
        elif right_minus & top:
            score -= 1
        right_plus = right_plus << 1 & full        # the first row is all 0: a match may start anywhere
        right_minus = right_minus << 1 & full
        vertical = same | minus
        plus = right_minus | ~(vertical | right_plus) & full
        minus = right_plus & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


@functools.lru_cache(maxsize=2000)
def _closest(item: str, stretch: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best place in a stretch."""
    found = search(item, stretch, budget)
    if found is None:
        return None
    distance, end = found
    back = search(item[::-1], stretch[:end][::-1][:len(item) + budget], distance)
    return distance, end - back[1] if back else max(0, end - len(item)), end


def _places(item: str, stretch: str, budget: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of every place of the item in a stretch: the closest, and those before and behind it."""
    if len(stretch) < len(item) - budget:
        return []
    found = _closest(item, stretch, budget)
    if found is None:
        return []
    distance, start, end = found
    return [*_places(item, stretch[:start], budget), found,
            *((d, a + end, b + end) for d, a, b in _places(item, stretch[end:], budget))]


def automaton(items: tuple[tuple[int, str], ...], rate: float = RATE):
    """The pieces of all items, each with the items and offsets it comes from."""
    owners: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(items):
        for offset, piece in pieces(text, budget_of(text, rate)):
            owners.setdefault(piece, []).append((i, offset))
    out = ahocorasick.Automaton()
    for piece, where in owners.items():
        out.add_word(piece, (len(piece), tuple(where)))
    out.make_automaton()
    return out


_held: dict[tuple[int, float], object] = {}


def _held_automaton(items: tuple[tuple[int, str], ...], rate: float):
    """The automaton of a broadcast block, built once per worker; one block's at a time."""
    key = (id(items), rate)
    if key not in _held:
        _held.clear()
        _held[key] = automaton(items, rate)
    return _held[key]


def matches(text: str | None, items: tuple[tuple[int, str], ...], found, rate: float = RATE) -> list[tuple]:
    """(index of the item, distance, start, stop) of every place of an item in a text; `found` is the items' automaton."""
    text = normalised(text)
    stretches: dict[int, list[list[int]]] = {}
    if not items or not text:
        return []
    out = []
    for last, (size, where) in found.iter(text):
        for i, offset in where:
            length = len(items[i][1])
            if length < EXACT_CHARS:
                first = last + 1 - size
                if (not first or text[first - 1] == " ") and text[last + 1:last + 2] in ("", " "):
                    out.append((i, 0, first, last + 1))
                continue
            budget = budget_of(items[i][1], rate)
            begin = last + 1 - size - offset - budget
            held = stretches.setdefault(i, [])
            span = [max(0, begin), begin + length + 2 * budget]
            if held and span[0] <= held[-1][1] and span[1] >= held[-1][0]:
                held[-1] = [min(span[0], held[-1][0]), max(span[1], held[-1][1])]
            else:
                held.append(span)
    for i, spans in sorted(stretches.items()):
        for a, b in spans:
            out += [(i, d, a + x, a + y) for d, x, y in _places(items[i][1], text[a:b], budget_of(items[i][1], rate))]
    return sorted(set(out))


def item_blocks(benchmark: DataFrame, least_chars: int = LEAST_CHARS):
    """Broadcast-sized blocks of (item_id, normalised text), without null ids and items too short to tell."""
    items = bounded_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("item_id").isNotNull() & (F.length("text") >= least_chars)).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        rows = sorted((r[0], normalised(r[1])) for r in block.collect())
        yield tuple((k, t) for k, t in rows if len(t) >= least_chars)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, stop: every item found in every row of `docs` (doc_id, text).

    Every place of an item in a row counts, as a range of the normalised text (of places that overlap the closest, the first of
    equals).  Two items at one place are both reported.  A null or empty text holds nothing; a null doc_id is reported as null; repeated
    rows are each reported; an item with a null id, a null text or fewer than `LEAST_CHARS` characters is left out, as it
    occurs by chance.  Empty tables give no rows.
    """
    schema = "doc_id long, item_id long, distance int, start int, stop int"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context, out = docs.sparkSession.sparkContext, None
    for block in item_blocks(benchmark):
        shared = context.broadcast(block)

        def run(batches, shared=shared):
            pieces_of = _held_automaton(shared.value, rate)
            for pdf in batches:
                rows = [(doc, shared.value[i][0], d, a, b) for doc, text in zip(pdf["doc_id"], pdf["text"])
                        for i, d, a, b in matches(text, shared.value, pieces_of, rate)]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "stop"])
                found["doc_id"] = found["doc_id"].astype("Int64")
                yield found

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """`docs` (text and any other columns) without the rows that hold a benchmark item."""
    def leaks_of(shared):
        @F.pandas_udf("boolean")
        def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces_of = _held_automaton(shared.value, rate)
            for text in batches:
                yield pd.Series([bool(matches(t, shared.value, pieces_of, rate)) for t in text], dtype=bool)
        return leaks(F.col("text").cast("string"))

    for block in item_blocks(benchmark):
        docs = docs.filter(~leaks_of(docs.sparkSession.sparkContext.broadcast(block)))
    return docs
