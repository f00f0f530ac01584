"""SimHash near-duplicate detection over a Gray-order hierarchical index.

1. Every text gets a 64-bit fingerprint; equal fingerprints are one entry from here on.
2. The entries are sorted by Gray rank (the number whose reflected Gray code is the fingerprint), in which
   neighbours differ in few bits, and cut into blocks of at most `BLOCK` consecutive entries.
3. A node holds the bits on which all its entries agree.  Blocks are nodes, ranges of blocks are the nodes above, and so on
   to one root; inside a block groups of `FAN` entries go on in the same way.
4. The index is joined with itself from the root down.  A pair of nodes carries the differences in the bits that both
   share; its children add the differences in the bits they share beyond that, and a pair with
   more than `MOST` is dropped with all that is below it.  Pairs of blocks that are left are searched in tasks.
5. A task joins linked entries to groups and returns one link per entry; groups meet in `components`.

Two entries with at most `MOST` different bits are never dropped, as no node above them counts more, so all links are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.components import components
from driftwarden.llm.frames import bounded_batches, groups
from driftwarden.llm.ranks import lookup
from driftwarden.session import hash_spread, stage_table

U64 = np.uint64
SHINGLE, SEED, MOST = 3, 42, 3
BLOCK, FAN, PAIRS = 32_768, 8, 4096
PIECE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(words: list[bytes]) -> np.ndarray:
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    take = min(SHINGLE, len(words))
    starts, stops = (ends - size)[:len(words) - take + 1].tolist(), ends[take - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, stops)), U64, len(starts))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's word shingles, read in pieces of about `PIECE` bytes; 0 without words."""
    raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
    counts, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw):
        gap = GAP.search(raw, at + PIECE)
        stop = gap.start() if gap else len(raw)
        words = held + raw[at:stop].split()
        held, at = words, stop
        if len(words) >= SHINGLE:
            found = _hashes(words)
            counts, n, held = counts + _bit_counts(found), n + len(found), words[1 - SHINGLE:]
    if not n and held:
        counts, n = _bit_counts(_hashes(held)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long) per row of `docs` (doc_id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = np.array([fingerprint(t) for t in pdf["text"]], U64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": codes})

    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, fp long")


def gray_rank(code):
    """The number whose reflected Gray code is `code`, less 2**63, so that signed longs sort by it."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def index_blocks(codes: DataFrame, n: int) -> DataFrame:
    """(node, parent, ones, zeros, entries) per block of the `n` distinct `codes` (fp); entries are packed in Gray order."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part, seq = np.zeros(0, np.int64), 0, 0

        def row(block):
            u = block.view(U64)
            return pd.DataFrame([(part << 24 | seq, part, *(int(np.bitwise_and.reduce(x).view(np.int64)) for x in (u, ~u)),
                                  block.tobytes())], columns=["node", "parent", "ones", "zeros", "entries"])

        for pdf in batches:
            if len(pdf):
                part, held = int(pdf["part"].iloc[0]), np.concatenate((held, pdf["fp"].to_numpy()))
            while len(held) >= BLOCK:
                yield row(held[:BLOCK])
                held, seq = held[BLOCK:], seq + 1
        if len(held):
            yield row(held)

    ranked = (codes.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(max(1, -(-n // BLOCK)), "rank")
              .sortWithinPartitions("rank").select("fp", F.spark_partition_id().cast("long").alias("part")))
    return ranked.mapInPandas(pack, "node long, parent long, ones long, zeros long, entries binary")


def near_blocks(blocks: DataFrame) -> DataFrame:
    """(a, b) with a <= b: the pairs of blocks whose shared bits leave at most `MOST` differences."""
    top = blocks.agg(F.max("parent")).first()[0] or 0
    both = [F.expr(f"bit_and({c})").alias(c) for c in ("ones", "zeros")]
    levels = [blocks.select("node", "parent", "ones", "zeros")]
    while True:
        level = levels[-1].groupBy(F.col("parent").alias("node")).agg(*both)
        levels.append(level.withColumn("parent", F.shiftright("node", 3)))
        if not top:
            break
        top >>= 3
    mask = F.col("ones").bitwiseOR(F.col("zeros"))
    frontier = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"), mask.alias("seen"), F.lit(0).alias("diff"))
    for level in reversed(levels):
        nodes = level.withColumn("mask", mask)
        one, two = (nodes.select(F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "ones", "mask")]) for s in "ab")
        shared = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        fresh = F.col("a_ones").bitwiseXOR(F.col("b_ones")).bitwiseAND(shared).bitwiseAND(F.bitwise_not("seen"))
        frontier = (frontier.join(one, "a").join(two, "b").filter("a_node <= b_node")
                    .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), shared.alias("seen"),
                            (F.col("diff") + F.bit_count(fresh)).alias("diff")).filter(F.col("diff") <= MOST))
    return frontier.select("a", "b")


def _levels(codes: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(agreed ones, mask of agreed bits, how many) of the nodes over Gray-sorted codes, from the entries up; children
    of one node are a row."""
    ones, zeros, out = codes, ~codes, []
    for level in range(height + 1):
        size, spare = len(ones), -len(ones) % FAN
        out.append((np.append(ones, np.zeros(spare, U64)).reshape(-1, FAN),
                    np.append(ones | zeros, np.zeros(spare, U64)).reshape(-1, FAN), size))
        at = np.arange(0, size, FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
    return out


class Groups:
    """Entries with the least entry of the group that links have joined them to so far."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return changed
            changed, a, b = True, a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def linked_groups(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """The group (least index) of every entry of `one` followed by those of `two`, joined by all links between
    the two blocks, or inside `one` if there is no `two`; codes are in Gray order."""
    other, shift = (one, 0) if two is None else (two, len(one))
    height = 0
    while FAN ** height < max(len(one), len(other)):
        height += 1
    left, right = _levels(one, height), _levels(other, height)
    found = Groups(len(one) + (0 if two is None else len(two)))
    spans: list[np.ndarray] = []

    def refresh():
        spans.clear()
        for first, codes in ((0, one), (shift, other)):
            label, at = found.label[first:first + len(codes)], np.arange(0, len(codes), FAN)
            spans.extend((np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)))

    refresh()
    top = [levels[-1][k].ravel()[:1] for levels in (left, right) for k in (0, 1)]
    stack = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64), np.bitwise_count((top[0] ^ top[2]) & top[1] & top[3]))]
    if not height and two is not None and stack[0][3][0] <= MOST:
        found.join(np.zeros(1, np.int64), np.ones(1, np.int64))
    while stack and height:
        level, i, j, diff = stack.pop()
        if len(i) > PAIRS:
            stack.append((level, i[PAIRS:], j[PAIRS:], diff[PAIRS:]))
            i, j, diff = i[:PAIRS], j[:PAIRS], diff[:PAIRS]
        if level == 1:      # nothing is to be joined between nodes that are one group already
            lo, hi, low, high = spans
            apart = np.minimum(lo[i], low[j]) != np.maximum(hi[i], high[j])
            i, j, diff = i[apart], j[apart], diff[apart]
        seen = (left[level][1].ravel()[i] & right[level][1].ravel()[j])[:, None, None]
        (ones, mask, size), (ones2, mask2, size2) = left[level - 1], right[level - 1]
        fresh = (ones[i][:, :, None] ^ ones2[j][:, None, :]) & ~seen
        if level > 1:
            fresh &= mask[i][:, :, None] & mask2[j][:, None, :]
        diff = diff[:, None, None] + np.bitwise_count(fresh)
        pair, x, y = np.nonzero(diff <= MOST)
        a, b, diff = i[pair] * FAN + x, j[pair] * FAN + y, diff[pair, x, y]
        held = (a < size) & (b < size2)
        if two is None:
            held &= (a <= b) if level > 1 else (a < b)
        a, b, diff = a[held], b[held], diff[held]
        if level > 1:
            if len(a):
                stack.append((level - 1, a, b, diff))
        elif len(a) and found.join(a, b + shift):
            refresh()
    return found.label


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in groups(batches, ["a", "b"]):
        parts = [np.frombuffer(x, np.int64) for x in pdf.sort_values("node")["entries"]]
        codes = np.concatenate(parts)
        label = linked_groups(*(p.view(U64) for p in parts), *([None] if len(parts) == 1 else []))
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pd.DataFrame({"a": codes[moved], "b": codes[label[moved]]})


def links(codes: DataFrame, n: int) -> DataFrame:
    """(a, b): links between the `n` distinct `codes` (fp) that have the same components as all pairs with `MOST` or fewer differing bits."""
    blocks = stage_table(index_blocks(codes, n), "blocks")
    pairs = stage_table(near_blocks(blocks), "block_pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    held = sides.join(blocks.select("node", "entries"), "node")
    return hash_spread(held, "a", "b").sortWithinPartitions("a", "b").select("a", "b", "node", "entries").mapInPandas(
        _search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id per row of `docs` (doc_id, text; other columns are ignored).

    A-Z are lower-cased, shingles are three words (the whole sequence, if there are fewer).  A null or empty text has fingerprint 0 and is linked like
    any other.  Rows are linked if their fingerprints differ in at most `MOST` bits; component_id is the smallest
    doc_id reachable.  Repeated rows and unlike texts under one doc_id are rows like others.  A row without doc_id
    gets its fingerprint, is linked with nothing, and has no component_id.  An empty table gives no rows.
    """
    rows = stage_table(with_fingerprints(docs), "fingerprints")
    entries = stage_table(rows.filter("doc_id is not null").groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies")), "entries")
    n, total = entries.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = components(links(entries.select("fp"), n)).select(F.col("node").alias("fp"), "component")
    joined = entries.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = stage_table(joined, "joined")
    sizes = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = stage_table(lookup(joined, sizes, "component", "members", n).select("fp", "copies", "component_id"), "named")
    out = lookup(rows.filter("doc_id is not null"), named, "fp", "copies", total)
    return out.unionByName(rows.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def as_hex(code):
    """16 lowercase hex digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
