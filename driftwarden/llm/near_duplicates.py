"""MinHash near-duplicate detection with b-bit signatures.

1. One pass over the texts makes, per document, the digest of its shingle set, a signature of
   the low `BITS` bits of `HASHES` minima packed into longs, and one key per band of
   `ROWS` full minima.  Documents with equal sets become one class, so any number of exact
   copies costs one row from here on.
2. Classes that share a band key are candidates.  A class is first compared with the smallest
   class it shares a bucket with (a linear number of pairs); buckets whose members are
   thereby joined are done.
3. In the buckets left, pairs are rated by counting equal b-bit values of the packed signatures,
   corrected for accidental equality; the links of a spanning forest per block give clusters.
4. A cluster is verified on full shingle sets in blocks of at most 2 x `CHUNK` classes.  A block
   returns a spanning forest of its true links, which has the same components as all of them.

A link of similarity s is missed with probability (1 - s**ROWS) ** BANDS (4e-7 at 0.85, 5e-5 at 0.8) plus
the chance that the estimate is below `cut` (4.6 standard deviations, 1e-5 at 0.85; 4.1 and 5e-5 at 0.8).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.llm import words as W
from driftwarden.llm.components import components
from driftwarden.llm.frames import bounded_batches, groups
from driftwarden.session import stage_table

HASHES, BITS, ROWS, BANDS = 128, 4, 5, 25
MULTIPLIERS = W.mix(np.arange(11, 11 + HASHES, dtype=np.uint64) * np.uint64(W.BASE)) | np.uint64(1)
BAND_MULTIPLIERS = W.mix(np.arange(911, 911 + ROWS, dtype=np.uint64)) | np.uint64(1)
BAND_SALTS = W.mix(np.arange(7001, 7001 + BANDS, dtype=np.uint64))
NIBBLES = 0x1111111111111111
CHUNK = 256


def minima(values: np.ndarray) -> np.ndarray:
    """The least product with every multiplier; a multiplier permutes the 64-bit numbers."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(out, (MULTIPLIERS[:, None] * values[None, i:i + 2048]).min(axis=1), out=out)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low four bits of the minima, 16 to a long."""
    low = (least & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[:ROWS * BANDS].reshape(BANDS, ROWS)
    return W.mix((rows * BAND_MULTIPLIERS).sum(axis=1, dtype=np.uint64) ^ BAND_SALTS).view(np.int64)


def shingle_sets(texts, n: int) -> Iterator[np.ndarray]:
    for doc in W.documents(texts, lower=True):
        yield np.unique(W.shingles(doc, n))


def equal_values(a: list[Column], b: list[Column]) -> Column:
    """How many of the packed four-bit values of two signatures are equal."""
    def differing(x, y):
        z = x.bitwiseXOR(y)
        for shift in (2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(NIBBLES)))
    total = F.lit(HASHES)
    for x, y in zip(a, b):
        total = total - differing(x, y)
    return total


def estimated(equal):
    """Similarity from the share of equal b-bit values, less the share that agrees by accident."""
    chance = 2.0 ** -BITS
    return (equal / float(HASHES) - chance) / (1 - chance)


def forest(size: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of links that join what the links before them have not joined."""
    parent, keep = list(range(size)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            keep.append(i)
    return keep


def blocks(df: DataFrame, group: str, fine: str, chunk: int) -> DataFrame:
    """Cut every group into chunks by a hash of `fine` and pair the chunks: rows get `group`, `ci`, `cj`
    and `side` (0: chunk ci, 1: chunk cj; both for ci = cj are side 0).

    Every pair of a group's rows meets in a block, and no block holds more than two chunks.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).filter("_n > 1").withColumn(
        "_k", F.ceil(F.col("_n") / chunk).cast("int"))
    rows = df.join(sizes, group).withColumn("_c", F.pmod(F.xxhash64(fine), F.col("_k")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.expr("sequence(0, _k - 1)")))
    return rows.select("*", F.least("_c", "_o").alias("ci"), F.greatest("_c", "_o").alias("cj"),
                       F.when(F.col("_c") <= F.col("_o"), 0).otherwise(1).alias("side")).drop("_n", "_k", "_c", "_o")


def _rated(cut: float):
    """Blocks of signatures -> spanning forest over classes of links rated `cut` or more."""
    def run(batches):
        for pdf in groups(batches, ["key", "ci", "cj"]):
            sig = np.array(pdf["sig"].tolist(), np.int64).reshape(len(pdf), -1).view(np.uint64)
            ids, home, side = (pdf[c].to_numpy() for c in ("cid", "home", "side"))
            apart = pdf["ci"].iloc[0] != pdf["cj"].iloc[0]
            lefts, rights = [], []
            for i in range(len(pdf) - 1):
                z = sig[i + 1:] ^ sig[i]
                z |= z >> np.uint64(2)
                z |= z >> np.uint64(1)
                equal = HASHES - np.bitwise_count(z & np.uint64(NIBBLES)).sum(axis=1)
                hit = (estimated(equal) >= cut) & (home[i + 1:] != home[i])
                if apart:
                    hit &= side[i + 1:] != side[i]
                j = np.flatnonzero(hit) + i + 1
                lefts.append(np.full(len(j), i))
                rights.append(j)
            a, b = np.concatenate(lefts or [[]]).astype(int), np.concatenate(rights or [[]]).astype(int)
            keep = forest(len(pdf), a, b)
            if keep:
                yield pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]]})
    return run


def _verified(num: int, den: int):
    """Blocks of shingle sets -> spanning forest of the links with den * intersection >= num * union."""
    def run(batches):
        for pdf in groups(batches, ["cluster", "ci", "cj"]):
            ids, home, side = (pdf[c].to_numpy() for c in ("cid", "home", "side"))
            sets = [np.asarray(s, np.int64) for s in pdf["members"]]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            common = count[code] > 1
            owner, code = owner[common], code[common]
            _, code = np.unique(code, return_inverse=True)
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], code[order]
            shared = np.zeros((len(sets), len(sets)), np.float32)
            width = max(1024, (1 << 21) // max(1, len(sets)))
            for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
                a, b = np.searchsorted(code, [first, first + width])
                grid = np.zeros((len(sets), width), np.float32)
                grid[owner[a:b], code[a:b] - first] = 1
                shared += grid @ grid.T
            shared = np.rint(shared).astype(np.int64)
            hit = np.triu(den * shared >= num * (sizes[:, None] + sizes[None, :] - shared), 1)
            hit &= home[:, None] != home[None, :]
            if pdf["ci"].iloc[0] != pdf["cj"].iloc[0]:
                hit &= side[:, None] != side[None, :]
            a, b = np.nonzero(hit)
            keep = forest(len(sets), a, b)
            if keep:
                yield pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]]})
    return run


def _links(classes: DataFrame, docs: DataFrame, n: int, share: Fraction, cut: float) -> DataFrame:
    """Links (a, b) between classes, with the same components as all true links."""
    num, den = share.numerator, share.denominator
    keys = classes.select("cid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("first")).filter("n > 1")
    members = stage_table(keys.join(buckets, "key").select("key", "cid", "first"), "buckets")
    pairs = members.groupBy("cid").agg(F.min("first").alias("first")).filter("first < cid")
    signed = classes.select("cid", "sig")
    one, two = [F.col("x")[i] for i in range(HASHES * BITS // 64)], [F.col("y")[i] for i in range(HASHES * BITS // 64)]
    pairs = (pairs.join(signed.withColumnRenamed("sig", "x"), "cid")
             .join(signed.select(F.col("cid").alias("first"), F.col("sig").alias("y")), "first")
             .filter(estimated(equal_values(one, two)) >= cut).select("cid", "first"))

    wanted = members.select("cid").distinct().join(classes.select("cid", "doc_id", "fp"), "cid")

    def sets(batches):
        for pdf in batches:
            found = [x.view(np.int64) for x in shingle_sets(pdf["text"], n)]
            same = np.array([W.fingerprint(x.view(np.uint64)) == bytes(f) for x, f in zip(found, pdf["fp"])], bool)
            if same.any():          # rows of another text under the doc_id drop out
                yield pd.DataFrame({"cid": pdf["cid"][same], "members": [x for x, s in zip(found, same) if s]})

    texts = (docs.join(wanted, "doc_id").select("cid", "fp", "text")
             .mapInPandas(sets, "cid long, members array<long>"))
    sets_of = stage_table(texts, "shingles")

    inside = F.size(F.array_intersect("members", "other"))
    star = (pairs.join(sets_of, "cid")
            .join(sets_of.select(F.col("cid").alias("first"), F.col("members").alias("other")), "first")
            .filter(den * inside >= num * (F.size("members") + F.size("other") - inside))
            .select(F.col("cid").alias("a"), F.col("first").alias("b")).distinct())
    star = stage_table(star, "stars")

    # home: a class already joined to the class; one hop further reaches the group's smallest class
    hop = star.select(F.col("a").alias("cid"), F.col("b").alias("home"))
    hop = hop.join(hop.select(F.col("cid").alias("home"), F.col("home").alias("far")), "home", "left").select(
        "cid", F.coalesce("far", "home").alias("home"))
    placed = members.select("key", "cid").join(hop, "cid", "left").withColumn("home", F.coalesce("home", "cid"))
    placed = stage_table(placed, "placed")
    # of buckets with the same members one is enough
    open_keys = (placed.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi"),
                                           F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n"))
                 .filter("lo < hi").groupBy("sum", "n").agg(F.min("key").alias("key")).select("key"))
    rated = (blocks(placed.join(open_keys, "key").join(signed, "cid"), "key", "cid", CHUNK)
             .repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
             .select("key", "ci", "cj", "side", "cid", "home", "sig").mapInPandas(_rated(cut), "a long, b long"))
    rated = stage_table(rated.distinct(), "rated")
    homes = placed.select("cid", "home").distinct()
    # clusters of rated links, verified whole; what a star has joined keeps one home
    clusters = components(rated).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    grouped = blocks(clusters.join(homes, "cid").join(sets_of, "cid"), "cluster", "cid", CHUNK)
    verified = (grouped.repartition("cluster", "ci", "cj").sortWithinPartitions("cluster", "ci", "cj")
                .select("cluster", "ci", "cj", "side", "cid", "home", "members")
                .mapInPandas(_verified(num, den), "a long, b long"))
    return star.union(stage_table(verified, "verified"))      # so that no task runs two Python workers


def _grouped(docs: DataFrame, n: int, similarity: float, cut: float | None) -> DataFrame:
    """The rows of `near_duplicates` with `linked`, one number per linked group (null without shingles or doc_id)."""
    share = Fraction(str(similarity)).limit_denominator(10_000)
    cut = similarity - 0.15 if cut is None else cut
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("body", F.xxhash64("text"))

    def sketch(batches):
        for pdf in batches:
            rows = []
            for doc, body, values in zip(pdf["doc_id"], pdf["body"], shingle_sets(pdf["text"], n)):
                doc = None if pd.isna(doc) else int(doc)
                if len(values) and doc is not None:
                    least = minima(values)
                    rows.append((doc, body, len(values), W.fingerprint(values), pack(least), band_keys(least)))
                else:
                    rows.append((doc, body, len(values), None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "body", "n_shingles", "fp", "sig", "bands"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    sketched = stage_table(docs.mapInPandas(
        sketch, "doc_id long, body long, n_shingles long, fp binary, sig array<long>, bands array<long>"), "sketches")
    classes = stage_table(sketched.filter("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = components(_links(classes, docs, n, share, cut)).select(F.col("node").alias("cid"), "component")
    labels = classes.select("cid", "fp", "doc_id").join(found, "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(least, "component").select("fp", "component_id", F.col("component").alias("linked"))
    return (sketched.select("doc_id", "body", "n_shingles", "fp").join(named, "fp", "left")
            .select("doc_id", "body", "n_shingles", "linked", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, cut: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, body per row of `docs` (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z); a text with fewer than `n` words has its whole sequence as one
    shingle; a null text or one without words has no shingles and is linked with nothing.
    Two rows are linked when their sets' Jaccard similarity is `similarity` or more;
    component_id is the smallest doc_id reachable over links, and kept marks the row that bears it.
    Repeated rows are linked like any copies; unlike texts under one doc_id are groups of their own, though the same
    doc_id may name them.  A row without doc_id cannot name a component: it is
    linked with nothing, its component_id is null and it is kept.  An empty table gives no rows.
    body is a 64-bit hash of the text, by which `keep_one` finds its rows.
    """
    return _grouped(docs, n, similarity, cut).drop("linked")


def keep_one(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with one row of each group of near duplicates, that of the smallest doc_id.

    Of equal rows (doc_id and text) one stays; unlike texts under one doc_id all stay; rows without doc_id all
    stay; cases as in `near_duplicates`.
    """
    found = _grouped(docs, n, similarity, None).filter(F.col("doc_id").isNotNull())
    linked = found.filter("n_shingles > 0 and kept").groupBy("doc_id", "linked").agg(F.min("body").alias("body"))
    stays = linked.select("doc_id", "body").union(found.filter("n_shingles = 0").select("doc_id", "body").distinct())
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"))
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__body", F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(stays, ["__id", "__body"], "left_semi").dropDuplicates(["__id", "__body"])
    return kept.unionByName(keyed.filter(F.col("__id").isNull())).select(*docs.columns)
