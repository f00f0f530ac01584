"""Repeated passages: what suffix-array and FM-index deduplication have in common.

A window is `WINDOW` consecutive words.  A window's anchor is the leftmost least `GRAM`-word hash
in it, so equal windows have equal anchors at equal offsets, and only about one position in 22
is an anchor.  A window whose anchor is one in no other document (after equal texts are reduced to
the smallest doc_id) is not repeated; the rest is cut into segments - an anchor with the
words of all its windows - and dealt by anchor to shards, where a matcher decides.  A frequent anchor is dealt over several
salts; its windows then meet again by digest, after a partial aggregation.

The matcher gets the segments of a shard and returns, for every window, the smallest doc_id that has
it.  A word is removed if one of its windows has a smaller doc_id than its own document.

Words are compared by 64-bit hashes: two unlike words are taken for one with a chance of 5e-20 per pair, and a window is cut by
mistake only where such a pair stands between 49 equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from driftwarden.llm import words as W
from driftwarden.llm.frames import bounded_batches, groups
from driftwarden.session import stage_table

WINDOW, GRAM = 50, 8
SPAN = WINDOW - GRAM + 1
PER_SALT = 4096
PER_SHARD = 8000
NONE = np.iinfo(np.int64).max


@dataclass
class Segments:
    """Segments of one shard: the word hashes of segment s are words[offset[s]:offset[s + 1]], and flat has the ranks of
    these hashes in the shard; its window j starts at word j and has its anchor `lead[s] - j` words further on, for j below `count[s]`."""
    key: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    flat: np.ndarray
    offset: np.ndarray
    lead: np.ndarray
    count: np.ndarray


Matcher = Callable[[Segments], list[np.ndarray]]


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, anchor position of every window)."""
    if len(words) < WINDOW:
        return words[:0], np.zeros(0, np.int64)
    grams = W.shingles(words, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    return grams, view.argmin(axis=1) + np.arange(len(view))


def _segments_of(words: np.ndarray, known: dict[int, int]) -> list[tuple]:
    """(key, salts, lead, count, words, starts) of a document's windows that may be repeated."""
    grams, at = anchors(words)
    if not len(at):
        return []
    keys = grams[at].view(np.int64)
    open_ = np.flatnonzero(np.isin(keys, np.fromiter(known, np.int64, len(known))))
    if not len(open_):
        return []
    cut = np.flatnonzero((np.diff(open_) != 1) | (np.diff(at[open_]) != 0)) + 1
    found: dict[tuple, list[int]] = {}
    for run in np.split(open_, cut):
        start, count = int(run[0]), len(run)
        key = int(keys[start])
        body = words[start:start + count + WINDOW - 1].tobytes()
        found.setdefault((key, known[key], int(at[start]) - start, count, body), []).append(start)
    return [(*k, starts) for k, starts in found.items()]


def shard_segments(pdf: pd.DataFrame) -> Segments:
    parts = [np.frombuffer(b, np.uint64) for b in pdf["words"]]
    words = np.concatenate(parts)
    return Segments(pdf["key"].to_numpy(), pdf["doc_id"].to_numpy(), words, np.unique(words, return_inverse=True)[1].astype(np.int64),
                    np.cumsum([0, *map(len, parts)]), pdf["lead"].to_numpy(), pdf["count"].to_numpy())


def _match(matcher: Matcher):
    """Shards -> spans of a document (digest null), or a salted window with its least and its members."""
    def run(batches):
        for pdf in groups(batches, ["shard"]):
            pdf = pdf.reset_index(drop=True)
            seg = shard_segments(pdf)
            least = matcher(seg)
            rows, classes = [], {}
            for i, (doc, fp, starts, salts) in enumerate(zip(seg.doc.tolist(), pdf["fp"], pdf["starts"], pdf["salts"])):
                if salts == 1:
                    hit = np.flatnonzero(least[i] < doc)
                    for part in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1) if len(hit) else ():
                        rows.append((None, None, [(doc, fp, int(s + part[0]), int(s + part[-1]) + WINDOW) for s in starts]))
                    continue
                body = seg.words[seg.offset[i]:seg.offset[i + 1]]
                for j, low in enumerate(least[i].tolist()):
                    digest = hashlib.blake2b(body[j:j + WINDOW].tobytes(), digest_size=16).digest()
                    held = classes.setdefault(digest, [NONE, []])
                    held[0] = min(held[0], low, doc)
                    held[1].extend((doc, fp, int(s) + j, int(s) + j + WINDOW) for s in starts)
            rows += [(digest, low, members) for digest, (low, members) in classes.items()]
            out = pd.DataFrame(rows, columns=["digest", "least", "members"])
            out["least"] = out["least"].astype("Int64")
            yield out
    return run


SPANS = "array<struct<doc_id: long, fp: binary, start: int, stop: int>>"


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((int(s["start"]), int(s["stop"])) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def _kept(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    kept = np.ones(n, bool)
    for start, stop in spans:
        kept[start:stop] = False
    return kept


def kept_words(text: str, spans: list[tuple[int, int]]) -> bytes:
    """The words outside the spans, joined by one space."""
    words = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(w for w, k in zip(words, _kept(len(words), spans)) if k)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans' words and the space after each; all other bytes stay."""
    raw = text.encode("utf-8", "surrogatepass")
    gap = W.SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)) == -1)
    edges = np.append(starts, len(raw))
    parts = [raw[:edges[0]]]
    for start, stop in zip(*_runs(_kept(len(starts), spans))):
        parts.append(raw[edges[start]:edges[stop]])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def remove_repeats(docs: DataFrame, matcher: Matcher) -> DataFrame:
    """doc_id, fp, n_words, n_removed, spans (word ranges), kept_sha256 per row of `docs` (doc_id, text).

    fp is the digest of the row's words, kept_sha256 that of the kept words joined by one space.
    A null text has no words; a document shorter than a window keeps all its words; equal words
    under one doc_id are not a repeat; of repeated texts the smallest doc_id keeps them.  A row without
    doc_id keeps its words and takes them from nobody.  An empty table gives no rows.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches):
        for pdf in batches:
            rows = []
            for doc, text, words in zip(pdf["doc_id"], pdf["text"], W.documents(pdf["text"])):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                grams, at = anchors(words)
                rows.append((doc, len(words), W.fingerprint(words), np.unique(grams[np.unique(at)]).view(np.int64),
                             hashlib.sha256(b" ".join(raw.split())).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "fp", "keys", "whole_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    scanned = stage_table(docs.mapInPandas(
        scan, "doc_id long, n_words long, fp binary, keys array<long>, whole_sha256 string"), "scanned")
    texts = stage_table(scanned.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"), F.count("*").alias("n")), "texts")
    spots = texts.select("doc_id", "fp", F.explode("keys").alias("key"))
    shared = (spots.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
              .filter("lo < hi").select("key", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    known = spots.join(shared, "key").groupBy("doc_id", "fp").agg(F.collect_list(F.struct("key", "salts")).alias("known"))
    held = stage_table(docs.join(known, "doc_id").select("doc_id", "fp", "text", "known"), "held")
    total = held.agg(F.sum(F.size("known"))).first()[0] or 0
    shards = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_SHARD))

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, fp, known_, words in zip(pdf["doc_id"], pdf["fp"], pdf["known"], W.documents(pdf["text"])):
                fp = bytes(fp)
                if W.fingerprint(words) != fp:      # another text under the same doc_id
                    continue
                for key, salts, lead, count, body, starts in _segments_of(words, {k["key"]: k["salts"] for k in known_}):
                    rows.append((key, salts, doc, fp, lead, count, body, starts))
            yield pd.DataFrame(rows, columns=["key", "salts", "doc_id", "fp", "lead", "count", "words", "starts"])

    segments = held.mapInPandas(cut, "key long, salts int, doc_id long, fp binary, lead int, count int, "
                                     "words binary, starts array<int>")
    segments = segments.withColumn("shard", F.pmod(F.xxhash64(
        "key", F.pmod(F.xxhash64("doc_id"), F.col("salts"))), F.lit(shards)).cast("int"))
    found = stage_table(segments.repartition(shards, "shard").sortWithinPartitions("shard")
                        .mapInPandas(_match(matcher), f"digest binary, least long, members {SPANS}"), "found")
    salted = found.filter("digest is not null")
    least = salted.groupBy("digest").agg(F.min("least").alias("first"))
    later = salted.join(least, "digest").select(F.filter("members", lambda m: m["doc_id"] > F.col("first")).alias("members"))
    spans = found.filter("digest is null").select("members").union(later).select(F.inline("members"))
    spans = spans.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def keep(batches):
        for pdf in batches:
            rows = []
            for doc, fp, text, found_, words in zip(pdf["doc_id"], pdf["fp"], pdf["text"], pdf["spans"],
                                                    W.documents(pdf["text"])):
                if W.fingerprint(words) != bytes(fp):
                    continue
                cuts = merged(found_)
                rows.append((doc, bytes(fp), sum(b - a for a, b in cuts), [{"start": a, "stop": b} for a, b in cuts],
                             hashlib.sha256(kept_words(text, cuts)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "fp", "n_removed", "spans", "kept_sha256"])

    changed = held.select("doc_id", "fp", "text").join(spans, ["doc_id", "fp"]).mapInPandas(
        keep, "doc_id long, fp binary, n_removed long, spans array<struct<start: int, stop: int>>, "
              "kept_sha256 string").dropDuplicates(["doc_id", "fp"])
    copies = texts.filter("n > 1").select("fp", F.col("doc_id").alias("first"))
    rows = scanned.select("doc_id", "n_words", "fp", "whole_sha256").join(copies, "fp", "left")
    rows = rows.join(changed, ["doc_id", "fp"], "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    empty = F.array().cast("array<struct<start: int, stop: int>>")
    return rows.select(
        "doc_id", "fp", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", empty)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
    """The text without the spans listed for its digest; null where no word is left."""
    out = []
    for body, listed in zip(text, cuts):
        if listed is not None and isinstance(body, str):
            digest = W.fingerprint(next(W.documents([body])))
            spans = [merged(c["spans"]) for c in listed if bytes(c["fp"]) == digest]
            if spans:
                body = cut_words(body, spans[0]) if kept_words(body, spans[0]) else None
        out.append(body)
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, matcher: Matcher) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with repeated passages cut out of `text`.

    A document that loses all its words is dropped; one that loses none keeps its text byte for byte, as do
    null and empty texts.  Where one doc_id has several texts, each is cut by its own spans.
    """
    found = (remove_repeats(docs, matcher).filter("n_removed > 0").groupBy(F.col("doc_id").alias("__cut_id"))
             .agg(F.collect_set(F.struct("fp", "spans")).alias("__cuts")))
    rows = docs.join(found, docs["doc_id"].cast("long") == F.col("__cut_id"), "left")
    listed = F.col("__cuts").isNotNull()
    rows = rows.withColumn("__text", _cut(F.when(listed, F.col("text")), "__cuts"))
    rows = rows.filter(~listed | F.col("__text").isNotNull() | F.col("text").isNull())
    return rows.select(*[F.when(listed, F.col("__text")).otherwise(F.col("text")).alias("text") if c == "text" else docs[c]
                         for c in docs.columns])
