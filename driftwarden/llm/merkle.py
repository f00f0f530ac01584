"""Merkle manifest of a table: content-addressed records, and proofs by descent from the root.

1. A row's leaf is the digest of its columns.  Leaves are placed in their source's order (`ranks.numbered`, so
   a source may hold any share of the rows).
2. Blocks of FAN ** LEVELS neighbouring leaves are built in tasks, every `FAN` consecutive nodes into one; a block stores one record
   (digest, children's digests) per inner node, addressed by the digest, so equal subtrees of a block are stored once.  The blocks'
   tops are the leaves of the next pass, until every source has one node, its subroot.  Subroots, in order of source, form one more tree.
3. Leaf requests go down: the root's blocks first, then the blocks below, each with the path that leads to it.  In a block a
   request follows the digits of its rank from the top's record to its leaf and keeps the children that it
   does not take; the kept segments, reversed, come before the path of the block.

A digest is the lowercase hex SHA-256 of its inputs' concatenation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.llm.frames import groups
from driftwarden.llm.ranks import numbered
from driftwarden.session import hash_spread, stage_table

FAN, LEVELS, REQUESTS = 3, 8, 2048
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in COLUMNS]), 256)


def _height(n: int) -> int:
    levels = 0
    while FAN ** levels < n:
        levels += 1
    return levels


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _build(levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of nodes in order -> records (digest, children) of their inner nodes; the top's is marked."""
        for pdf in groups(batches, ["tree", "block"]):
            level, n = pdf["digest"].tolist(), int(pdf["n"].iloc[0])
            records: dict[str, list[str]] = {}
            for _ in range(min(levels, _height(n))):
                runs = [level[i:i + FAN] for i in range(0, len(level), FAN)]
                level = [_digest(run) for run in runs]
                records.update(zip(level, runs))
            records.setdefault(level[0], [])        # a lone leaf
            out = pd.DataFrame({"digest": list(records), "children": list(records.values())})
            out["top"] = out["digest"] == level[0]
            out.insert(0, "block", pdf["block"].iloc[0])
            out.insert(0, "tree", pdf["tree"].iloc[0])
            yield out
    return run


def build(nodes: DataFrame, most: int, levels: int = LEVELS) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, records) of every pass, leaves first, from `nodes` (tree, pos, n, digest) of trees with at most `most` nodes each.

    The last pass has one block per tree, whose top is the tree's root.
    """
    passes, size = [], FAN ** levels
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("pos") / size))
        sorted_ = hash_spread(nodes.select("tree", "block", "pos", "n", "digest"), "tree", "block").sortWithinPartitions(
            "tree", "block", "pos")
        records = stage_table(sorted_.mapInPandas(
            _build(levels), "tree string, block long, digest string, children array<string>, top boolean"), "records")
        passes.append((nodes, records))
        most = -(-most // size)
        if most <= 1:
            return passes
        sizes = records.filter("top").select("tree", "block", "digest")
        counts = sizes.groupBy("tree").agg(F.count("*").alias("n"))
        nodes = sizes.join(counts, "tree").select("tree", F.col("block").alias("pos"), "n", "digest")


def _descend(levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per block its path, its records and its requests -> the requests with their whole paths."""
        for pdf in groups(batches, ["tree", "block"]):
            kind = pdf["kind"].to_numpy()
            head, stored = pdf[kind == 0].iloc[0], pdf[kind == 1]
            records = {d: list(c) for d, c in zip(stored["digest"], stored["children"])}
            top = stored["digest"][stored["top"].astype(bool)].iloc[0]
            first, then = list(head["before"]), list(head["after"])
            wanted = pdf[kind == 2]
            for at in range(0, len(wanted), REQUESTS):
                asked = wanted.iloc[at:at + REQUESTS]
                before, after = [], []
                for pos, n in zip(asked["pos"].tolist(), asked["n"].tolist()):
                    rank, node, left, right = int(pos) % FAN ** levels, top, [], []
                    for level in reversed(range(min(levels, _height(int(n))))):
                        children, digit = records[node], rank // FAN ** level % FAN
                        left.append("".join(children[:digit]))
                        right.append("".join(children[digit + 1:]))
                        node = children[digit]
                    before.append(left[::-1] + first)
                    after.append(right[::-1] + then)
                yield pd.DataFrame({"tree": asked["tree"], "pos": asked["pos"], "payload": asked["payload"],
                                    "subroot": head["subroot"], "before": before, "after": after})
    return run


def _nothing() -> Column:
    return F.array().cast("array<string>")


def descend(passes: list[tuple[DataFrame, DataFrame]], paths: DataFrame, payload: str, levels: int = LEVELS) -> DataFrame:
    """tree, pos, payload, subroot, before, after for every leaf of the trees.

    `paths` (tree, subroot, before, after) leads from every tree's root upwards; `payload` is a column of the leaves.
    """
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    none = {c: F.lit(None).cast(t) for c, t in (("pos", "long"), ("n", "long"), ("payload", "string"), ("digest", "string"),
                                                ("children", "array<string>"), ("top", "boolean"), ("subroot", "string"),
                                                ("before", "array<string>"), ("after", "array<string>"))}

    def rows(df, kind, *columns):
        return df.select("tree", F.col("block").cast("long").alias("block"), F.lit(kind).alias("kind"),
                         *[(F.col(c) if c in columns else none[c]).alias(c) for c in none])

    for nodes, records in reversed(passes):
        asked = nodes.withColumn("payload", F.col(payload).cast("string") if nodes is passes[0][0] else F.lit(None).cast("string"))
        together = (rows(paths, 0, "subroot", "before", "after").unionByName(rows(records, 1, "digest", "children", "top"))
                    .unionByName(rows(asked, 2, "pos", "n", "payload")))
        found = hash_spread(together, "tree", "block").sortWithinPartitions("tree", "block", "kind").mapInPandas(
            _descend(levels), "tree string, pos long, payload string, subroot string, before array<string>, after array<string>")
        if nodes is passes[0][0]:
            return found
        paths = stage_table(found, "paths").select("tree", F.col("pos").alias("block"), "subroot", "before", "after")


def folded(leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(F.arrays_zip("before", "after"), leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def prove(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, changed_leaf, subroot, root, before, after per row of `docs` (doc_id, source, lang, n_chars, text; other
    columns are ignored).

    `before` and `after` list, from the leaf upwards, the joined digests of the siblings to the left and right of the path.
    changed_leaf is the leaf with the text `changed` (null where that is null; a column of `docs`' own columns).
    A null source is a source of its own and the first; a null doc_id is the first of its source; rows with one doc_id are ordered by
    their leaves.  Equal rows are leaves of their own.  An empty table gives no rows and has no root.
    """
    rows = docs.select(*COLUMNS)
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_digest(changed))
    leaves = rows.select("doc_id", "source", encoded(F.col("source")).alias("tree"), leaf_digest(F.col("text")).alias("digest"),
                         other.alias("changed_leaf"))
    leaves = stage_table(leaves, "digests")         # texts are read once, before the ranges are sampled
    placed = stage_table(numbered(leaves, ["tree"], ["doc_id", "digest"]).withColumn("payload", F.to_json(F.struct(
        "doc_id", "digest", "changed_leaf"))), "leaves")
    sources = stage_table(placed.groupBy("tree").agg(F.first("source").alias("source"), F.max("n").alias("n")), "sources")
    most = sources.agg(F.max("n")).first()[0]
    schema = f"struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, digest: string, changed_leaf: string>"
    if most is None:
        return placed.select("doc_id", F.col("digest").alias("leaf"), "changed_leaf", F.col("digest").alias("subroot"),
                             F.col("digest").alias("root"), _nothing().alias("before"), _nothing().alias("after"))
    passes = build(placed.select("tree", "pos", "n", "digest", "payload"), most, levels)
    subroots = passes[-1][1].filter("top").select("tree", F.col("digest").alias("subroot"))
    ordered = numbered(sources.select("tree", "source").join(subroots, "tree"), [], ["source"])
    ordered = stage_table(ordered.select(F.lit("").alias("tree"), "pos", "n", F.col("subroot").alias("digest"),
                                         F.col("tree").alias("payload")), "subroots")
    upper = build(ordered, ordered.count(), levels)
    root = upper[-1][1].filter("top").first()["digest"]
    above = ordered.select(F.lit("").alias("tree")).distinct().select(
        "tree", F.lit(None).cast("string").alias("subroot"), _nothing().alias("before"), _nothing().alias("after"))
    paths = descend(upper, above, "payload", levels).select("payload", "pos", "before", "after").join(
        ordered.select("pos", F.col("digest").alias("subroot")), "pos").select(F.col("payload").alias("tree"), "subroot", "before", "after")
    found = descend(passes, stage_table(paths, "source_paths"), "payload", levels).withColumn("row", F.from_json("payload", schema))
    return found.select("row.doc_id", F.col("row.digest").alias("leaf"), "row.changed_leaf", "subroot", F.lit(root).alias("root"),
                        "before", "after")


def without_line_breaks(docs: DataFrame) -> Column:
    """The text without line feeds, in rows whose decimal doc_id has an even CRC-32; else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def verify(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, checked against the row as changed
    by `without_line_breaks`; cases as in `prove`."""
    proofs = prove(docs, without_line_breaks(docs), levels)
    siblings = F.array_join(F.transform(F.arrays_zip("before", "after"), lambda s: F.concat(s["before"], s["after"])), "")
    checked = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                            folded(F.coalesce("changed_leaf", "leaf")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
