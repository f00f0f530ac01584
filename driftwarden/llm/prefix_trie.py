"""Prefix trie of conversations, for shared-prefix batching.

1. Turns are placed in their conversation, rebuilt, and get the 128-bit digest of the prefix that they end.  Conversations with
   equal digests are one class from here on, so any number of copies costs one row.
2. Nodes that only one class has are a chain without branches, and their values follow from running sums.  All others, with
   one turn more per class, make the trie.
3. Classes are sorted by their turns and cut into shards, each written as balanced parentheses (`parentheses`).  What is below a
   shard's first and last path is finished there; the paths, which neighbours share, are merged in groups of `GROUP` ranges
   until no path is left.

A conversation of any length is spread over many tasks; a class's row in step 3 is as long as the prefix it shares with an unlike conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.parentheses import Item, Node, Spine, merge, shard
from driftwarden.llm.ranks import lookup, numbered, running
from driftwarden.session import hash_spread, stage_table

SHARD, GROUP, IDS = 8192, 64, 8192
HEX = 32            # hex digits of a turn's symbol
WORD = "[^\\x20\\x09-\\x0D]+"

NODE = ("conv_id long, depth long, parent_conv_id long, parent_key string, key string, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends long")
SPINE = ("spine struct<key: string, parent: string, depth: long, words: long, convs: long, least: long, kids: long, leaves: long, "
         "saved: long, end: long, end_convs: long, tail: long, goes_on: boolean, left: boolean, right: boolean>")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n, sym, words per turn of `conversations` (conv_id, turn, role, text; rows without conv_id take no part)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, HEX)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", sym.alias("sym"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(turns, ["conv_id"], ["turn", "sym"]).select("conv_id", "pos", "n", "sym", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns whose first h are those of the first conversation of each run of `every` ids, h being CRC-32 of the decimal conv_id modulo `most`."""
    sizes = stage_table(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own_id = F.col("conv_id")
    convs = sizes.select("conv_id", "n", (own_id - own_id % every).alias("donor"),
                         (F.crc32(own_id.cast("string").cast("binary")) % most).alias("h"))
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("held"))
    convs = convs.join(donors, "donor", "left").withColumn("given", F.least("h", F.coalesce("held", F.lit(0))))
    heads = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("donor"), "pos", "sym", "words")
    given = convs.select("conv_id", "donor", "h").join(heads, "donor").filter("pos < h").select("conv_id", "pos", "sym", "words")
    kept = lookup(turns.drop("n"), convs.select("conv_id", "n", "h", "given"), "conv_id", "n", total).filter("pos >= h")
    return given.unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "sym", "words"))


def _with_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the digest (k1, k2) of the prefix they end and the words up to them."""
    rows = turns.withColumn("k1", F.xxhash64("sym", "pos")).withColumn("k2", F.xxhash64(F.lit("second"), "pos", "sym"))
    rows = running(rows, "conv_id", {"k1": F.bit_xor, "k2": F.bit_xor, "words": F.sum})
    key = [F.col(f"_inside_{k}").bitwiseXOR(F.coalesce(f"_before_{k}", F.lit(0))).alias(k) for k in ("k1", "k2")]
    return rows.select("conv_id", "pos", "sym", "words", *key,
                       (F.col("_inside_words") + F.coalesce("_before_words", F.lit(0))).alias("upto"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv_ids sorted by class -> joined decimals, `IDS` at most in a row."""
    seq = 0
    for pdf in batches:
        if not len(pdf):
            continue
        codes = pdf[["len", "k1", "k2"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            for at in range(a, b, IDS):
                ids = pdf["conv_id"].iloc[at:min(b, at + IDS)].tolist()
                rows.append((*codes[a].tolist(), int(pdf["part"].iloc[0]), seq, ids[0], ",".join(map(str, ids))))
                seq += 1
        yield pd.DataFrame(rows, columns=["len", "k1", "k2", "part", "seq", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joined decimals in order -> (smallest conv_id, digest) per class; one running digest is held."""
    held, state, first = None, None, None
    for pdf in batches:
        rows = []
        for *key, low, ids in zip(*[pdf[c].tolist() for c in ("len", "k1", "k2", "first", "ids")]):
            if key == held:
                state.update(b",")
            else:
                if held is not None:
                    rows.append((first, state.hexdigest()))
                held, state, first = key, sha256(), low
            state.update(ids.encode())
        yield pd.DataFrame(rows, columns=["ends", "ends_sha256"]).astype({"ends": "int64"})
    if held is not None:
        yield pd.DataFrame([(first, state.hexdigest())], columns=["ends", "ends_sha256"])


def _end_digests(classed: DataFrame) -> DataFrame:
    """(ends: a class's smallest conv_id, ends_sha256) from (conv_id, len, k1, k2)."""
    key = ["len", "k1", "k2"]
    n = int(classed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (classed.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .withColumn("part", F.spark_partition_id())
              .mapInPandas(_chunks, "len long, k1 long, k2 long, part int, seq long, first long, ids string"))
    return hash_spread(chunks, *key).sortWithinPartitions(*key, "part", "seq").mapInPandas(_digests, "ends long, ends_sha256 string")


def _as_rows(nodes: list[Node], spine: list[Spine], part: int) -> pd.DataFrame:
    rows = [(x.conv_id, x.depth, x.parent, x.parent_key, x.key, x.n_convs, x.n_children, x.n_leaves, x.saved, x.end, None, part) for x in nodes]
    rows += [(None,) * 10 + (vars(x), part) for x in spine]
    out = pd.DataFrame(rows, columns=["conv_id", "depth", "parent_conv_id", "parent_key", "key", "n_convs", "n_children", "n_leaves",
                                      "saved_tokens", "ends", "spine", "part"])
    for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"):
        out[c] = out[c].astype("Int64")
    return out


def _shards(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Classes sorted by path, in shards of `size` -> finished nodes, and one spine for all of them."""
        items, spine, part = [], None, 0

        def close():
            nonlocal spine
            nodes, found = shard(items)
            items.clear()
            more = []
            if spine is not None:
                more, found = merge([spine, found])
            spine = found
            return _as_rows(nodes + more, [], part)

        for pdf in batches:
            for path, words, conv, copies, tail, goes_on, part in zip(*[pdf[c].tolist() for c in (
                    "path", "words", "conv_id", "copies", "tail", "goes_on", "part")]):
                symbols = [path[i:i + HEX] for i in range(0, len(path), HEX)]
                items.append(Item(symbols, list(words), conv, copies, tail, goes_on))
                if len(items) == size:
                    yield close()
        if items:
            yield close()
        if spine is not None:
            yield _as_rows([], spine, part)
    return run


def _merged(whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spines of neighbouring ranges, sorted by group and range -> finished nodes and one spine per group."""
        group, held = None, {}

        def close():
            nodes, spine = merge([held[p] for p in sorted(held)], whole)
            return _as_rows(nodes, spine, group)

        for pdf in batches:
            for at, part, row in zip(pdf["grp"].tolist(), pdf["part"].tolist(), pdf["spine"].tolist()):
                if group is not None and at != group:
                    yield close()
                    held.clear()
                group = at
                held.setdefault(part, []).append(Spine(**row))
        if group is not None:
            yield close()
    return run


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    `turns` holds conv_id, pos (from 0 without gaps), sym (the turn's digest, `HEX` digits) and words; `convs` every conv_id once, also
    those without turns.  No conversations have no trie.
    """
    keyed = stage_table(_with_prefixes(turns), "turns")
    total = keyed.count()
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "pos").alias("k"), F.count("*").alias("len"), F.max("upto").alias("all"))
    zero = F.lit(0).cast("long")
    classed = stage_table(convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("len", zero).alias("len"), F.coalesce("k.k1", zero).alias("k1"), F.coalesce("k.k2", zero).alias("k2"),
        F.coalesce("all", zero).alias("all")), "classed")
    classes = stage_table(classed.groupBy("len", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.max("all").alias("all")).drop("k1", "k2"), "classes")
    rows = lookup(keyed, classes, "conv_id", "len", total).filter("copies is not null")
    rows = stage_table(rows.withColumn("node", F.struct("pos", "k1", "k2")).drop("k1", "k2"), "class_turns")
    counts = rows.groupBy("node").agg(F.count("*").alias("holders"))
    counted = lookup(rows, counts.withColumn("classes", F.col("holders")), "node", "holders", total)
    shared = counted.groupBy("conv_id").agg(F.count_if(F.col("classes") > 1).alias("shared"), F.count("*").alias("len"))
    rows = stage_table(lookup(rows.drop("node"), shared.withColumn("turns", F.col("len")), "conv_id", "len", total), "shared")

    trimmed = rows.filter("pos <= shared").groupBy("conv_id", "copies", "all", "turns").agg(
        F.sort_array(F.collect_list(F.struct("pos", "sym", "words"))).alias("t"))
    items = trimmed.select(
        F.array_join(F.transform("t", lambda x: x["sym"]), "").alias("path"), F.transform("t", lambda x: x["words"]).alias("words"), "conv_id",
        "copies", (F.col("all") - F.aggregate("t", zero, lambda acc, x: acc + x["words"])).alias("tail"), (F.col("turns") > F.size("t")).alias("goes_on"))
    silent = classes.filter("len = 0").select(F.lit("").alias("path"), F.array().cast("array<long>").alias("words"), "conv_id", "copies",
                                              zero.alias("tail"), F.lit(False).alias("goes_on"))
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = stage_table(items.unionByName(silent), "items")
    sorted_ = items.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    made = [stage_table(sorted_.mapInPandas(_shards(SHARD), f"{NODE}, {SPINE}, part long"), "shards")]
    top = made[0].agg(F.max("part")).first()[0] or 0
    while True:
        spines = made[-1].filter("spine is not null").select(F.floor(F.col("part") / GROUP).alias("grp"), "part", "spine")
        top //= GROUP
        made.append(stage_table(hash_spread(spines, "grp").sortWithinPartitions("grp", "part").mapInPandas(
            _merged(not top), f"{NODE}, {SPINE}, part long"), "spines"))
        if not top:
            break
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.union(more)
    nodes = nodes.filter("spine is null").drop("spine", "part")
    waiting = stage_table(nodes.filter("parent_key is not null"), "waiting")
    above = nodes.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), "n_children")
    found = lookup(waiting.drop("parent_conv_id", "key"), above.withColumnRenamed("n_children", "below"), "parent_key", "below", waiting.count())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    trie = nodes.filter("parent_key is null").select(*columns).unionByName(
        found.withColumnRenamed("above", "parent_conv_id").select(*columns))
    ends = F.col("pos") == F.col("turns") - 1
    chains = rows.filter("pos > shared").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("all") - F.col("upto") + F.col("words"))).alias("saved_tokens"), F.when(ends, F.col("conv_id")).alias("ends"))
    whole = stage_table(trie.unionByName(chains), "nodes")
    ended = whole.filter("ends is not null").join(_end_digests(classed.select("conv_id", "len", "k1", "k2")), "ends")
    inner = whole.filter("ends is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return ended.unionByName(inner).drop("ends")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of rebuilt `conversations` (conv_id, turn, role, text; other columns are ignored).

    Turns are ordered by turn, null first, equal ones by a digest of role and text; null roles and texts are empty; repeated
    rows are turns of their own; rows without conv_id take no part.  An empty table has no nodes.
    """
    turns = stage_table(placed_turns(conversations), "placed")
    return prefix_trie(stage_table(rebuilt(turns), "rebuilt"), turns.select("conv_id").distinct())
