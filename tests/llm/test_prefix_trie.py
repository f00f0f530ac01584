"""Tries against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from driftwarden.llm import parentheses, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos int, ends string"


def sym(role, text):
    role = role or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text or ''}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, sym(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(donor, [])[:h] + ts[h:])
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    children, out = {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0)
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed, n=150, hot=False):
    rnd, rows = random.Random(seed), []
    voc = [("user", "a b"), ("user", "c"), ("bot", "d e f"), (None, None), ("", ""), ("bot", " "), ("user", "\té x\x85y\n")]
    for c in range(-25, n):
        size = rnd.choice([0, 1, 2, 3, 4, 6, 9])
        same = rnd.random() < .4
        for i in range(size):
            role, text = voc[(i * 3 + c // 40) % 7] if same else rnd.choice(voc[:rnd.choice([2, 7])])
            rows.append((rnd.choice([c, c, c, c, None]), rnd.choice([i, i, 0, None]), role, text))
    if hot:                     # a long conversation, its copy, and one that leaves it late
        for c in (700, 701, 702):
            rows += [(c, i, "user", f"long {i % 7}" if (c, i) != (702, 80) else "other") for i in range(120)]
    return rows


def answer(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.conversation_trie(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    return sorted(map(str, map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                 "ends_sha256").collect())))


def test_against_all_prefixes(spark):
    rows = conversations(1, hot=True)
    assert answer(spark, rows) == brute(rows)


@pytest.mark.parametrize("shard, group", [(3, 2), (1, 64)])
def test_small_shards_and_groups(spark, monkeypatch, shard, group):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    rows = conversations(2, hot=True)
    assert answer(spark, rows) == brute(rows)


def test_hot_keys(spark, monkeypatch):
    from driftwarden.llm import ranks
    monkeypatch.setattr(ranks, "HOT_ROWS", 2)           # frequent nodes, classes and conversations are looked up apart
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = conversations(3) + [(c, i, "user", f"copy {i}") for c in range(2000, 2100) for i in range(4)]
    assert answer(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[(21, 0, "user", "a")], [(None, 0, "user", "a")], [(1, 0, "a", "b"), (2, 0, "a", "b")],
                                  [(40, 0, "u", "x " * 200_000), (41, 0, "u", "x " * 200_000), (41, 1, None, None)]])
def test_few_rows(spark, rows):
    assert answer(spark, rows) == brute(rows)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(spark, rows) == brute(rows)


@pytest.mark.parametrize("depth", [1, 40, 5000])
def test_findclose(depth):
    """Against a stack, on random tries and on a single deep path."""
    rnd = random.Random(depth)
    for deep in (True, False):
        signs, height = [True], 1
        while len(signs) < 4 * depth:
            up = height == 1 or (rnd.random() < .5 if not deep else len(signs) < 2 * depth)
            signs.append(up)
            height += 1 if up else -1
        signs += [False] * height
        stack, want = [], {}
        for i, s in enumerate(signs):
            if s:
                stack.append(i)
            else:
                want[stack.pop()] = i
        begin = np.array(sorted(want))
        trie = parentheses.Parentheses(np.array(signs))
        assert trie.findclose(begin).tolist() == [want[i] for i in begin.tolist()]
        pairs = [i for i in range(len(signs) - 1) if signs[i] and not signs[i + 1]]
        assert trie.leaves_before[[0, len(signs) - 1]].tolist() == [0, len(pairs)]
