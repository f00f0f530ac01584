"""Merkle proofs against trees that are built by hand, one level after the other."""

import hashlib
import random
import zlib

import pytest

from driftwarden.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, text):
    values = [None if v is None else str(v) for v in (*row[:4], text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    steps = []
    for level in tree[:-1]:
        first = at // 3 * 3
        steps.append(("".join(level[first:at]), "".join(level[at + 1:first + 3])))
        at //= 3
    return steps


def brute(rows):
    by_source, out = {}, []
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, row in enumerate(by_source[s]):
            steps = path(trees[s], i) + path(top, k)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for before, after in steps:
                node = sha(before, node, after)
            out.append((row[0], leaf(row, row[4]), trees[s][-1][0], top[-1][0], sha(*[b + a for b, a in steps]), node,
                        node == top[-1][0]))
    return sorted(map(str, out))


def fixture(n=160):
    rnd, rows = random.Random(1), []
    for i in range(n):
        source = rnd.choice(["hot", "hot", "b", "é", "Z", "", None, "z" * 40])
        rows.append((rnd.choice([i - 20, i - 20, 7, None]), source, rnd.choice(["en", None, ""]), rnd.choice([None, i]),
                     rnd.choice([None, "", "a\nb", "é\n\n", "x" * 3000, "same"]), 1, "x"))
    return rows + [(900, "lone", None, None, None, 1, "x"), rows[3], rows[3], rows[3], (901, "hot", "en", 1, "word\n" * 40_000, 1, "x")]


def answers(spark, rows, levels=8):
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA).repartition(3), levels)
    return sorted(map(str, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())))


@pytest.mark.parametrize("height, requests", [(8, 2048), (1, 2), (2, 5)])
def test_against_trees_by_hand(spark, monkeypatch, height, requests):
    monkeypatch.setattr(merkle, "REQUESTS", requests)
    rows = fixture()
    assert answers(spark, rows, height) == brute(rows)         # low blocks make several passes


@pytest.mark.parametrize("rows", [[(5, "s", "en", 1, "a\nb", 1, "x")], [(5, None, None, None, None, 1, "x")],
                                  [(i, "s", "en", 1, "a\n", 1, "x") for i in range(4)]])
def test_few_rows(spark, rows):
    assert answers(spark, rows) == brute(rows)


def test_records_hold_every_subtree(spark):
    """A leaf's digest is reached from the root by the stored records alone."""
    rows = [(i, "s", "en", i, f"text {i}", 1, "x") for i in range(30)]
    nodes = spark.createDataFrame([("s", i, 30, leaf(r, r[4])) for i, r in enumerate(rows)], "tree string, pos long, n long, digest string")
    records = {r.digest: (r.children, r.top) for r in merkle.build(nodes, 30)[0][1].collect()}
    todo, seen = [d for d, (_, top) in records.items() if top], []
    assert len(todo) == 1
    while todo:
        node = todo.pop(0)
        (todo if node in records else seen).extend(records.get(node, ([node],))[0])
    assert seen == [leaf(r, r[4]) for r in rows]


def test_empty(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).collect() == []
