"""Near duplicates against all pairs of full shingle sets."""

import random

import pytest

from driftwarden.llm import near_duplicates as nd


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def fixture():
    rnd, rows = random.Random(8), []
    voc = [f"w{i}" for i in range(400)]
    for size in (3, 30, 200, 200, 60, 1000):
        base = [rnd.choice(voc) for _ in range(size)]
        for _ in range(rnd.choice([1, 3, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(voc)
            text = "\t".join(words)
            rows.append((len(rows) * 7 % 2003, text if rnd.random() < .8 else text.upper()))
    return rows + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b"), (None, "a b"), (9003, "a b"), (9005, "É é"), (9006, "é é")]


def linked(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    least = {}
    for a, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(a)] = min(least.get(root(a), 1 << 60), doc)
    return [(doc, len(sets[a]), None if doc is None else least[root(a)]) for a, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("chunk", [256, 8])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cid string").repartition(4)
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, similarity=0.85).collect())))
    assert got == sorted(map(str, ((d, n, c, d is None or d == c) for d, n, c in linked(rows))))


def test_one_stays(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, body string")
    got = nd.keep_one(df, similarity=0.85)
    assert got.columns == df.columns
    want = {str(d) for d, n, c in linked(rows) if d is None or d == c}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(want)


def test_unlike_texts_under_one_id_stay(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, other), (1, other + " b"), (5, other), (6, one), (7, ""), (7, None)]
    got = [tuple(r) for r in nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 4 and {(1, one), (7, ""), (7, None)} < set(got)
    assert len({(1, other), (1, other + " b")} & set(got)) == 1


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_follows_similarity():
    import numpy as np
    rnd = np.random.default_rng(3)
    pool = rnd.integers(1, 1 << 62, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[400:2400]          # similarity 2/3
    equal = np.mean((nd.minima(a) & np.uint64(15)) == (nd.minima(b) & np.uint64(15)))
    assert abs(nd.estimated(equal * nd.HASHES) - 2 / 3) < 0.17
