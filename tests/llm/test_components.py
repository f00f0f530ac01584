"""Connected components against a union-find."""

import random

import pytest

from driftwarden.llm import components as cc


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(parent))


@pytest.mark.parametrize("run", [500_000, 3])
def test_components(spark, monkeypatch, run):
    rnd = random.Random(4)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    loose = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    edges = path + star + loose + [(5, 5), (7, 6), (None, 3), (3, None)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    monkeypatch.setattr(cc, "RUN", run)
    assert sorted(map(tuple, cc.components(df).collect())) == brute(edges)


def test_no_links(spark):
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
